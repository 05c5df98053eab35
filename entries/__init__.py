"""Registered queries: Spark callables and their DuckDB twins."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from entries import functions, guard, io, metrics, retrieval, sessions, streams  # noqa: E402,F401
from entries import checks  # noqa: E402,F401
from entries.tables import REGISTRY  # noqa: E402,F401
