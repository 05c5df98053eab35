"""Files of the shared folder as tasks read them."""

from __future__ import annotations

from urllib.parse import unquote


def read_columns(uri: str, columns: list[str]):
    """Columns of one Parquet file, by the URI that Spark gives it."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + unquote(uri.removeprefix("file:")))
    with files.open_input_file(path) as file:
        return pq.ParquetFile(file).read(columns=columns)
