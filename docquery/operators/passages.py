"""Many literal passages found in one walk over each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from docquery.session import materialise, scratch_path, spread
from docquery.sources.shared import read_columns

# Passages whose automaton a task holds at once, and the characters of each that it walks by.
SLICE = 50_000
ANCHOR = 24


class Automaton:
    """Aho-Corasick over the first ANCHOR characters of passages; the rest is compared where those are met."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        self.everywhere = [i for i, text in rows if text == ""]
        anchors: dict[str, dict[str, list]] = {}
        for i, text in rows:
            if text:
                anchors.setdefault(text[:ANCHOR], {}).setdefault(text, []).append(i)
        for anchor, passages in anchors.items():
            self.machine.add_word(anchor, (len(anchor), passages))
        if anchors:
            self.machine.make_automaton()
        self.empty = not anchors

    def found(self, text: str) -> list:
        """Ids of the passages that the text contains."""
        held, seen = list(self.everywhere), set()
        for end, (length, passages) in () if self.empty else self.machine.iter(text):
            at = end - length + 1
            for passage, ids in passages.items():
                if passage not in seen and text.startswith(passage, at):
                    seen.add(passage)
                    held += ids
        return held


def passages_in(docs: DataFrame, passages: DataFrame, doc_id: str, doc_text: str, passage_id: str,
                passage_text: str) -> DataFrame:
    """(query_id, doc_id) where the document contains the passage verbatim.

    An empty passage lies in every text, a NULL one in none. Passages are written to the shared folder in files of at
    most SLICE; the documents are scanned once and not shuffled, each batch walking through one file's automaton after
    the other (the only file of a small table stays open).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "passages")
    known = materialise(passages.where(F.col(passage_text).isNotNull()).select(
        F.col(passage_id).alias("query_id"), F.col(passage_text).alias("passage")), "known-passages")
    known.repartition(known.count() // SLICE + 1).write.parquet(path)
    files = spark.read.schema(known.schema).parquet(path).inputFiles()
    schema = T.StructType([known.schema["query_id"], T.StructField("doc_id", docs.schema[doc_id].dataType)])
    fields = to_arrow_schema(schema)

    def walk(batches):
        opened: dict[str, Automaton] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for file in files:
                if file not in opened:
                    opened.clear()
                    table = read_columns(file, ["query_id", "passage"])
                    opened[file] = Automaton(list(zip(table["query_id"].to_pylist(), table["passage"].to_pylist())))
                held = [(i, at) for at, text in enumerate(texts) for i in opened[file].found(text)]
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in held], fields[0].type), batch.column(0).take(pa.array([at for _, at in held]))],
                        schema=fields)

    rows = spread(docs.select(doc_id, doc_text), doc_id).where(F.col(doc_text).isNotNull())
    return rows.mapInArrow(walk, schema).distinct()
