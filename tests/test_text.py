import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docquery.functions.text import strip, token_count
from docquery.operators.chunking import chunk_documents
from docquery.session import scratch_path, shared_dir

TEXTS = ["", " ", "a", " a  b ", "x y　z", "line\none\r\ntwo\x0bthree\x1cfour\x85five", "tab\tand sep", None]


def test_token_count_is_str_split(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select(
        "i", "t", token_count("t").alias("n"), strip("t").alias("s")).collect()
    for r in rows:
        assert r.n == (None if r.t is None else len(r.t.split()))
        assert r.s == (None if r.t is None else r.t.strip())




def chunk_by_hand(text, limit):
    pieces = [p[i:i + limit] for p in text.split("\n") if p for i in range(0, len(p), limit)]
    out = []
    for p in pieces:
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def test_chunks_by_hand(spark):
    texts = ["", "\n\n", "one", "aa\nbb\n\ncc\ndd", "x" * 25, "ab\n" + "y" * 10 + "\nz", "abcde\nfghi\nj", "12345\n6789\n" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in chunk_documents(df, limit=10).orderBy("document_id", "position").collect():
        assert r.chunk_id == f"{r.document_id}-chunk-{r.position}"
        got.setdefault(int(r.document_id), []).append(r.content)
    for i, t in enumerate(texts):
        assert got.get(i, []) == chunk_by_hand(t, 10)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=20))
def test_chunks_lose_nothing(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    chunks = chunk_documents(df, limit=7)
    assert chunks.where(F.length("content") > 7).count() == 0
    joined = {}
    for r in chunks.orderBy("document_id", "position").collect():
        joined[int(r.document_id)] = joined.get(int(r.document_id), "") + r.content.replace("\n", "")
    for i, t in enumerate(texts):
        assert joined.get(i, "") == t.replace("\n", "")


class _Session:
    """Only what shared_dir reads."""

    def __init__(self, master, named=None):
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()
        self.conf = type("R", (), {"get": staticmethod(lambda key, default=None: named or default)})()


def test_scratch_folder_comes_from_the_cluster():
    assert shared_dir(_Session("yarn", "s3a://bucket/ckpt/")) == "s3a://bucket/ckpt"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session("yarn"))
    local = _Session("local[2]")
    assert shared_dir(local) == shared_dir(local)
    assert scratch_path(_Session("yarn", "hdfs://c"), "x") != scratch_path(_Session("yarn", "hdfs://c"), "x")
