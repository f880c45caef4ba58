"""Token columns against the encoding called on whole texts."""

from pyspark.sql import functions as F

from gneissflow.functions import text as T
from gneissflow.functions.tokens import counter, with_tokens
from gneissflow.plans import queries as q

TEXTS = ["", "a", "don't we'll  go\n\n  there ", "漢字かな 🙂🙂 naïve Ünïcode", "x" * 300, "  \t lead", "12345 67.89% __init__(self):\n\treturn None\n", "word " * 400, "tail   "]


def test_counts_by_pieces_equal_the_encoding():
    enc = T.tokenizer()
    with open(T.VOCABULARY, "rb") as f:
        count = counter(f.read())
    assert [count(x) for x in TEXTS * 2] == [max(1, len(enc.encode_ordinary(x))) for x in TEXTS * 2]


def test_columns_equal_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.tokens, r.clipped) for r in q.document_tokens(spark, sf).collect()}
    want = {r.doc_id: None if r.text is None else (T.estimate_tokens_py(r.text), T.clip_py(r.text, 200)) for r in docs.collect()}
    assert got == {k: v or (None, None) for k, v in want.items()}


def test_odd_rows_and_names(spark):
    rows = spark.createDataFrame([(i, x, "old") for i, x in enumerate([*TEXTS, None])], "i long, clipped string, n string")
    got = with_tokens(rows, "clipped", "n", vocabulary=None)
    assert got.columns == ["i", "clipped", "n"]
    assert [r.n for r in got.orderBy("i").collect()] == [max(1, -(-len(x.encode()) // 4)) for x in TEXTS] + [None]
    assert with_tokens(rows.limit(0), "clipped", "n", 5).where(F.col("n") > 0).collect() == []
    assert with_tokens(rows, "clipped", "n", vocabulary="/no/such/file").first().n == 1
