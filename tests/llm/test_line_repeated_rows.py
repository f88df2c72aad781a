"""Line dedup of rows that repeat key and text or have no key."""

from opsloom.llm import line_dedup

DOCS = "doc_id long, text string"


def test_one_of_repeated_rows_keeps_its_text(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    other = "\n".join(f"other {i}" for i in range(20))
    for extend in (False, True):
        docs = spark.createDataFrame([(1, text), (1, text), (1, other), (None, text), (None, text), (None, "n\n" + other)], DOCS)
        rows = line_dedup.apply(docs, extend=extend).collect()
        ones, nulls = [r["text"] for r in rows if r["doc_id"] == 1], [r["text"] for r in rows if r["doc_id"] is None]
        assert ones.count(text) == 1 and ones.count(other) == 1 and len(ones) == len(nulls) == 3
        assert all(len(t) < len(text) / 2 for t in [min(ones, key=len), *nulls])
