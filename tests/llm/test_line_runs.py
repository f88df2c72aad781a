"""Line dedup against brute force over repeated runs of lines."""

import random

from opsloom.llm import line_dedup

DOCS = "doc_id long, text string"


def brute_runs(texts):
    """Texts without the lines of pairs of neighbouring lines that occurred before."""
    seen, out = {}, []
    for k, t in enumerate(texts):
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 1):
            if lines[i].strip() or lines[i + 1].strip():
                first = seen.setdefault((lines[i], lines[i + 1]), (k, i))
                if first != (k, i):
                    gone |= {i, i + 1} - ({first[1] + 1} if first[0] == k else set())
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_passages_of_each_length_inside_other_texts(spark):
    random.seed(11)
    passages = [[f"passage {p} line {i}" for i in range(2 + p % 7)] for p in range(70)]
    texts = []
    for turn in range(3):
        for p, passage in enumerate(passages):
            own = [f"own {turn} {p} {i}" for i in range(random.randint(2, 6))]
            own[1:1] = passage
            texts.append("\n".join(own))
    texts += ["x\nx\nx\nx", "a\nb\na\nb\na", "h\n\n\nt", "q\nh\n\n\nt", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = line_dedup.apply(docs, extend=True).orderBy("doc_id").collect()
    want = brute_runs(texts)
    assert [r["text"] for r in rows if r["doc_id"] not in (212, 213)] == [t for i, t in enumerate(want) if i not in (212, 213)]
    assert all("passage" not in r["text"] for r in rows[70:210]) and all(f"passage {i} " in r["text"] for i, r in enumerate(rows[:70]))
    assert all(r["n_removed_lines"] == len(passages[r["doc_id"] % 70]) and r["n_removed_chunks"] == 1 for r in rows[70:210])
