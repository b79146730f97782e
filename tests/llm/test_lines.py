"""Line deduplication against brute force over all pairs of positions."""

import random
import re

from lakeloom.llm import lines

HAS = re.compile(r"[^\x20\x09-\x0d]")


def brute(docs, least):
    seqs = {}
    for i, t in docs:
        seqs[i] = [(n, x, len(re.findall(r"[^\x20\x09-\x0d]+", x))) for n, x in enumerate((t or "").split("\n")) if HAS.search(x)]
    order = sorted(seqs, key=lambda i: (i is not None, i or 0))
    gone = {i: set() for i in seqs}
    for a, i in enumerate(order):
        for k in range(len(seqs[i])):
            for j in order[: a + 1]:
                for q in range(k if j == i else len(seqs[j])):
                    m = n = 0
                    while k + m < len(seqs[i]) and q + m < len(seqs[j]) and seqs[i][k + m][1] == seqs[j][q + m][1]:
                        n += seqs[i][k + m][2]
                        m += 1
                    if n >= least:
                        gone[i].update(seqs[i][k + o][0] for o in range(m))
    return gone


def test_random_documents(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(25)] + ["", " ", "long " * 12]
    docs = []
    for i in range(60):
        text = [rng.choice(pool) if rng.random() < 0.8 else f"u{i} {k} x" for k in range(rng.randint(0, 14))]
        if docs and rng.random() < 0.5:
            old = (rng.choice(docs)[1] or "").split("\n")
            s = rng.randrange(len(old))
            text[2:2] = old[s : s + rng.randint(1, 8)]
        docs.append((i * 3 % 61, "\n".join(text)))
    docs += [(None, docs[7][1]), (100, None), (101, "")]
    for least in (3, 8):
        out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least).collect()
        want = brute(docs, least)
        assert len(out) == len(docs)
        for r in out:
            text = dict(docs)[r.doc_id]
            assert set(r.removed_lines) == want[r.doc_id], (least, r)
            assert r.text == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[r.doc_id]))


def test_edges(spark):
    line = "a line of more than ten words that many documents share with each other"
    rows = [(1, line, "x", 0), (1, line, "x", 0), (2, line + "\nown", "y", 1), (3, "\n".join([line] * 50), None, None), (4, line[1:], "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_lines string, d int")
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "d", "removed_lines"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.count() == 5 and got == {1: line, 2: "own", 3: "", 4: line[1:]}
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_one_document_of_very_many_lines(spark):
    """Twenty thousand lines, every other one a copy of the document before it; what is left is every second line."""
    own = [f"line {i} of one document with more than ten words in each of them" for i in range(20_000)]
    other = [f"copied line {i} that stands in both documents and has more than ten words" for i in range(10_000)]
    mixed = [x for pair in zip(own[:10_000], other, strict=True) for x in pair]
    docs = spark.createDataFrame([(1, "\n".join(other)), (2, "\n".join(mixed + own[10_000:]))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got[1] == "\n".join(other) and got[2] == "\n".join(own)
