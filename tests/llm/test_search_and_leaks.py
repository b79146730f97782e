"""Hard negatives, benchmark decontamination and ranked search against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import decontam, negatives, search, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return WORD.findall(lowered(text))


TEXTS = [None, "", "a", " One two;THREE ", "É ß straße ÄB_c-d", "x" * 40 + " " + "x" * 41, "12345678 123456789 1234567812345678 12345678x12345678", "日本語 テキスト。\x00ok\n\n\tend", "[]{}~", "a " * 5000, "­ zero​width"]


@pytest.mark.parametrize("size", [1, 50, 1 << 21])
def test_words(monkeypatch, size):
    monkeypatch.setattr(tokens, "SLICE", size)
    got = [[] for _ in TEXTS]
    for column in (pa.array(TEXTS), pa.chunked_array([TEXTS[:3], TEXTS[3:]], pa.string()), pa.array([*TEXTS, "no"]).slice(0, len(TEXTS))):
        got, keys = [[] for _ in TEXTS], {}
        for w in tokens.split(column):
            for i, (r, k) in enumerate(zip(w.row.tolist(), w.keys().tolist(), strict=True)):
                got[w.lo + r].append(w.word(i).decode())
                assert keys.setdefault(k, w.word(i)) == w.word(i)
                at = w.offset[r]
                assert lowered(bytes(w.raw[w.origin[i] : w.origin[i] + w.length[i]]).decode()) == w.word(i).decode() and w.origin[i] >= at
        assert got == [words_of(t) for t in TEXTS]


# Decontamination


def leaks_brute(docs, bench, n):
    """n_words, n_hit, items and spans of each text."""
    windows = {}
    for item, text in bench:
        ws = words_of(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + n]), set()).add(None if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        at = [(m.start(), m.end()) for m in WORD.finditer(lowered(text))]
        ws, hit, items = words_of(text), set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if found := windows.get(tuple(ws[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1] = (spans[-1][0], at[i][1])
            else:
                spans.append(at[i])
        out.append((len(ws), len(hit), sorted(items, key=lambda x: (x is None, x or "")), spans))
    return out


def made_texts(rng, n, vocabulary=6, most=40):
    seps = [" ", "  ", "\n", ", ", "-", ". "]
    pick = lambda: rng.choice(["Aa", "b", "ß", "日", "dd", "e1", "Fgh", "i" * 20][:vocabulary])
    return ["".join(pick() + rng.choice(seps) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize(("n", "block", "piece"), [(3, 1 << 23, 4096), (3, 60, 4), (5, 40, 1)])
def test_decontamination(spark, monkeypatch, n, block, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    rng = random.Random(n)
    texts = [None, "", "...", *made_texts(rng, 80)]
    bench = [(None, "aa b ß"), (1, None), (2, "..."), (3, "b"), (4, texts[5]), (4, "dd e1 aa aa"), (5, texts[5]), *[(i, t) for i, t in enumerate(made_texts(rng, 12, most=12), 10)]]
    # No item of a single word that every text holds, so that there are clean ones.
    bench = [x for x in bench if len(words_of(x[1])) != 1 or x[0] == 3 and n == 5]
    docs = spark.createDataFrame([(i, t, i, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_hit int, row string")
    items = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, piece int")
    found = {r.doc_id: r for r in decontam.scan(docs, items, n=n, block=block).collect()}
    want = leaks_brute(texts, bench, n)
    assert {i: (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for i, r in found.items()} == dict(enumerate(want))
    left = {r.doc_id: r for r in decontam.decontaminate(docs, items, n=n, block=block).collect()}
    for i, (text, (_, _, _, spans)) in enumerate(zip(texts, want, strict=True)):
        cut = text if text is None else "".join(text[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(text)], strict=True))
        assert tuple(left[i]) == (i, cut, i, "clash")
    kept = decontam.decontaminate(docs, items, "documents", n=n, block=block)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w[1]]
    d = {r.doc_id: r for r in decontam.digest(decontam.scan(docs, items, n=n)).collect()}
    for i, (n_words, n_hit, names, _) in enumerate(want):
        assert (d[i].n_words, d[i].n_hit, d[i].n_items, d[i].contaminated) == (n_words, n_hit, len(names), n_hit > 0)
        assert d[i].items_sha256 == hashlib.sha256(",".join(x for x in names if x is not None).encode()).hexdigest()


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A-b c")], "item_id long, text string")
    assert decontam.scan(docs.where("false"), items).count() == 0
    assert [r.n_hit for r in decontam.scan(docs, items.where("false")).collect()] == [0, 0, 0]
    assert sorted((r.n_hit, r["items"]) for r in decontam.scan(docs, items).collect()) == [(0, []), (3, ["1"]), (3, ["1"])]
    with pytest.raises(ValueError, match="remove"):
        decontam.decontaminate(docs, items, "lines")


def test_windows_that_share_a_key(monkeypatch):
    """Keys decide nothing: with all keys equal the result is the same."""
    bench = [(1, "a b c d"), (2, "b c d e"), (3, "x y z x")]
    texts = ["a b c d e", "x y", "z x y z x", "b c d"]
    monkeypatch.setattr(tokens.Words, "keys", lambda self: np.zeros(len(self.row), np.uint64))
    index = decontam.Index([str(i) for i, _ in bench], [t for _, t in bench], 3)
    (w,) = tokens.split(pa.array(texts))
    columns = decontam._match(index, w, None)
    want = leaks_brute(texts, bench, 3)
    assert [(a, b, c) for a, b, c in zip(*(x.to_pylist() for x in columns[:3]), strict=True)] == [x[:3] for x in want]
    terms = search.Terms(["a bb", "long" * 9 + " bb"])
    word, term = terms.find(w)
    assert [(w.word(i), terms.text[t]) for i, t in zip(word, term, strict=True)] == [(b"a", b"a")]


def test_a_very_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    text = "lorem ipsum, " * 400_000 + passage + " dolor" * 400_000 + "y" * 3_000_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    (r,) = decontam.scan(docs, items).collect()
    assert (r.n_words, r.n_hit, [text[s.start : s.end] for s in r.spans]) == (1_200_030, 30, [passage])
    (r,) = search.rank(docs, items).collect()
    assert (r.item_id, r["rank"], r.doc_id) == (7, 1, 1)


# Search


def ranked_brute(docs, queries, k):
    n_of = [words_of(t) for _, t in docs]
    some = [w for w in n_of if w]
    n_docs, n_terms = len(some), sum(map(len, some))
    df = {}
    for w in some:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in queries:
        found = []
        for (doc, _), w in zip(docs, n_of, strict=True):
            score = 0
            for t in words_of(text):
                if tf := w.count(t):
                    m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("group", "size", "block", "sample", "k"), [(2048, 32, 1 << 18, 16, 10), (8, 2, 1 << 18, 2, 3), (5, 3, 40, 1, 4)])
def test_search(spark, monkeypatch, group, size, block, sample, k):
    monkeypatch.setattr(search, "GROUP", group)
    rng = random.Random(group)
    vocabulary = ["a", "b", "bb", "c", "dd", "e", "f" * 17, "f" * 17 + "g", "ß", "日本"] + [f"t{i}" for i in range(30)]
    make = lambda most: " ".join(rng.choice(vocabulary[: rng.choice([5, 40])]) for _ in range(rng.randrange(most)))
    docs = [(None, "t1 t2 t3"), (7, None), (8, ""), (9, "--"), *[(i, make(60)) for i in range(10, 150)]]
    docs += [(200 + i, docs[20][1]) for i in range(30)] + [docs[25]] * 3 + [(-5, docs[25][1])]
    queries = [(1, None), (2, ""), (3, "none of these"), (None, "t1 t2 a"), (5, docs[20][1]), (6, "f" * 17), *[(i, make(12)) for i in range(10, 30)]]
    rows = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id long, text string, score int, query int").repartition(3)
    items = spark.createDataFrame([(*q, 1) for q in queries], "item_id long, text string, rank int")
    got = search.rank(rows, items, k=k, size=size, block=block, sample=sample)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked_brute(docs, queries, k)


def test_repeated_and_empty_queries(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, "zz")], "item_id long, text string")
    assert [(r.item_id, r["rank"], r.doc_id) for r in search.rank(docs, items).collect()] == [(1, 1, 1)] * 2
    assert search.rank(docs, items.where("false")).count() == 0
    assert search.rank(docs.where("false"), items).count() == 0
    assert search.rank(docs.selectExpr("doc_id", "cast(null as string) text"), items).count() == 0


def test_blocks_are_pruned():
    """Documents of one subject lie together; a query of another scores none of their blocks."""
    rng = random.Random(1)
    texts = [" ".join(f"s{i // 64}w{rng.randrange(50)}" for _ in range(40)) for i in range(1024)]
    texts = [f"{t} {'pad ' * (i // 64)}" for i, t in enumerate(texts)]
    terms = search.Terms([" ".join(texts[i].split()[:12]) for i in (0, 500, 1000)])
    rows = pa.RecordBatch.from_arrays([pa.array(range(1024)), pa.array(texts)], ["doc_id", "text"])
    groups = list(search._forward(terms)(iter([rows])))
    n = len(terms.keys)
    asked = [(np.array(list(q)), np.array([1000 * t for t in q.values()])) for q in terms.of]
    (visits,) = search._search(asked, [0] * 3, 1024, 50_000, n, 10, 32, visits=True)(iter(groups))
    assert all(v <= 4 for v in visits.column("doc_id").to_pylist()) and visits.column("score").to_pylist() == [32] * 3


# Hard negatives


def mined_brute(rows, p, n, near=80, scale=256):
    """rows: (vec_id, label, vector, anchor)"""
    fine = [(i, l, [math.floor(scale * float(x)) for x in v], a) for i, l, v, a in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (anchor, label, x, is_anchor) in enumerate(fine):
        if not is_anchor:
            continue
        scored = [(sum(u * w for u, w in zip(x, y, strict=True)), i, l) for b, (i, l, y, _) in enumerate(fine) if b != a and len(y) == len(x)]
        for ps, positive, _ in sorted([s for s in scored if s[2] == label], key=lambda s: key(s[0], s[1]))[:p]:
            found = [s for s in scored if s[2] != label and near * ps <= 100 * s[0] <= 100 * ps]
            out += [(anchor, positive, r + 1, i, ps, s) for r, (s, i, _) in enumerate(sorted(found, key=lambda s: key(s[0], s[1]))[:n])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaf", "per_block", "sample", "big"), [(128, None, 16, 1), (4, 7, 2, 1), (2, 3, 1, 2.0**16), (3, None, 3, 2.0**20)])
def test_negatives(spark, monkeypatch, leaf, per_block, sample, big):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    centres = rng.normal(size=(6, 4))
    rows = [(i, int(rng.integers(0, 3)), [float(x) * big for x in np.round(centres[i % 6] + rng.normal(size=4) / 4, 1)], i % 9 == 0) for i in range(200)]
    rows += [(300 + i, i % 3, rows[0][2], False) for i in range(20)]  # one vector many times
    rows += [rows[9], rows[9], rows[10], rows[0]]  # repeated rows, anchors among them
    rows += [(None, 1, rows[9][2], True), (None, 1, rows[3][2], None), (400, None, rows[3][2], True), (401, 1, None, True), (402, 1, [1.0, None, 1.0, 1.0], True), (403, 1, [1.0, float("nan"), 1.0, 1.0], False), (404, 1, [1.0, float("inf"), 1.0, 1.0], False)]
    rows += [(405, 1, [1.0, 2.0], True), (406, 1, [1.0, 1.5], False), (407, 2, [1.0, 1.4], False), (408, 1, [], True), (409, 1, [], False), (410, 2, [], False), (411, 0, [0.0] * 4, True), (412, 5, [1.0] * 4, True)]
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, label int, embedding array<double>, anchor boolean, rank int, slot int").repartition(3)
    got = negatives.mine(frame, "anchor", positives=3, negatives=4, anchors_per_block=per_block, sample=sample)
    assert sorted((tuple(r) for r in got.collect()), key=str) == mined_brute(rows, 3, 4)


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([(1, 1, [1.0], True)], "vec_id long, label int, embedding array<float>, anchor boolean")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for f in (frame, frame.where("false"), frame.selectExpr("vec_id", "label", "embedding", "false anchor")):
        out = negatives.mine(f, "anchor")
        assert out.columns == names and out.count() == 0
    huge = spark.createDataFrame([(i, 1, [1e300], True) for i in range(2)], "vec_id long, label int, embedding array<double>, anchor boolean")
    with pytest.raises(Exception, match="beyond 64 bits"):
        negatives.mine(huge, "anchor").collect()


def test_intervals_prune(monkeypatch):
    """Clustered vectors: whole groups of anchors are settled without a score, and nothing is lost."""
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(48, 16)) * 3
    x = np.floor(256 * (centres[np.arange(6000) % 48] + rng.normal(size=(6000, 16)) / 50))
    rows = negatives.Vectors(np.arange(6000), np.zeros(6000, bool), np.arange(6000) % 2, x)
    anchors = rows.only(np.arange(0, 6000, 10))
    for hunt in (negatives.Positives(anchors, np.full(600, negatives.ALWAYS), 6), negatives.Negatives(anchors, np.full(600, 10**6), np.full(600, 10**7), 5)):
        hunt.start()
        hunt.visit(rows)
        scored, left_out = hunt.visits
        assert left_out > scored
        s = (anchors.x @ x.T).astype(np.int64)
        same = anchors.label[:, None] == rows.label
        fits = same if isinstance(hunt, negatives.Positives) and not isinstance(hunt, negatives.Negatives) else ~same & (s >= 10**6) & (s <= 10**7)
        for a in range(0, 600, 37):
            want = sorted((-s[a, j], j) for j in np.flatnonzero(fits[a]))[: hunt.best.score.shape[1]]
            assert [(-v, i) for v, i in zip(hunt.best.score[a], hunt.best.id[a], strict=True) if v != negatives.ALWAYS] == want
