"""SimHash and embedding near-duplicates, and connected components, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from lakeloom.llm import components, embeddings, jaccard, simhash


class Forest:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, x):
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def brute_print(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "One", "a b c", "A b C d", "É ß one two three two one", "x y " * 9000, "the quick brown fox jumps over the lazy dog again and again"):
        assert simhash.fingerprint(text) == brute_print(text)


def links_brute(fp, radius=4):
    f = Forest(len(fp))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1:
            f.join(i, int(j))
    return [f.find(i) for i in range(len(fp))]


@pytest.mark.parametrize(("shard", "parts"), [(8192, None), (60, None), (8192, 6), (8192, 7)])
def test_simhash_links(spark, shard, parts):
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, 900, dtype=np.uint64)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    near = [flip(fp[rng.integers(0, 300)], int(rng.integers(1, 7))) for _ in range(600)]
    dense = [flip(fp[0], int(rng.integers(1, 9))) for _ in range(600)]  # one large group of near copies
    fp = np.unique(np.concatenate([fp, np.array(near + dense, np.uint64), [np.uint64(0), np.uint64(7)]]))
    frame = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)}))
    edges = simhash.links(frame, shard=shard, parts=parts)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    want, names = links_brute(fp), {}
    for x, c in zip(fp.view(np.int64).tolist(), want, strict=True):
        assert names.setdefault(got.get(x, x), c) == c
    assert len(names) == len(set(want))


def test_roots_stay_small():
    assert [simhash.parts_for(n, 4) for n in (0, 10**6, 10**8, 10**10)] == [5, 5, 6, 7]


def test_vantage_point_trees_prune():
    """A shard of scattered and of clustered fingerprints: the tree is built, rules pairs out, and finds all links."""
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**64, 12, dtype=np.uint64)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    fp = np.unique(np.concatenate([rng.integers(0, 2**64, 300, dtype=np.uint64), [flip(c, int(rng.integers(0, 5))) for c in centre.repeat(40)]]))
    links = simhash._Links(fp, 4)
    links.within(np.arange(len(fp)))
    assert links.vantage > 20 and links.ruled_out > 0.1 * len(fp) ** 2 / 2
    want = links_brute(fp)
    assert len(np.unique(links.root)) == len(set(want)) and all((links.root[i] == links.root[j]) == (want[i] == want[j]) for i in range(0, len(fp), 7) for j in range(len(fp)))


def test_simhash_rows(spark):
    text = "the of and to in a is that for it was on are as with"
    rows = [(5, text, 1), (3, text.upper(), 1), (9, None, 1), (8, "", 1), (8, "", 1), (None, text, 1), (7, "quite another text " * 40, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 8, 8), (False, 8, 8), (False, 9, 8), (True, 0, 3)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(7, 7)]
    f = Forest(2300)
    for a, b in edges:
        f.join(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: f.find(n) for e in edges for n in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("block", "cells"), [(None, 512), (100, 16)])
def test_embedding_links(spark, block, cells, monkeypatch):
    monkeypatch.setattr(embeddings, "CELLS", (cells, cells))
    monkeypatch.setattr(embeddings, "LEAF", 20)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 8))
    x = np.concatenate([rng.normal(size=(300, 8)), centre.repeat(50, 0) + rng.normal(size=(600, 8)) * 0.12, centre[:1].repeat(40, 0), 3 * centre[:2]])
    rows = [(i * 7 % 1009, v.tolist(), "c") for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")]]
    rows += [(2000 + i, v, "c") for i, v in enumerate(bad)] + [(3000, [1.0, 2.0], None), (3001, [2.0, 4.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    ids, f = [r[0] for r in rows[: len(x)]], Forest(len(x))
    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        f.join(int(i), int(j))
    least = {}
    for i, v in enumerate(ids):
        least[f.find(i)] = min(v, least.get(f.find(i), v))
    for i, v in enumerate(ids):
        c = least[f.find(i)]
        assert got[v] == (int(hit[i].sum()) - 1, c, v == c)
    assert all(got[2000 + i] == (0, 2000 + i, True) for i in range(len(bad)))
    assert got[3000] == (1, 3000, True) and got[3001] == (1, 3000, False)


def test_cover_tree_settles_pairs_by_bounds():
    """In tight clusters, far nodes are ruled out and near ones counted whole: few of all pairs are compared."""
    rng = np.random.default_rng(4)
    x = embeddings.unit(rng.normal(size=(20, 16)).repeat(300, 0) + rng.normal(size=(6000, 16)) * 0.01)
    pairs, compared = embeddings.Pairs(x, np.ones(len(x), np.int64), 0.95), []
    plain = pairs._compare
    pairs._compare = lambda p, q, same: (compared.append(len(p) * len(q)), plain(p, q, same))
    top = embeddings.tree(x, np.arange(len(x)))
    pairs.traverse(top, top)
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert (pairs.n == want).all() and len(np.unique(pairs.root)) == 20
    assert sum(compared) < 0.02 * len(x) ** 2


def test_embeddings_of_single_precision(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(100, 24)).astype(np.float32)
    x = np.concatenate([base, base + rng.normal(size=base.shape).astype(np.float32) * 0.3]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and 10 < sum(want) < 400


def test_embedding_edges(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == [(0, 2, 4, False), (1, 0, 1, True), (4, 2, 4, True), (4, 2, 4, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def word_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [256, 20])
def test_jaccard_components(spark, block):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [text(rng.randint(1, 120)) for _ in range(150)]
    for base in [r for r in rows if len(r) > 20] + [text(100)] * 60:  # edits to both sides of 0.8, and one large group
        new = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 30))):
            new[rng.randrange(len(new))] = rng.choice(vocab)
        rows.append(new[: len(new) - rng.randint(0, 4)])
    texts = [" ".join(r) for r in rows] + [None, "", " ", " ".join(rows[30]).upper()]
    sets, f = [word_sets(t) for t in texts], Forest(len(texts))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                f.join(i, j)
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4
    assert far > 50  # most links are beyond the reach of op8's radius
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, block=block).collect()}
    assert got == {i: f.find(i) for i in range(len(texts))}
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    edited = [("new" if i in (40, 90, 150) else w) for i, w in enumerate(words)]  # Jaccard 181 / 211
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "other words " * 40)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]
