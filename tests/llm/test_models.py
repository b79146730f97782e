"""Language-model scores, packing and mixing."""

import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import lm, mixing, packing

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(9)
    vocab = [f"W{i}é" if i % 5 else f"w{i}" for i in range(60)]
    docs = []
    for i in range(200):
        w, text = rng.randrange(60), []
        for _ in range(rng.randint(0, 60)):
            text.append(vocab[w])
            w = (w * 7 + rng.randrange(3)) % 60
        docs.append((i, " ".join(text)))
    return [*docs, (5, docs[5][1]), (None, "null id"), (300, None), (301, ""), (302, "z" * 60000), (303, "w1\tw2\nw3 " * 4000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 5000)
    docs = corpus()
    got = lm.score(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int"), order=order).collect()
    assert len(got) == len(docs)
    toks = [[*WORD.findall((t or "").translate(LOWER)), ""] for _, t in docs]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i, _ in docs]
    c = Counter(x for t, h in zip(toks, held, strict=True) if h for x in t)
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for (i, _), t, h in zip(docs, toks, held, strict=True):
        want[i].append((h == 0, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)))
    for r in got:
        w = want[r.doc_id].pop()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 1e-9
    if order == 2:
        test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
        assert sum(r.score for r in test) > sum(r.base_score for r in test)


def plain_em(bins, order):
    """Expectation-maximisation over {(bucket, binned estimates): tokens}, in plain loops."""

    def run(rows, prior, pull):
        w = list(prior)
        for _ in range(60):
            share = [pull * x for x in prior] if pull else [1e-3] * (order + 1)
            for p, n in rows:
                all_ = sum(x * y for x, y in zip(p, w, strict=True))
                for k in range(order + 1):
                    share[k] += n * p[k] * w[k] / all_
            w = [x / sum(share) for x in share]
        return w

    rows = [(k[0], [1.0, *(0.0 if q <= -9999 else 2 ** (q / 4) for q in k[1:])], n) for k, n in bins.items()]
    overall = run([r[1:] for r in rows], [1 / (order + 1)] * (order + 1), 0)
    part = lambda w: [x / sum(w) for x in w]
    new, blind = part([*overall[:-1], 0.0]) if order > 1 else overall, part([*overall[:2], *[0.0] * (order - 1)])
    return {b: run([r[1:] for r in rows if r[0] == b], new if b == 0 else blind if b == 48 else overall, 20.0) for b in range(49)}


@pytest.mark.parametrize(("order", "fan"), [(2, 512), (3, 512), (3, 3), (2, 2)])
def test_score_is_a_mixture_of_count_ratios(spark, order, fan, monkeypatch):
    """Scores and weights by plain counting; small fans make the counting tree several levels deep."""
    monkeypatch.setattr(lm, "FAN", fan)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2500)
    docs = [*corpus()[:200], (400, None), (410, "w1"), (420, "w1 w1 w1 w1")]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), order=order).collect()}
    toks = {i: [*WORD.findall((t or "").translate(LOWER)), ""] for i, t in docs}
    tenth = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in docs}

    def counts(keep):
        c, starts = Counter(), 0
        for i, t in toks.items():
            if keep(tenth[i]):
                padded = [None] * (order - 1) + t
                for k in range(1, order + 1):
                    c.update(tuple(padded[j - k + 1 : j + 1]) for j in range(order - 1, len(padded)))
                starts += 1
        return c, starts, sum(n for g, n in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def rows(t, model):
        c, starts, n, v = model
        padded = [None] * (order - 1) + t
        for j in range(order - 1, len(padded)):
            grams = [tuple(padded[j - k + 1 : j + 1]) for k in range(1, order + 1)]
            context = [n, *(starts if not any(g[:-1]) and None in g[:-1] and set(g[:-1]) == {None} else c[g[:-1]] for g in grams[1:])]
            yield 48 if 0 in context[1:-1] else min(int(math.log2(context[-1] + 1)), 47), [c[g] / x if x else 0 for g, x in zip(grams, context, strict=True)], v

    fit = counts(lambda k: k > 1)
    q = lambda p, v: round(4 * math.log2(p * (v + 1))) if p else -9999
    weights = plain_em(Counter((b, *(q(x, v) for x in p)) for i, t in toks.items() if tenth[i] == 1 for b, p, v in rows(t, fit)), order)
    full = counts(lambda k: k > 0)
    for i, t in toks.items():
        want = sum(math.log10(weights[b][0] / (v + 1) + sum(w * x for w, x in zip(weights[b][1:], p, strict=True))) for b, p, v in rows(t, full))
        assert math.isclose(got[i], want, rel_tol=1e-9), (i, got[i], want)
    # After any context the vocabulary and the unknown word have a probability of 1 together.
    vocabulary = [g[0] for g in full[0] if len(g) == 1]
    for context in ([], ["w0"], ["never"], ["never", "w0"], ["w0", "never"], ["never", "ever"], toks[3][:1], toks[4][:2], ["w5", "w5"]):
        total = 0.0
        for w in [*vocabulary, "no such word"]:
            *_, (b, p, v) = rows([*context, w], full)
            total += weights[b][0] / (v + 1) + sum(x * y for x, y in zip(weights[b][1:], p, strict=True))
        assert math.isclose(total, 1, rel_tol=1e-9), (context, total)


def test_counting_tree_is_bounded():
    """A node has at most FAN children, and the levels make up for it."""
    for blocks in (1, 2, 511, 512, 513, 20_000, 40_000_000):
        shape = lm.Shape(3, blocks * 400_000, blocks)
        assert shape.fan <= lm.FAN and shape.fan**shape.levels >= blocks and shape.groups[-1] == 1
        assert shape.levels == 1 or lm.FAN ** (shape.levels - 1) < blocks


def test_scores_of_nothing(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


ODD = ["", " ", "a  b", " a", "a ", "x\n\ny z\n w", "a \n b", "x y あz  q", "tab\t x", "it's don't we'll", "a\xa0 b", "<|endoftext|> x <|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>b c", "naïve Straße ½ ² ª \u0301x", "\x1c y\x85 z", "日本 語 ǆ ȯ Ж"]


@pytest.mark.parametrize("fast", [True, False])
def test_word_tokenizer(fast, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    own = packing.WordTokenizer(P.path("byte_bpe_50k.json"), *((P.path("byte_bpe_50k.tiktoken"), P.PATTERN) if fast else ()))
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcé ,.!1\n\n\tß'sあ ") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == want
    assert own.encode(["x <|endoftext|> y"])[0].tolist() == [87, 220, 50256, 331]


def test_quick_encoder_is_dropped_where_it_differs(tmp_path):
    """A vocabulary file with two ids exchanged isn't used."""
    raw = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    rows = dict(x.split() for x in raw.splitlines())
    a, b = base64.b64encode(b" A"), base64.b64encode(b" B")
    rows[a], rows[b] = rows[b], rows[a]
    (tmp_path / "other").write_bytes(b"\n".join(b" ".join(x) for x in rows.items()))
    own = packing.WordTokenizer(P.path("byte_bpe_50k.json"), str(tmp_path / "other"), P.PATTERN)
    assert own.fast is None and own.encode(["a b! c"])[0].tolist() == tokenizer().encode("a b! c").ids


@pytest.mark.parametrize("group", [packing.GROUP_TOKENS, 4000])
def test_packing_round_trip(spark, group):
    rng = random.Random(8)
    texts = [*ODD, None, *(" ".join(rng.choice(["alpha", "Beta,", "gamma", "δelta"]) for _ in range(rng.choice([1, 30, 400, 3000]))) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, group_tokens=group).collect()
    t = tokenizer()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += 1024
    used = sum(map(len, ids.values()))
    assert total - used < 1024 * max(1, used // group + 1)
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or 0, r.length, r.offset) for r in rows) == [(0, 3, 6), (1, 3, 0), (1, 3, 3)]


def test_packing_spreads_equal_rows(spark):
    docs = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'same text' text")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, group_tokens=10_000)
    per = [r["n"] for r in rows.groupBy((F.col("sequence_id") / 2**32).cast("long")).agg(F.sum("length").alias("n")).collect()]
    assert sum(per) == 300_000 and len(per) > 20 and max(per) < 4 * 300_000 / len(per)


def test_packing_very_long_text(spark):
    text = "word " * 400_000 + "<|endoftext|>"
    rows = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), P.path("byte_bpe_50k.json"), group_tokens=50_000).collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens == len(tokenizer().encode(text, add_special_tokens=False).ids) + 1


def test_assign_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randint(1, 1024) for _ in range(300)]
    got = packing.assign(lengths)
    fill, parts = Counter(), defaultdict(int)
    for i, _, n, q in got:
        fill[q] += n
        parts[i] += n
    assert max(fill.values()) <= 1024 and len(fill) == -(-sum(lengths) // 1024)
    assert all(parts[i] == n for i, n in enumerate(lengths))


def test_water_fill_and_flow():
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [5, 2]) == [0, 0]
    got = mixing.water_fill([10, 100, 1000], [5, 2, 1])
    assert got[0] == 30 and math.isclose(sum(got), 1110) and all(t <= 3 * s for t, s in zip(got, [10, 100, 1000], strict=True))
    # One pattern counts for both sources; each source reaches its quota at the least repetition.
    flow = mixing.min_cost_flow({"a": 10, "b": 10, "ab": 20}, {"x": 25, "y": 15}, {"a": "x", "b": "y", "ab": "xy"})
    assert math.isclose(sum(flow.values()), 40) and sum(v for (_, r), v in flow.items() if r) < 1e-6


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None if i % 50 == 0 else f"s{min(i % 9, 4)}", 3) for i in range(4000)]
    rows += [(9000, None, "s1", 3), (9001, "w " * 3000, "only", 3), (7, rows[7][1], rows[7][2], 3), (None, "w w", "s0", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    src = {(i, len((t or "").split())): s for i, t, s, _ in rows}
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        s = src[r.doc_id, r.size]
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
        size[s] += r.size
        target[s] = (r.source_size, r.target)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill([size[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert target[s][0] == size[s] and math.isclose(target[s][1], t)
        assert abs(taken[s] - t) <= 20
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["b"], ["a", "b"], None][i % 4]) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 400 and abs(sum(r.taken for r in got) - 4000) <= 40


def test_mix_skips_what_does_not_fit(spark):
    """Many short documents and a very long one: the rest of each target is filled past the long one, wherever the order puts it."""
    for seed in range(3, 9):
        rows = [(i, "w " * 100, "b") for i in range(300)] + [(999, "w " * 20000, "b"), (1000, "w " * 60000, "a")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mix(docs, weights=(1, 1), seed=seed).where("doc_id < 1000")
        r = got.groupBy().sum("taken").first()[0], got.first()["target"]
        assert abs(r[0] - r[1]) <= 0.005 * r[1], (seed, r)
        assert got.where("repeats > 3").count() == 0


def test_default_order_counts_trigrams(spark):
    """After "a b" comes c, after "x b" comes d: only trigrams tell them apart."""
    texts = ["a b c", "x b d"] * 150
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = lm.score(docs).where("held_out").groupBy().avg("score").first()[0]
    assert got > lm.score(docs, order=2).where("held_out").groupBy().avg("score").first()[0] + 0.2


def test_mix_of_very_long_texts(spark):
    """Two million words in one text; it is used whole or not at all."""
    rows = [(1, "word " * 2_000_000, "a"), (2, "w\n" * 1_500_000, "a"), *[(10 + i, "w " * 1000, "b") for i in range(50)]]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[1]["size"], got[2]["size"], got[1].source_size) == (2_000_000, 1_500_000, 3_500_000)
    assert got[1].taken % 2_000_000 == 0 and got[2].taken % 1_500_000 == 0
    # Source b is used up three times over; a takes the rest, as near as whole texts get.
    assert sum(got[10 + i].taken for i in range(50)) == 150_000 and abs(got[1].taken + got[2].taken - got[1].target) <= 1_500_000
