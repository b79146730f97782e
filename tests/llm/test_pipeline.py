"""The pipeline's stages against plain Python, and the registered queries."""

import math
import random
import re

import pytest

from lakeloom.llm import queries

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from .test_lines import brute as brute_lines  # noqa: E402
from .test_near_duplicates import Forest, word_sets  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rng = random.Random(11)
    vocab = "the of and to in a is that for it house river stone bright walks under table morning letter winter garden".split()
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = line(60)
    texts = ["\n".join(line(rng.randint(12, 40)) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " extra", shared + "\n" + line(30), line(20) + "\n" + shared, "*** ### $$$ %%% " * 20, "short", None, ""]
    return [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    step = lambda name, d: stage[name](spark, d, str(tmp_path))

    one = step("quality_rules", df)
    assert one.columns == COLUMNS
    kept = {r.doc_id: r.text for r in one.collect()}
    assert {i for i, *_ in docs} - set(kept) == {i for i, t, *_ in docs if not t or t == "short" or "***" in t}

    two = step("line_dedup", one)
    assert two.columns == COLUMNS
    gone = brute_lines(list(kept.items()), 10)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in kept.items()}
    want = {i: t for i, t in want.items() if re.search(r"[^\x20\x09-\x0d]", t) or not gone[i]}
    assert {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == {i: (t, len(t)) for i, t in want.items()}

    three = step("near_dedup", two)
    ids, f = sorted(want), Forest(1000)
    sets = {i: word_sets(want[i]) for i in ids}
    for i in ids:
        for j in ids:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                f.join(i, j)
    assert three.columns == COLUMNS and {r.doc_id for r in three.collect()} == {f.find(i) for i in ids}

    four = step("mix_sources", three)
    assert four.columns == COLUMNS
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    total = size(three.collect())
    for k, s in enumerate(["s0", "s1", "s2", "s3"]):
        target = total * [5, 2, 1, 5][k] / 13
        own = size([r for r in three.collect() if r.source == s])
        assert abs(size([r for r in four.collect() if r.source == s]) - min(3 * own, target)) < 300

    twice = step("near_dedup", three.unionByName(three.limit(3)))
    assert sorted(map(str, twice.collect())) == sorted(map(str, three.collect()))

    five = step("pack_sequences", four).collect()
    assert sum(r.length for r in five if r.start == 0) > 0
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(last) == key(five)
    assert math.isclose(sum(r.length for r in last), sum(r.length for r in five))


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, repeats string, _d int, _h int, row string, d string, removed_lines string, `a.b` int, id int, hash int"


def test_stages_with_clashing_columns_long_texts_and_nulls(spark, tmp_path):
    rng = random.Random(4)
    long = "\n".join(" ".join(rng.choice(["the", "of", "river", "stone", "morning", "letter"]) + str(rng.randrange(10**6)) * (rng.random() < 0.7) for _ in range(25)) for _ in range(4000))
    one = " ".join(f"the stone{i} of" for i in range(30))
    rows = [(1, long, "en", "a", 0), (2, one, "en", "b", 0), (2, one, "en", "b", 0), (3, None, None, None, None), (None, " ".join(f"and water{i} to" for i in range(40)), "en", None, 0), (5, "", "en", "a", 0), (6, one + " more", "en", "a", 0)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z", "w", 7, 8, 9) for r in rows], EXTRA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df.write.parquet(str(tmp_path / name))
        df = stage(spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
        assert df.columns == [c.split()[0].strip("`") for c in EXTRA.split(", ")]
        assert all(r["repeats"] == "x" and r["_d"] == 1 and r["a.b"] == 7 and r["id"] == 8 for r in df.collect())
        if name == "near_dedup":
            assert sorted((r.doc_id or 0, len(r.text)) for r in df.collect()) == [(0, len(rows[4][1])), (1, len(long)), (2, len(one))]
    assert {r.doc_id for r in df.collect()} <= {1, 2, None}
    assert corpus_pipeline.pack_sequences(spark, df, "").count() > 0


def test_stages_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], EXTRA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0


def test_every_query_has_a_name():
    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in queries.QUERIES) != 1] == []
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
