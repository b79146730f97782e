"""Language-model scores by deleted interpolation of n-gram estimates.

P(w | h) is a mixture of the maximum-likelihood estimates of order n..1 and
the uniform distribution; its weights depend on how often the context h was
seen (buckets of powers of two) and are learned by expectation-maximisation on
one tenth of the training documents, whose counts are left out for it. The
final counts are those of all training documents.

Texts become blocks of a few megabytes: the tokens of many documents as codes
into the block's own list of 64-bit n-gram keys. A block sends each distinct
key once, and no row per token is ever shuffled.

Counts are added in a tree. Nodes of level l stand for one of F^l ranges of the
key space and a group of F^l blocks; a node merges the F messages of its
children and sends its keys on, cut into F finer ranges. So every node holds
about as many keys as a block, a frequent word arrives F times at most, and
messages number F a node, whatever the size of the corpus. The counts come
back the same way. Up to FAN blocks, the tree is a single level.

Trigrams are counted after bigrams, and only those both of whose bigrams occur
twice or more: the others occur once in the corpus, where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .simhash import LOWER

TRAIN, DEV, HELD = 0, 1, 2
BLOCK_BYTES = 2_500_000
#: Children of a node of the counting tree at most.
FAN = 512
#: Bits by which keys are longer than the logarithm of the n-grams: one in 2^24 keys meets another by chance.
SPARE_BITS = 24
BUCKETS = 48
#: Steps per doubling in which probabilities are binned for expectation-maximisation.
STEPS = 4
EM_ROUNDS = 60
#: Tokens' worth of the overall weights that each bucket starts from.
PRIOR = 20.0
# Multipliers of the public 64-bit mixing function splitmix64.
GOLDEN, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * GOLDEN + b
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _tag(keys: np.ndarray, order: int, mask: int = ~3) -> np.ndarray:
    """The lowest two bits of a key tell its order; the mask clears those and all bits that keys need not have."""
    return (keys & np.uint64(mask & (1 << 64) - 1)) | np.uint64(order)


def _shut(values: np.ndarray) -> bytes:
    """Compressed, byte by byte of all values: the upper bytes of sorted keys, codes and counts are much alike."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _open(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _shut_counts(values: np.ndarray) -> bytes:
    """In as many bytes a count as the largest needs."""
    most = int(values.max()) if len(values) else 0
    size = next(n for n in (1, 2, 4, 8) if most >> 8 * n == 0)
    return bytes([size]) + _shut(values.astype(f"<u{size}"))


def _open_counts(blob: bytes) -> np.ndarray:
    return _open(blob[1:], np.dtype(f"<u{blob[0]}")).astype(np.uint64)


def ngram_keys(unigrams: np.ndarray, lengths: np.ndarray, order: int, mask: int = ~3) -> list[np.ndarray]:
    """Keys of the 1..order-grams that end at each token; documents are `lengths` tokens long."""
    starts = np.cumsum(lengths) - lengths
    keys = [_tag(unigrams, 1, mask)]
    for k in range(2, order + 1):
        before = np.roll(keys[-1], 1)
        before[starts] = np.uint64(4 * k)
        keys.append(_tag(_mix(before, keys[0]), k, mask))
    return keys


BLOCK = pa.schema([("block", pa.int64()), ("split", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("named", pa.binary()), ("lengths", pa.binary()), ("vocab", pa.binary()), ("codes", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    open_: dict[int, tuple[list, list, list, int]] = {s: ([], [], [], 0) for s in (TRAIN, DEV, HELD)}

    def close(split: int) -> pa.RecordBatch:
        nonlocal made
        docs, lengths, tokens, _ = open_[split]
        open_[split] = ([], [], [], 0)
        flat = np.empty(len(tokens), object)
        flat[:] = tokens
        codes, vocab = pd.factorize(flat)
        keys = _tag(np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab)), 1)
        made += 1
        row = [base | made, split, len(docs), len(tokens), np.array([d or 0 for d in docs], np.int64).tobytes(), np.array([d is not None for d in docs]).tobytes(), _shut(np.array(lengths, np.int64)), _shut(keys), _shut(codes.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

    for batch in batches:
        for i in range(batch.num_rows):
            split = batch.column(1)[i].as_py()
            data = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER)
            docs, lengths, tokens, size = open_[split]
            found = data.split()
            found.append(b"")  # the end
            docs.append(batch.column(0)[i].as_py())
            lengths.append(len(found))
            tokens += found
            open_[split] = (docs, lengths, tokens, size + len(data) + 64)
            if open_[split][3] >= BLOCK_BYTES:
                yield close(split)
    for split in (TRAIN, DEV, HELD):
        if open_[split][0]:
            yield close(split)


class Shape:
    """The model's order, the mask of its keys, and the tree that counts them."""

    def __init__(self, order: int, tokens: int, blocks: int):
        self.order, bits = order, min(62, max(1, order * tokens).bit_length() + SPARE_BITS)
        self.mask = ~((1 << (64 - bits)) - 1)
        self.levels = 1
        while FAN**self.levels < blocks:
            self.levels += 1
        self.fan = next(f for f in range(1, FAN + 1) if f**self.levels >= blocks)
        self.groups = [-(-blocks // self.fan**k) for k in range(self.levels + 1)]


class Block:
    """A block's tokens: document lengths, the keys of each order, the distinct ones of order 1 and 2, and where each is among them."""

    def __init__(self, row, shape: Shape):
        self.lengths = _open(row.lengths, np.int64)
        self.keys = ngram_keys(_open(row.vocab, np.uint64)[_open(row.codes, np.uint32)], self.lengths, shape.order, shape.mask)
        self.distinct, self.at = np.unique(np.concatenate(self.keys[:2]), return_inverse=True)
        self.split = row.split

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def open_trigrams(self, flagged: np.ndarray) -> np.ndarray:
        """Tokens whose trigram is to be counted; `flagged` is for `distinct` twice the count, plus one where the corpus has it once."""
        once = (flagged[self.at[len(self.keys[0]) :]] & np.uint64(1)).astype(bool)
        before = np.roll(once, 1)
        before[self.starts()] = False
        return ~(once | before)

    def counts(self, pairs: np.ndarray, triples: np.ndarray, flagged: np.ndarray, seen: int) -> list[np.ndarray]:
        """Counts of each token's n-grams, by order; trigrams that aren't counted occur here alone, `seen` times for the model."""
        out = [*pairs[self.at].reshape(min(2, len(self.keys)), -1)]
        if len(self.keys) == 3:
            counted = self.open_trigrams(flagged)
            own = np.full(len(counted), seen, np.uint64)
            own[counted] = triples[np.unique(self.keys[2][counted], return_inverse=True)[1]]
            out.append(own)
        return out


ASK = "rng long, child long, part long, keys binary, train binary, dev binary, held binary"
ANSWER = "child long, part long, rng long, total binary, fit binary"
_ASK, _ANSWER = ([c.split()[0] for c in x.split(", ")] for x in (ASK, ANSWER))


def _messages(keys: np.ndarray, counts: list[np.ndarray | None], child: int, part: int, ranges: int, sub: range) -> list[tuple]:
    """Sorted keys and their counts by split, cut into the ranges `sub` of all `ranges`."""
    cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(sub.start, sub.stop + 1))
    return [(sub[i], child, part, _shut(keys[a:b]), *(None if c is None else _shut_counts(c[a:b]) for c in counts)) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]


def _block_messages(keys: np.ndarray, at: np.ndarray, row, shape: Shape) -> pd.DataFrame:
    counts = np.bincount(at, minlength=len(keys)).astype(np.uint64)
    return pd.DataFrame(_messages(keys, [counts if row.split == s else None for s in (TRAIN, DEV, HELD)], row.block, 0, shape.fan, range(shape.fan)), columns=_ASK)


def _ask_pairs(shape: Shape):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                b = Block(row, shape)
                yield _block_messages(b.distinct, b.at, row, shape)

    return run


def _ask_triples(shape: Shape):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            b = Block(row, shape)
            keys = b.keys[2][b.open_trigrams(_answer(right, "total"))]
            out.append(_block_messages(*np.unique(keys, return_inverse=True), row, shape))
        return pd.concat(out) if out else pd.DataFrame(columns=_ASK)

    return run


def _answer(rows: pd.DataFrame, column: str) -> np.ndarray:
    parts = [_open_counts(x) for x in rows.sort_values("rng")[column]]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _merged(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of a node's messages: the keys of each, all distinct keys, and their counts by split."""
    asked = [_open(k, np.uint64) for k in pdf["keys"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    ends = np.cumsum([len(k) for k in asked])
    counts = []
    for column in ("train", "dev", "held"):
        total = np.zeros(len(keys), np.uint64)
        for blob, e, k in zip(pdf[column], ends, asked, strict=True):
            if blob is not None:
                total[at[e - len(k) : e]] += _open_counts(blob)  # the keys of one message are distinct
        counts.append(total)
    return asked, keys, counts


def _replies(pdf: pd.DataFrame, asked: list[np.ndarray], keys: np.ndarray, total: np.ndarray, fit: np.ndarray) -> pd.DataFrame:
    rows = []
    for r, k in zip(pdf.itertuples(index=False), asked, strict=True):
        at = np.searchsorted(keys, k)
        rows.append((r.child, r.part, r.rng, _shut_counts(total[at]), None if r.dev is None else _shut_counts(fit[at])))
    return pd.DataFrame(rows, columns=_ANSWER)


def _top(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts over all training blocks, and without those of the development tenth."""
    asked, keys, (train, dev, held) = _merged(pdf)
    total = train + dev
    out = _replies(pdf, asked, keys, total * np.uint64(2) + (total + held == 1), train)
    one = (keys & np.uint64(3)) == 1
    first = np.arange(len(out)) == 0
    return out.assign(types=np.where(first, (one & (total > 0)).sum(), 0), fit_types=np.where(first, (one & (train > 0)).sum(), 0))


def _up(shape: Shape, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, keys, counts = _merged(pdf)
        grp, rng = int(key[0]), int(key[1])
        counts = [c if c.any() else None for c in counts]
        rows = _messages(keys, counts, grp, rng, shape.fan ** (level + 1), range(rng * shape.fan, (rng + 1) * shape.fan))
        return pd.DataFrame(rows, columns=_ASK).assign(grp=grp % shape.groups[level + 1])

    return run


def _down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    asked, keys, (_, dev, _) = _merged(left)
    total = _answer(right, "total")
    return _replies(left, asked, keys, total, _answer(right, "fit") if dev.any() else total)


def _count(asks: DataFrame, shape: Shape) -> tuple[DataFrame, int, int]:
    """Answers to the blocks' messages, the distinct tokens of all training documents, and those without the development tenth."""
    node = ["grp", "rng"]
    levels = [asks.withColumn("grp", F.pmod(F.xxhash64("child"), F.lit(shape.groups[1])))]
    for level in range(1, shape.levels):
        levels[-1] = materialize(levels[-1])
        levels.append(levels[-1].groupBy(*node).applyInPandas(_up(shape, level), ASK + ", grp long"))
    answers = materialize(levels.pop().groupBy(*node).applyInPandas(_top, ANSWER + ", types long, fit_types long"))
    types = answers.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("t"), F.coalesce(F.sum("fit_types"), F.lit(0)).alias("f")).first()
    while levels:
        asked, above = levels.pop(), answers.select(*_ANSWER)
        new = materialize(asked.groupBy(*node).cogroup(above.groupBy("child", "part")).applyInPandas(_down, ANSWER))
        release(asked, answers)
        answers = new
    return answers, types["t"], types["f"]


class Stats:
    """Sizes of the training corpus: tokens, documents, and distinct tokens."""

    def __init__(self, tokens: int, docs: int, types: int):
        self.tokens, self.docs, self.types = tokens, docs, types


def _estimates(starts: np.ndarray, counts: list[np.ndarray], stats: Stats) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bucket of each token's context (BUCKETS: not even the token before is known), its estimates of order 1..n, and its own count."""
    by_order = [c.astype(np.float64) for c in counts]
    p, context, known = [by_order[0] / max(stats.tokens, 1)], np.full(len(by_order[0]), float(stats.tokens)), True
    for k in range(1, len(by_order)):
        context = np.roll(by_order[k - 1], 1)
        context[starts] = stats.docs
        p.append(np.divide(by_order[k], context, out=np.zeros_like(context), where=context > 0))
        if k < len(by_order) - 1:
            known = known & (context > 0)
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return np.where(known, bucket, BUCKETS), p, by_order[0]


def _with_counts(shape: Shape, stats: Stats, column: str, use, schema: list[str]):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        pairs, triples = right[right["size"] == 2], right[right["size"] == 3]
        flagged = _answer(pairs, "total")
        for row in left.itertuples(index=False):
            b = Block(row, shape)
            if column == "total":
                counts = b.counts(flagged >> np.uint64(1), _answer(triples, "total") >> np.uint64(1), flagged, int(b.split != HELD))
            else:
                counts = b.counts(_answer(pairs, "fit"), _answer(triples, "fit"), flagged, int(b.split == TRAIN))
            out.append(use(row, b.lengths, *_estimates(b.starts(), counts, stats)))
        return pd.concat(out) if out else pd.DataFrame(columns=schema)

    return run


def _bins(stats: Stats):
    """Tokens of the development tenth by bucket and binned estimates (relative to the uniform one)."""

    def use(row, lengths, bucket, p, own) -> pd.DataFrame:
        q = [np.where(x > 0, np.rint(STEPS * np.log2(np.maximum(x, 1e-300) * (stats.types + 1))), -9999).astype(np.int64) for x in p]
        frame = pd.DataFrame({"bucket": bucket} | {f"q{k}": x for k, x in enumerate(q, 1)})
        return frame.value_counts().rename("n").reset_index()

    return use


def learn_weights(bins: pd.DataFrame, order: int) -> np.ndarray:
    """Mixture weights [bucket, order 0..n] by expectation-maximisation; order 0 is uniform.

    In bucket 0 the context is new, so its highest order has no weight; in the
    last one no context at all is known, and only orders 0 and 1 have any. So
    the probabilities after every context add up to 1. Estimates were binned to
    quarters of a doubling, which moves each by 9 % at most and is all that the
    weights lose. Buckets lean on the weights of all tokens together until they have data.
    """
    q = bins[[f"q{k}" for k in range(1, order + 1)]].to_numpy(np.float64)
    p = np.column_stack([np.ones(len(q)), np.where(q <= -9999, 0.0, 2.0 ** (np.maximum(q, -4000) / STEPS))])
    n, bucket = bins["n"].to_numpy(np.float64), bins["bucket"].to_numpy(np.int64)

    def em(p: np.ndarray, n: np.ndarray, prior: np.ndarray | None) -> np.ndarray:
        w = np.full(order + 1, 1 / (order + 1)) if prior is None else prior.copy()
        for _ in range(EM_ROUNDS):
            r = p * w
            share = (r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300) * n[:, None]).sum(axis=0)
            share += 1e-3 if prior is None else PRIOR * prior
            w = share / share.sum()
        return w

    overall = em(p, n, None)
    out = np.empty((BUCKETS + 1, order + 1))
    for b in range(BUCKETS + 1):
        mine, prior = bucket == b, overall.copy()
        if b == 0 and order > 1:
            prior[-1] = 0
        elif b == BUCKETS:
            prior[2:] = 0
        prior /= prior.sum()
        out[b] = em(p[mine], n[mine], prior)
    return out


def _score(stats: Stats, weights: np.ndarray):
    def use(row, lengths, bucket, p, own) -> pd.DataFrame:
        starts = np.cumsum(lengths) - lengths
        w = weights[bucket]
        mixed = w[:, 0] / (stats.types + 1) + sum(w[:, k] * x for k, x in enumerate(p, 1))
        base = np.log10((own + 0.1) / (stats.tokens + 0.1 * (stats.types + 1)))
        per = lambda x: np.add.reduceat(x, starts)
        ids = pd.arrays.IntegerArray(np.frombuffer(row.docs, np.int64).copy(), ~np.frombuffer(row.named, bool))
        return pd.DataFrame({"doc_id": ids, "held_out": row.split == HELD, "n_tokens": lengths, "n_known": per((own > 0).astype(np.int64)), "train_tokens": stats.tokens, "base_score": per(base), "score": per(np.log10(mixed))})

    return use


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """Score every whole text by a model of all training texts.

    Held out are the rows whose crc32 of the id as text (null: empty) is
    divisible by ten; of the rest, remainder 1 is the development tenth that
    the weights are learned on. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score, one row for each input row. A null
    text is empty and has the end token alone; repeated rows count each time;
    an empty table gives an empty result; other columns are ignored.

    N-grams are told apart by SPARE_BITS bits of a hash more than their number
    has, 62 at most; `order` is at most 3.
    """
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    ident = F.col(f"`{id_col}`")
    tenth = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(10))
    split = F.when(tenth == 0, HELD).when(tenth == 1, DEV).otherwise(TRAIN)
    src = docs.select(ident.cast("long").alias("doc_id"), split.cast("int").alias("split"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = "block long, split int, n_docs long, n_tokens long, docs binary, named binary, lengths binary, vocab binary, codes binary"
    blocks = materialize(src.mapInArrow(_blocks, blocks))
    sizes = {r["split"]: r for r in blocks.groupBy("split").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("blocks")).collect()}
    tokens = lambda *s: sum(sizes[x]["tokens"] for x in s if x in sizes)
    n_docs = lambda *s: sum(sizes[x]["docs"] for x in s if x in sizes)

    shape = Shape(order, tokens(TRAIN, DEV, HELD), sum(r["blocks"] for r in sizes.values()))
    coded = blocks.select("block", "split", "lengths", "vocab", "codes")
    pairs, types, fit_types = _count(coded.mapInPandas(_ask_pairs(shape), ASK), shape)
    fit, full = Stats(tokens(TRAIN), n_docs(TRAIN), fit_types), Stats(tokens(TRAIN, DEV), n_docs(TRAIN, DEV), types)
    counted = pairs.withColumn("size", F.lit(2))
    if order == 3:
        asks = coded.groupBy("block").cogroup(pairs.groupBy("child")).applyInPandas(_ask_triples(shape), ASK)
        counted = counted.unionByName(_count(asks, shape)[0].withColumn("size", F.lit(3)), allowMissingColumns=True)
    counted = counted.select(F.col("child").alias("block"), "size", "rng", "total", "fit")

    def joined(where: list[int], column: str, stats: Stats, use, schema: str) -> DataFrame:
        left = blocks.where(F.col("split").isin(where)).select("block", "split", "docs", "named", "lengths", "vocab", "codes")
        right = counted.select("block", "size", "rng", "total", "fit" if column == "fit" else F.lit(None).cast("binary").alias("fit"))
        if column == "fit":  # only the development tenth asked for these
            right = right.where("fit is not null")
        names = [c.split()[0] for c in schema.split(", ")]
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(_with_counts(shape, stats, column, use, names), schema)

    names = [f"q{k}" for k in range(1, order + 1)]
    binned = joined([DEV], "fit", fit, _bins(fit), "bucket long, " + ", ".join(f"{q} long" for q in names) + ", n long")
    # Bins number in the thousands whatever the corpus: buckets times binned ratios.
    weights = learn_weights(binned.groupBy("bucket", *names).agg(F.sum("n").alias("n")).toPandas(), order)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined([TRAIN, DEV, HELD], "total", full, _score(full, weights), out)
