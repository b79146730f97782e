"""Cost-balanced packing of token streams into fixed-length sequences.

A piece of n tokens costs n + QUADRATIC * n * n (linear layers and attention
within the piece). Documents are first cut into whole sequences; what remains
of each is assigned, in descending cost, to the sequence of lowest cost that
still has room. A piece that fits nowhere is cut to fill the gap, so that a
group of sequences leaves less than one sequence of padding.

Pieces are dealt to groups by the number of their task and their place in it,
so that rows of equal ids and texts part too; a task that runs again numbers
the same rows alike. Groups of about GROUP_TOKENS tokens are packed
independently: their number grows with the corpus, their size does not, and
the pieces of one very long document are dealt over many groups.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
QUADRATIC = 1 / 4096
GROUP_TOKENS = 1 << 20
#: Words whose token ids each Python worker keeps from task to task: half of them new, half the generation before, of which those seen again move on.
CACHE_WORDS = 800_000
#: Words of Latin script, lines among them, on whose character classes both tokenizer libraries agree.
LATIN = re.compile(r"[\n!-~\u00a1-\u024f]+")
#: Words on which the quick encoder must agree with `tokenizers` before it is used.
PROBE = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))] + ["it's", "don't,", "we'll", "1,234.5", "naïve", "Straße", "½x²", "https://a.example/b?c=d", "foo_bar", "***###", "ALLCAPS", "x" * 40, "end.\nNext", "a\n\nb", "x\n\n\n1"]


class WordTokenizer:
    """Ids of a byte-level BPE tokenizer, encoding each distinct ' word' once.

    The pre-tokenizer of byte-level BPE starts a new piece at every space
    between two non-space characters, so the ids of a text are those of its
    space-separated words, each with its space. Texts in which a space meets
    other white space, or which hold an added token such as <|endoftext|>
    (`tokenizers` cuts texts at those first), are encoded as a whole by
    `tokenizers`.

    `ranks_path` is an optional quick way to fill that cache: the same
    vocabulary in tiktoken's form encodes new words of Latin script in a third
    of the time. At the start both encode PROBE; if any id differs,
    `tokenizers` encodes all words.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            same = all(fast.encode_ordinary(" " + w) == self.tokenizer.encode(" " + w, add_special_tokens=False).ids for w in PROBE)
            self.fast = fast if same else None
        self.known = _Words(self._ids)

    def _ids(self, word: str) -> bytes:
        if self.fast and (word.isascii() and word.isprintable() or LATIN.fullmatch(word)):
            return array("I", self.fast.encode_ordinary(" " + word)).tobytes()
        return array("I", self.tokenizer.encode(" " + word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            self.known.turn()
            first, *rest = [t] if any(x in t for x in self.added) else t.split(" ")
            tail = b""
            if rest:
                try:
                    if not first or first[-1].isspace():
                        raise LookupError(first)
                    tail = b"".join(map(self.known.__getitem__, rest))
                except LookupError:
                    first = t
            head = self.tokenizer.encode(first, add_special_tokens=False).ids
            out.append(np.frombuffer(array("I", head).tobytes() + tail, np.uint32))
        return out


class _Words(dict):
    """Ids of words, learned when first asked for; words with white space at an end, next to which texts can't be cut, are a LookupError."""

    def __init__(self, ids: Callable[[str], bytes]):
        super().__init__()
        self.ids, self.before = ids, {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            if not word or word.strip() != word:
                raise LookupError(word)
            found = self.ids(word)
        self[word] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHE_WORDS // 2:
            self.before = dict(self)
            self.clear()


@cache
def _tokenizer(path: str, ranks_path: str | None, pattern: str | None) -> WordTokenizer:
    """One for each Python worker, which keeps what it has learned."""
    return WordTokenizer(path, ranks_path, pattern)


def _pieces(path: str, ranks_path: str | None, pattern: str | None, end_id: int) -> callable:
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()), ("spread", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import xxhash
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made, task = 0, TaskContext.get().partitionId()
        tok = _tokenizer(path, ranks_path, pattern)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # Some megabytes of text at a time, however long the documents are.
                to, chars, texts = at, 0, []
                while to < batch.num_rows and (chars < 2_000_000 or to == at):
                    texts.append(batch.column(1)[to].as_py() or "")
                    chars += len(texts[-1])
                    to += 1
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0)[at:to].to_pylist(), tok.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for s in range(0, len(ids), SEQUENCE):
                        part = ids[s : s + SEQUENCE].astype("<u4").tobytes()
                        n = len(part) // 4
                        # The ids travel only with pieces that may be cut again.
                        rows.append((doc, len(ids), s, n, zlib.crc32(part), None if n == SEQUENCE else part, xxhash.xxh64_intdigest(b"%d:%d" % (task, made)) >> 1))
                        made += 1
                    if len(rows) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                at = to

    return run


def assign(lengths: list[int], capacity: int = SEQUENCE, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(item, start in item, length, sequence) for items of the given lengths, each at most `capacity`.

    Items go in descending cost to the lowest-cost sequence with room; the
    number of sequences is the least that holds all tokens. An item that fits
    in none fills the roomiest one and its rest is queued again.
    """
    total = sum(lengths)
    k = -(-total // capacity)
    cost, room = np.zeros(k), np.full(k, capacity)
    queue = sorted(((n, i, 0) for i, n in enumerate(lengths) if n), key=lambda x: (-x[0], x[1]))
    out, later = [], []
    while queue or later:
        if not queue:
            queue, later = sorted(later, key=lambda x: (-x[0], x[1])), []
        rest = []
        for n, i, s in queue:
            fits = room >= n
            if fits.any():
                q, take = int(np.where(fits, cost, np.inf).argmin()), n
            else:
                q = int(room.argmax())
                take = int(room[q])
            out.append((i, s, take, q))
            cost[q] += take + quadratic * take * take
            room[q] -= take
            if take < n:
                rest.append((n - take, i, s + take))
        queue, later = [], rest
    return out


def _pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "start", "crc"], kind="stable", ignore_index=True)
    whole = pdf[pdf["length"] == SEQUENCE]
    part = pdf[pdf["length"] < SEQUENCE]
    group = int(key[0])
    cols = ["doc_id", "doc_tokens", "start", "length", "crc"]
    rows = [(*r, group << 32 | i, 0) for i, r in enumerate(whole[cols].itertuples(index=False, name=None))]
    fill: dict[int, int] = {}
    part_rows = list(part[cols].itertuples(index=False, name=None))
    blobs = list(part["ids"])
    for i, s, n, q in assign([r[3] for r in part_rows]):
        doc, tokens, start, length, crc = part_rows[i]
        if n < length:
            crc = zlib.crc32(blobs[i][4 * s : 4 * (s + n)])
        rows.append((doc, tokens, start + s, n, crc, group << 32 | len(whole) + q, fill.get(q, 0)))
        fill[q] = fill.get(q, 0) + n
    out = pd.DataFrame(rows, columns=[*cols, "sequence_id", "offset"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out.rename(columns={"crc": "ids_crc32"})


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack every document, its token ids followed by `end_id`, into sequences of at most 1024 tokens.

    Returns one row for each piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. A null or empty text is the end id alone;
    null ids and repeated rows keep their own pieces; an empty table gives an
    empty result; other columns are ignored. The tokenizer file is read by
    every executor from `tokenizer_path`.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # About three bytes make a token; only the number of groups depends on it.
    size = src.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, ((size["b"] or 0) // 3 + size["n"]) // group_tokens)
    pieces = src.mapInArrow(_pieces(tokenizer_path, ranks_path, pattern, end_id), "doc_id long, doc_tokens long, start long, length long, crc long, ids binary, spread long")
    grouped = pieces.withColumn("group", F.pmod("spread", F.lit(groups))).drop("spread")
    out = grouped.groupBy("group").applyInPandas(_pack_group, "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
