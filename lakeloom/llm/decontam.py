"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams.

Windows of n words of the benchmark items (an item of fewer words is one
window) make a sorted set of 64-bit keys beside the items' words. It is
broadcast, and each task slides over the words of its documents: a bit table
drops nearly all windows, the key set the others, and every hit is verified
against the words themselves, so no key collision reaches the result.

What is broadcast is bounded: items are cut into pieces that overlap by n - 1
words, and pieces beyond BLOCK characters go to further sets, each with a pass
of its own over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import UPPER, let, materialize, release

WINDOW = 10
#: Characters of benchmark words in one broadcast set: at 36 bytes a window and 64 MB of bit table, 220 MB at most.
BLOCK = 1 << 23
#: Windows of a piece of an item.
PIECE = 4096


class Index:
    """The distinct windows of some pieces of items, in the order of their keys."""

    def __init__(self, names: list[str | None], texts: list[str], n: int):
        """`texts[i]` is a piece of the item `names[i]`."""
        self.names = list(dict.fromkeys(names))
        number = {x: k for k, x in enumerate(self.names)}
        of = np.array([number[x] for x in names], np.int32)
        self.text, parts = b"", {}
        for w in tokens.split(pa.array(texts, pa.large_string())):
            keys, count = w.keys(), w.count()
            for size in np.unique(np.minimum(count, n)[count > 0]).tolist():
                k, whole = w.windows(keys, size)
                # A text of fewer than n words is one window.
                at = np.flatnonzero(whole & (np.minimum(count, n) == size)[w.row[: len(whole)]])
                start, stop = w.start[at], w.start[at + size - 1] + w.length[at + size - 1]
                parts.setdefault(size, []).append((k[at], start + len(self.text), stop + len(self.text), of[w.lo + w.row[at]]))
            self.text += w.text
        self.sizes = {size: self._table(*map(np.concatenate, zip(*found, strict=True))) for size, found in sorted(parts.items())}

    def _table(self, key: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray) -> tuple:
        """Keys, a table of their leading bits, where the windows are in the text, and the items of each: where they begin, and all."""
        order = np.argsort(key, kind="stable")
        key, start, stop, item = key[order], start[order], stop[order], item[order]
        # Windows that differ but share a key stand beside each other.
        rank, seen = np.zeros(len(key), np.int32), {}
        for i in np.flatnonzero(key[1:] == key[:-1]).tolist():
            if not seen or key[i] != last:
                seen, last = {self.text[start[i] : stop[i]]: 0}, key[i]
            rank[i + 1] = seen.setdefault(self.text[start[i + 1] : stop[i + 1]], len(seen))
        order = np.lexsort((item, rank, key))
        key, start, stop, item, rank = key[order], start[order], stop[order], item[order], rank[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])]
        pair = new | np.r_[True, item[1:] != item[:-1]]
        begin = np.r_[np.searchsorted(np.flatnonzero(pair), np.flatnonzero(new)), pair.sum()]
        bits = min(26, max(12, int(new.sum()).bit_length() + 4))
        may = np.zeros(1 << bits, bool)
        may[key >> np.uint64(64 - bits)] = True
        return key[new], bits, may, start[new], stop[new], begin, item[pair]

    def hits(self, w: tokens.Words) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each window size: the words at which windows begin, and which windows."""
        words = w.keys()
        for size, (keys, bits, may, start, stop, _, _) in self.sizes.items():
            k, whole = w.windows(words, size)
            at = np.flatnonzero(may[k >> np.uint64(64 - bits)] & whole)
            place = np.searchsorted(keys, k[at])
            known = place < len(keys)
            known[known] = keys[place[known]] == k[at[known]]
            found = []
            for i, p in zip(at[known].tolist(), place[known].tolist(), strict=True):
                text = w.run(i, size)
                while p < len(keys) and keys[p] == k[i]:
                    if self.text[start[p] : stop[p]] == text:
                        found.append((i, p))
                        break
                    p += 1
            if found:
                i, p = np.array(found).T
                yield i, p, size

    def items(self, size: int, row: np.ndarray, window: np.ndarray) -> set[tuple[int, str | None]]:
        """Rows and names of the items of their windows."""
        *_, begin, item = self.sizes[size]
        row, window = np.unique(np.stack([row, window]), axis=1)
        return {(r, self.names[x]) for r, p in zip(row.tolist(), window.tolist(), strict=True) for x in item[begin[p] : begin[p + 1]].tolist()}


def _stretches(mark: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of marked words in one text."""
    on = np.flatnonzero(mark)
    cut = np.flatnonzero(np.r_[True, (np.diff(on) > 1) | (np.diff(row[on]) > 0), True]) if len(on) else np.zeros(1, np.int64)
    return on[cut[:-1]], on[cut[1:] - 1]


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values of rows in order as one list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = "n_words long, n_hit long, items array<string>, words array<struct<start: long, end: long>>, spans array<struct<start: long, end: long>>"


def _spans(start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], fields=list(SPAN))


def _match(index: Index, w: tokens.Words, before: pa.RecordBatch | None) -> list[pa.Array]:
    """The columns of FOUND for the texts of w; `before`: those of an earlier pass, whose hits are added."""
    n, count = w.hi - w.lo, w.count()
    first = np.cumsum(count) - count
    edge, named = np.zeros(len(w.row) + 1, np.int64), set()
    for at, window, size in index.hits(w):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        named |= index.items(size, w.row[at], window)
    if before is not None:
        old = before.slice(w.lo, n)
        lists = old.column("words")
        row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        np.add.at(edge, first[row] + flat.field("start").to_numpy(), 1)
        np.add.at(edge, first[row] + flat.field("end").to_numpy(), -1)
        named |= {(r, x) for r, xs in enumerate(old.column("items").to_pylist()) for x in xs}
    named = sorted(named, key=lambda x: (x[0], x[1] is None, x[1] or ""))
    mark = np.cumsum(edge[:-1]) > 0
    a, z = _stretches(mark, w.row)
    start, end = w.origin[a], w.origin[z] + w.length[z]
    row = w.row[a]
    for r in np.unique(row):  # bytes to characters
        chars = np.cumsum((w.raw[w.offset[r] : w.offset[r + 1]] & 0xC0) != 0x80)
        mine = slice(*np.searchsorted(row, [r, r + 1]))
        start[mine], end[mine] = chars[start[mine] - w.offset[r]] - 1, chars[end[mine] - w.offset[r] - 1]
    return [
        pa.array(count, pa.int64()), pa.array(np.bincount(w.row, mark, n).astype(np.int64)), _lists(np.array([r for r, _ in named], np.int64), n, pa.array([x for _, x in named], pa.string())),
        _lists(row, n, _spans(a - first[row], z - first[row] + 1)), _lists(row, n, _spans(start, end)),
    ]


def _task(index: Index, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch if "words" in batch.schema.names else None
            for w in tokens.split(batch.column("text")):
                rest = ["row"] if last else ["row", "text"]
                columns = [batch.column(c).slice(w.lo, w.hi - w.lo) for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, *_match(index, w, before)], [*rest, *[x.split()[0] for x in FOUND.replace("start: long, end", "").split(", ")]])

    return run


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, UPPER.lower())
    words = F.array_remove(F.split(lowered, tokens.SEPARATOR), "")
    cut = let(words, lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0)), F.lit(PIECE)), lambda i: F.array_join(F.slice(ws, i + 1, PIECE + n - 1), " ")))
    return benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.explode(cut).alias("piece")).where("piece <> ''")


def _found(rows: DataFrame, benchmark: DataFrame, n: int, item_col: str, text_col: str, block: int) -> DataFrame:
    """`rows` (row, text) with the columns of FOUND instead of the text."""
    pieces = _pieces(benchmark, item_col, text_col, n).distinct()
    size = pieces.agg(F.sum(F.length("piece")).alias("n")).first()["n"] or 0
    blocks = -(-size // block) or 1
    row = rows.schema["row"].dataType.simpleString()
    for b in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == b).collect()
        last = b == blocks - 1
        before, schema = rows, f"row {row}, {'' if last else 'text string, '}{FOUND}"
        rows = rows.mapInArrow(_task(Index([r["item"] for r in mine], [r["piece"] for r in mine], n), last), schema)
        if not last:
            rows = materialize(rows)
            release(before)
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for every document: doc_id, n_words, n_hit, items, spans.

    `n_hit` counts the document's words inside any occurrence of a window of
    the benchmark, `items` names the items with such windows (as strings, in
    order), `spans` are the maximal stretches of hit words as code points, end
    exclusive. Null and empty texts have no words: no hits, empty lists. A null
    or empty item has no window. Rows that repeat an item's id are one item; a
    null id is an item of its own, in `items` as null, last. Repeated documents
    each get their row. Empty tables: no rows, or no hits. Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _found(rows, benchmark, n, item_col, item_text, block).select("row.doc_id", "n_words", "n_hit", "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """`docs` without what the benchmark holds, all columns as they are but for the text.

    remove = "spans" cuts the hit stretches out of the texts, "documents" drops
    documents with a hit. Nulls, repeats and empty tables as in `scan`; a null
    text stays null.
    """
    if remove not in ("spans", "documents"):
        raise ValueError('remove is "spans" or "documents"')
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.cast("string").alias("text"))
    found = _found(rows, benchmark, n, item_col, item_text, block)
    if remove == "documents":
        return found.where("n_hit = 0").select(*[F.col(f"row.`{c}`") for c in docs.columns])
    text = F.col(f"row.`{text_col}`")
    # What lies between the end of one span and the start of the next.
    starts, ends = F.concat(F.col("spans.start"), F.array(F.length(text).cast("long"))), F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    left = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))), "")
    cleaned = F.when(F.size("spans") == 0, text).otherwise(left)
    return found.select(*[cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """What `scan` found, with the items as their number and the SHA-256 of their names."""
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
