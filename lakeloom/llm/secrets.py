"""Secret scans: base patterns, further candidates, and how widely each value is owned across the corpus.

Everything is a DataFrame expression. The positions of matches come from
splitting the text at them: the lengths of the pieces and of the matches add
up to the offsets, CHUNK at a time, so that work is linear in the matches.

A value that many owners, or many repositories of one owner, hold is a copied
example; one that a single owner holds in few repositories looks live. Values
are counted corpus-wide by SHA-256: first one row for each (value, repository,
owner), then one for each value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize


@dataclass(frozen=True)
class Kind:
    """Spans that match `pattern`; `value` is the group that holds the secret, of `least` characters or more."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1


BASE_KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A longer run in place of + finds the same spans: the first AKIA of a run gives its longest match.
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that count only where the value looks live.
MORE_KINDS = (
    Kind("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}"),
    Kind("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Kind("prefixed", r"\b(?:gh[oprsu]|glpat|xox[abps]|sk|pk|rk)[_-][A-Za-z0-9_-]{20,}"),
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]{20,})", 1),
    Kind("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{6,64})@", 1),
)
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,value:string>>"
HELD = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,owners:bigint,repos:bigint>>"


#: Sums are run in chunks of this many, as appending to an array copies it.
CHUNK = 256


def _running_sums(values: Column) -> Column:
    """Running sums of an array of bigint: within chunks, then over the chunks' totals."""

    def run(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<bigint>").alias("all"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all"))
        return F.aggregate(xs, start, step, lambda a: a["all"])

    zero = F.lit(0).cast("bigint")
    at = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
    chunks = F.transform(at, lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    totals = lambda cs: F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    joined = lambda cs, sums: F.flatten(F.transform(cs, lambda c, i: run(c, F.coalesce(F.get(sums, i - 1), zero))))
    return let(chunks, lambda cs: let(run(totals(cs), zero), lambda sums: joined(cs, sums)))


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """All spans of one kind: start, rank, kind, stop, value; offsets in code points, stop exclusive."""

    def locate(m: Column) -> Column:
        pieces, matches, values = m["pieces"], m["matches"], m["values"]
        steps = F.transform(matches, lambda x, i: (F.length(F.get(pieces, i)) + F.length(x)).cast("bigint"))
        span = lambda i, stop: F.struct(
            (stop - F.length(F.get(matches, i))).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), stop.alias("stop"), F.get(values, i).alias("value"))
        spans = let(steps, lambda s: let(_running_sums(s), lambda stops: F.transform(stops, lambda stop, i: span(i, stop))))
        return F.filter(spans, lambda s: F.length(s["value"]) >= kind.least)

    found = F.struct(
        F.split(text, kind.pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value)).alias("values"),
    )
    return F.when(text.rlike(kind.pattern), let(found, locate)).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 1, most_repos: int = 2) -> DataFrame:
    """Find secrets in every whole text and tell widely copied values from owner-specific ones.

    Returns the columns `keep` and: `base` (spans of the base kinds), `added`
    (live spans of further kinds, outside base spans), `held` (for each span of
    both: start, rank, kind, stop, owners, repos), `n_live` and `n_copied`.
    A value is live where at most `most_owners` owners hold it in at most
    `most_repos` repositories. A span has start, rank, kind, stop, value.

    A null text is empty and has no spans; null owners and repositories count
    as one each; repeated rows are scanned alike; an empty table gives an
    empty result; columns of `keep` named like an added one are left out.
    A value shared by a third of all rows is one row for each owner, repository
    and map task before it is counted.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    every = [_spans(F.col("_t"), k, i) for i, k in enumerate((*BASE_KINDS, *MORE_KINDS))]
    owner = F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit(""))
    repo = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(repo_cols)]))
    keep = _free(keep)
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(1).alias("")).alias("_k"), owner.alias("_owner"), repo.alias("_repo"), text.alias("_t"))
    n = len(BASE_KINDS)
    found = found.select("_k", "_owner", "_repo", F.concat(*every[:n]).alias("base"), F.concat(*every[n:]).alias("more"))
    found = materialize(found.withColumn("_r", F.monotonically_increasing_id()))

    spans = found.select("_r", "_owner", "_repo", F.explode(F.concat("base", "more")).alias("s"))
    # A further span overlaps a base one that starts no later and ends after its start, or one that starts within it.
    # Both frames grow from their first row on, each in its own order: Spark evaluates a frame with an open end anew for each row.
    doc, is_base = Window.partitionBy("_r"), F.col("s.rank") < n
    until = F.max(F.when(is_base, F.col("s.stop"))).over(doc.orderBy("s.start").rangeBetween(Window.unboundedPreceding, 0))
    since = F.min(F.when(is_base, F.col("s.start"))).over(doc.orderBy(F.desc("s.start")).rangeBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumns({"until": until, "since": since})
    apart = F.coalesce(F.col("until") <= F.col("s.start"), F.lit(True)) & F.coalesce(F.col("since") >= F.col("s.stop"), F.lit(True))
    spans = spans.where(is_base | apart).select("_r", "_owner", "_repo", "s", F.sha2(F.col("s.value"), 256).alias("hash"))

    held = spans.groupBy("hash", "_repo", "_owner").agg(F.lit(1).alias("one")).groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("repos"))
    held = held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    judged = spans.select("_r", "hash", "s").join(held, "hash").withColumn("live", live).groupBy("_r").agg(
        F.collect_list(F.when(~is_base & F.col("live"), F.col("s"))).alias("added"),
        F.collect_list(F.when(is_base | F.col("live"), F.struct("s.start", "s.rank", "s.kind", "s.stop", "owners", "repos"))).alias("held"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"),
    )
    out = found.select("_r", "_k", "base").join(judged, "_r", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    listed = [F.array_sort(F.coalesce(c, F.array().cast(t))).alias(c) for c, t in (("added", SPAN), ("held", HELD))]
    return out.select(*[F.col(f"_k.`{c}`") for c in keep], "base", *listed, zero("n_live"), zero("n_copied"))


def _free(keep: tuple[str, ...]) -> list[str]:
    return [c for c in keep if c.lower() not in ("base", "added", "held", "n_live", "n_copied")]


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, all spans as text, and each span's owners and repositories."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spread = F.concat_ws(",", F.transform("held", lambda h: F.concat_ws(":", h["owners"].cast("string"), h["repos"].cast("string"))))
    return found.select(*_free(keep), *[count(k.name) for k in BASE_KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), spread.alias("held_by"), "n_live", "n_copied")
