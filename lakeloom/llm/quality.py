"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression of the text column, so a scan, one
projection and no shuffle evaluate all rules; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by this at from or an have not but "
    "le la les de des du et un une en est que qui dans pour sur pas par au avec ce il "
    "der die das und ein eine den von zu mit ist auf für im dem nicht des sich als auch an "
    "el los las y se del con por para no lo su al como más o un una es"
).split()

STOP_FORMS = [f for w in sorted(set(STOP_WORDS)) for f in (w, w.capitalize())]
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails when `metric` is under `low` or over `high`; None leaves that side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The first two are the base rules; the others are the method's.
BASE_RULES = (Rule("few_words", "n_words", low=10), Rule("repeats", "repeat_pct", high=20))
RULES = (
    Rule("word_length", "mean_word_chars", low=2, high=14),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("exclaiming", "bang_ratio", high=0.3),
    Rule("few_stop_words", "stop_ratio", low=0.005),
    Rule("few_letters", "alpha_ratio", low=0.5),
    Rule("same_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_ratio", high=0.9),
    Rule("ellipses", "ellipsis_ratio", high=0.5),
)


def repeated_words(tokens: Column, window: int = 5) -> Column:
    """Words that lie in a window of `window` words found twice or more in the text.

    Windows are compared by 64-bit hashes within one text. Sorting happens only
    in texts that do repeat a window.
    """

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda j, o: F.coalesce(F.get(s, j)["k"] == F.get(s, j + o)["k"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, -1) | same(j, 1))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last"))
        return let(ordered, lambda s: F.aggregate(positions(s), start, step, lambda a: a["n"]))

    def by_window(h: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))

    few = F.size(tokens) <= window
    return F.when(few, F.lit(0)).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), by_window)).cast("long")


def metrics(text: Column) -> dict[str, Column]:
    """What the rules look at, as columns over the array `_w` of words, the array `_l` of lines, and the text."""
    w, lines, n = F.col("_w"), F.col("_l"), F.greatest(F.size("_w"), F.lit(1))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    line_share = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))) / n_lines
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "repeat_pct": 100 * F.col("n_repeat_words") / n,
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        # A fifth of a stop word is added, so that short texts may do without.
        "stop_ratio": (F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))) + 0.2) / n,
        "upper_ratio": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / F.greatest(F.col("n_letters"), F.lit(1)),
        "alpha_ratio": F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bang_ratio": F.regexp_count(text, F.lit(r"!!+|\?\?+")) / n,
        "dup_line_ratio": F.col("n_dup_lines") / n_lines,
        "bullet_ratio": line_share(r"^[\x20\x09]*[-*•▪‣]"),
        "ellipsis_ratio": line_share(r"(\.\.\.|…)[\x20\x09-\x0D]*$"),
    }


def _fails(rule: Rule) -> Column:
    m, bad = F.col(rule.metric), F.lit(False)
    bad = bad if rule.low is None else bad | (m < rule.low)
    return bad if rule.high is None else bad | (m > rule.high)


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Apply the threshold table to every whole text.

    Returns the columns `keep` (all by default) and `base_failed`, `failed`
    (names of the failed rules), `kept`, and every metric. Metric names
    replace columns of the same name. Null and empty texts have no words and
    fail `few_words`; repeated rows are judged alike; an empty table gives an
    empty result. There is one projection per dependency level and no shuffle.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col("_t"), F.lit(""))
    m = metrics(text)
    first = [k for k in m if k in ("n_words", "word_chars", "n_symbols", "n_letters", "n_dup_lines", "n_repeat_words")]
    ratios = [k for k in m if k not in first]
    out = {*m, "base_failed", "failed", "kept"}
    kept_cols = [F.col(f"`{c}`") for c in keep if c.lower() not in out]
    src = docs.select(F.struct(*kept_cols, F.lit(1).alias("_pad")).alias("_k"), F.col(f"`{text_col}`").alias("_t"))
    src = src.withColumns({"_w": words(F.col("_t")), "_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    src = src.withColumns({k: m[k] for k in first}).withColumns({k: m[k] for k in ratios})
    named = lambda rs: F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rs])) if rs else F.array().cast("array<string>")
    src = src.withColumns({"_b": named(base_rules), "_m": named(rules)})
    verdict = [(F.size("_b") > 0).alias("base_failed"), F.concat("_b", "_m").alias("failed"), (F.size("_b") + F.size("_m") == 0).alias("kept")]
    return src.select(*[F.col(f"_k.`{c}`") for c in keep if c.lower() not in out], *m, *verdict)


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The documents that pass, with the columns of `docs`.

    They come out of a generator: Spark would push a plain filter below the
    projection and evaluate every metric again for it.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("judged"))
    judged = judge(row, "judged", ["row"], rules, base_rules)
    passed = F.when(F.col("kept"), F.array(F.struct("row", F.lit(True).alias("passed"))))
    return judged.select(F.inline_outer(passed)).where("passed").select(*[F.col(f"row.`{c}`") for c in docs.columns])
