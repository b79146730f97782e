"""URL filters by a path-template tree for each host.

Segments that hold digits are wildcards from the start. The tree then grows
where URLs of a host part, to the full depth of the paths, but for nodes of one
shape or without support of their own (fewer than SUPPORT URLs and fewer than
LABELS labels), whose URLs end there with the rest of their paths as names:

* Children without such support are values of a variable: beside others like
  them they go to one wildcard, but for those whose own labels speak against
  it. A child stays apart if the share of blocked of the other thin ones,
  smoothed by the node's, lies outside the 95 % interval of its own labels
  (Wilson's). How many siblings there are decides nothing.
* Other siblings merge on evidence alone: their shares of blocked labels lie on
  the same side of one half with 95 % confidence (so four labels at least), and
  they agree on the child of least hash, which two branches do with a
  probability equal to the overlap of their sets of children.

A template is rejected by the share of blocked among its labelled URLs, each
node smoothed by its parent's share.

URLs are first combined into distinct shapes with counts. Every step is an
aggregation or an equi-join by node, so a host with a third of all URLs is
neither one task nor one row. What all URLs of a node have in common is passed
in one step, so a round is a level at which URLs of supported nodes part, not a
level of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .html import host_of, path_of

#: URLs, or labels, that give a child support of its own.
SUPPORT, LABELS = 8, 4
#: Labelled URLs' worth of the parent's share in each node's share.
SMOOTHING = 5.0
#: Blocked share from which a template is rejected.
REJECT = 0.8
#: Standard errors of the confidence interval.
Z = 1.96
ANY = "*"


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits a URL; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _shape(segments: Column) -> Column:
    """Segments with digits are variable but for a file ending: 825.html is *.html."""
    ending = lambda x: F.regexp_extract(x, r"(\.[A-Za-z]{1,5})$", 1)
    return F.transform(segments, lambda x: F.when(x.rlike("[0-9]"), F.concat(F.lit(ANY), ending(x))).otherwise(x))


def _interval(blocked: Column, labelled: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson's interval of the blocked share."""
    mean, spread = blocked + z * z / 2, z * F.sqrt(blocked * (labelled - blocked) / F.greatest(labelled, F.lit(1)) + z * z / 4)
    return (mean - spread) / (labelled + z * z), (mean + spread) / (labelled + z * z)


def side(blocked: Column, labelled: Column) -> Column:
    """block or allow where the interval of the blocked share leaves no doubt, else null."""
    low, high = _interval(blocked, labelled)
    return F.when(labelled < LABELS, F.lit(None)).when(low > 0.5, "block").when(high < 0.5, "allow")


def _supported(n: Column, labelled: Column) -> Column:
    return (n >= SUPPORT) | (labelled >= LABELS)


def _smoothed(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + SMOOTHING * above) / (labelled + SMOOTHING)


def _named(children: DataFrame) -> DataFrame:
    """(host, prefix, seg, node, share, splits): the branch of each child, its smoothed share, and whether it is split again."""
    literal = ~F.startswith("seg", F.lit(ANY)) & (F.col("seg") != "")
    children = children.withColumn("thin", literal & ~_supported(F.col("n"), F.col("labelled")))
    pool = children.where("thin").groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("alike"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    children = children.join(pool, ["host", "prefix"], "left")
    others, (low, high) = _smoothed(F.col("b") - F.col("blocked"), F.greatest(F.col("l") - F.col("labelled"), F.lit(0)), F.col("share")), _interval(F.col("blocked"), F.col("labelled"))
    apart = (F.col("labelled") > 0) & ((others < low) | (others > high))
    # Branches: the wildcard, alike siblings, or the child itself. A child that is all wildcard is the same branch.
    alike = F.when(literal & F.col("side").isNotNull(), F.concat_ws(" ", "side", F.hex("mark")))
    branch = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.alias("of"))
    variable = (F.col("seg") == ANY) | (F.col("thin") & (F.col("alike") > 1) & ~apart)
    children = children.withColumn("key", F.when(variable, branch(1, F.lit(ANY))).when(alike.isNotNull(), branch(2, alike)).otherwise(branch(3, F.col("seg"))))
    total = children.groupBy("host", "prefix", "key").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked", "shapes")], F.min("seg").alias("first"), F.count(F.lit(1)).alias("k"), F.max("share").alias("above"))
    name = F.when(F.col("key.kind") == 1, F.lit(ANY)).when(F.col("k") == 1, F.col("first")).otherwise(F.concat(F.lit("("), "first", F.lit("+"), (F.col("k") - 1).cast("string"), F.lit(")")))
    total = total.select("host", "prefix", "key", name.alias("node"), _smoothed(F.col("blocked"), F.col("labelled"), F.col("above")).alias("share"), ((F.col("shapes") > 1) & _supported(F.col("n"), F.col("labelled"))).alias("splits"))
    return children.select("host", "prefix", "key", "seg").join(total, ["host", "prefix", "key"]).select("host", "prefix", "seg", "node", "share", "splits")


def _passed(tree: DataFrame) -> DataFrame:
    """The tree moved on by the segments that all shapes of a node share: each of them smooths the node's share once."""
    # The least and the greatest array differ where any two do.
    nodes = tree.groupBy("host", "prefix").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max("share").alias("above"))
    parts = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False)
    nodes = nodes.withColumn("k", F.when(parts > 0, parts.cast("int") - 1).otherwise(F.size("lo")))
    mean = F.try_divide(F.col("b").cast("double"), F.col("l").cast("double"))
    share = F.coalesce(mean + (F.col("above") - mean) * F.pow(SMOOTHING / (F.col("l") + SMOOTHING), F.col("k")), F.col("above"))
    run = F.when(F.col("k") > 0, F.concat(F.lit("/"), F.array_join(F.slice("lo", 1, F.greatest("k", F.lit(0))), "/"))).otherwise("")
    nodes = nodes.select("host", "prefix", "k", share.alias("passed"), run.alias("run"))
    moved = tree.join(nodes, ["host", "prefix"])
    rest = F.slice("rest", F.col("k") + 1, F.size("rest"))
    return moved.select("host", F.concat("prefix", "run").alias("prefix"), "shape", rest.alias("rest"), "n", "labelled", "blocked", F.col("passed").alias("share"))


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template, share) of distinct URLs: columns host, shape (array of segments), n, labelled, blocked.

    One round for each level at which URLs of a supported node still part.
    """
    total = urls.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = ((total["b"] or 0) + 1) / ((total["l"] or 0) + 2)
    splits = (F.count(F.lit(1)) > 1) & _supported(F.sum("n"), F.sum("labelled"))
    hosts = urls.groupBy("host").agg(_smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(prior)).alias("share"), splits.alias("splits"))
    name = F.concat("prefix", F.when(F.size("rest") == 0, "").otherwise(F.concat(F.lit("/"), F.array_join("rest", "/"))))
    named = lambda t: t.select("host", "shape", name.alias("template"), "share")
    step = materialize(urls.join(hosts, "host").withColumns({"prefix": F.lit(""), "rest": F.col("shape")}))
    done = []
    while True:
        ended = materialize(named(step.where("size(rest) = 0 OR NOT splits")))
        done.append(ended)
        tree = step.where("size(rest) > 0 AND splits").drop("splits")
        if not tree.limit(1).count():
            release(step)
            break
        moved = materialize(_passed(tree))
        release(step)
        known = moved.where("size(rest) > 0").withColumn("seg", F.get("rest", F.lit(0)))
        children = known.groupBy("host", "prefix", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.count(F.lit(1)).alias("shapes"), F.min(F.xxhash64(F.coalesce(F.get("rest", F.lit(1)), F.lit("")))).alias("mark"), F.max("share").alias("share"))
        children = materialize(children.withColumn("side", side(F.col("blocked"), F.col("labelled"))))
        after = known.drop("share").join(_named(children), ["host", "prefix", "seg"]).withColumns({"prefix": F.concat("prefix", F.lit("/"), "node"), "rest": F.slice("rest", 2, F.size("rest"))})
        # A shape that all others of its node continue has ended with what they share.
        step = materialize(after.drop("seg", "node").unionByName(moved.where("size(rest) = 0").withColumn("splits", F.lit(False))))
        release(moved, children)
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", label: Column | None = None, reject: float = REJECT) -> DataFrame:
    """All columns of `pages`, then host, path, rule, verdict, template, share (replacing columns of those names).

    A rule's verdict stands; other URLs are blocked when their template's
    smoothed share of blocked labels is at least `reject`. `label` (block,
    allow or null) defaults to the rule's verdict. A null URL or one without
    :// has an empty host and path and the templates of that host; repeated
    rows count each time and are judged alike; an empty table gives an empty
    result. Without any label every URL is allowed. In a template, (a+2) stands
    for a and two siblings like it.
    """
    added = ("host", "path", "rule", "verdict", "template", "share")
    url = F.col(f"`{url_col}`").cast("string")
    kept = [c for c in pages.columns if c.lower() not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(1).alias(""))
    src = pages.select(row.alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), (F.lit(None).cast("string") if label is None else label).alias("given"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    src = src.withColumns({"rule": rule, "ruled": verdict, "known": verdict if label is None else F.col("given")})
    src = src.withColumn("shape", _shape(F.split(F.regexp_replace("path", "^/", ""), "/")))
    count = lambda c: F.sum(c.cast("long"))
    urls = src.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), count(F.col("known").isNotNull()).alias("labelled"), count(F.coalesce(F.col("known") == "block", F.lit(False))).alias("blocked"))
    urls = materialize(urls)
    if not urls.limit(1).count():
        return src.where(F.lit(False)).select(*[F.col(f"row.`{c}`") for c in kept], "host", "path", "rule", F.lit("").alias("verdict"), F.lit("").alias("template"), F.lit(0.0).alias("share"))
    found = templates(urls).withColumnsRenamed({"host": "_h", "shape": "_s"})
    out = src.join(found, (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s")), "left")
    last = F.coalesce("ruled", F.when((F.col("share") >= reject) & (F.col("share") > 0.5), "block").otherwise("allow"))
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "host", "path", "rule", last.alias("verdict"), "template", "share")
