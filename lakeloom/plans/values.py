"""Registered queries over nulls, casts, text, nested values, ranks and approximations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators import joins, windows
from lakeloom.operators import sketches as stored
from lakeloom.sources.tables import read_table

from .registry import register
from .relational import exact, n


def long(c, name: str):
    return c.cast("long").alias(name)


@register(
    "not_in_nulls",
    "SELECT 'plain' AS kind, c_custkey FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0) UNION ALL SELECT 'with null', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, (SELECT min(s_nationkey) FROM supplier)) FROM supplier) UNION ALL SELECT 'empty', c_custkey FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0)",
)
def not_in_nulls(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    s = read_table(spark, sf, "supplier")
    least = s.agg(F.min("s_nationkey").alias("m")).first()["m"]
    parts = {
        "plain": joins.not_in(c, s.where("s_suppkey % 5 = 0"), "k", "s_nationkey"),
        "with null": joins.not_in(c, s.select(F.nullif("s_nationkey", F.lit(least)).alias("v")), "c_nationkey", "v"),
        "empty": joins.not_in(c, s.where("s_suppkey < 0"), "k", "s_nationkey"),
    }
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "c_custkey")
        out = df if out is None else out.unionByName(df)
    return out


@register("null_ordering", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_orderkey) AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') DESC NULLS FIRST, o_orderkey) AS down FROM orders")
def null_ordering(spark: SparkSession, sf: str) -> DataFrame:
    s, of = F.nullif("o_orderstatus", F.lit("P")), lambda *by: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by, "o_orderkey"))
    return read_table(spark, sf, "orders").select("o_orderkey", long(of(s.asc_nulls_last()), "up"), long(of(s.desc_nulls_first()), "down"))


@register("null_ordered_top", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p ASC NULLS FIRST, o_orderkey DESC LIMIT 15")
def null_ordered_top(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return o.orderBy(F.col("p").asc_nulls_first(), F.col("o_orderkey").desc()).limit(15)


@register("try_casts", "SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, 'Brand#[12]', '', 'g') AS BIGINT) AS no, TRY_CAST(CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE p_type END AS BIGINT) AS size FROM part")
def try_casts(spark: SparkSession, sf: str) -> DataFrame:
    either = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    return read_table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_brand", "Brand#[12]", "").try_cast("bigint").alias("no"), either.try_cast("bigint").alias("size"))


@register("text_functions", r"SELECT p_partkey, lower(p_type) AS lo, replace(p_brand, '#', '-') AS rep, trim('  ' || p_name || ' ') AS tr, substring(p_name, 2, 3) AS sub, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rr, len(regexp_extract_all(p_name, '[aeiou]'))::BIGINT AS vowels, length(p_name)::BIGINT AS len, split_part(p_brand, '#', 2) AS part, len(list_filter(string_split(p_name, ' '), lambda x: x <> ''))::BIGINT AS words, starts_with(p_type, 'P') AS pre, rpad(p_type, 10, '.') AS rp FROM part")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.filter(F.split("p_name", " "), lambda x: x != "")
    return read_table(spark, sf, "part").select(
        "p_partkey", F.lower("p_type").alias("lo"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("rep"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("tr"), F.substring("p_name", 2, 3).alias("sub"),
        F.regexp_replace("p_name", "[aeiou]", "_").alias("rr"), long(F.regexp_count("p_name", F.lit("[aeiou]")), "vowels"), long(F.length("p_name"), "len"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("part"),
        long(F.size(tokens), "words"), F.startswith("p_type", F.lit("P")).alias("pre"), F.rpad("p_type", 10, ".").alias("rp"),
    )


@register("url_hosts", r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages")
def url_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@register("more_dates", "SELECT o_orderkey, dayofyear(o_orderdate)::BIGINT AS doy, month(o_orderdate)::BIGINT AS m, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS later, epoch_us(o_orderdate)::BIGINT AS micros, strftime(o_orderdate, '%Y/%m') AS ym FROM orders")
def more_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read_table(spark, sf, "orders").select(
        "o_orderkey", long(F.dayofyear(d), "doy"), long(F.month(d), "m"), F.date_format(F.add_months(d, 2), "yyyy-MM-dd").alias("later"), F.unix_micros(d.cast("timestamp")).alias("micros"), F.date_format(d, "yyyy/MM").alias("ym"))


@register("more_math", "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal)::DOUBLE AS s, ceil(c_acctbal)::BIGINT AS c, greatest(c_acctbal, 0) AS pos, exp(c_acctbal / 1e5) AS e FROM customer")
def more_math(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("c_acctbal")
    return read_table(spark, sf, "customer").select("c_custkey", F.abs(b).alias("a"), F.signum(b).alias("s"), long(F.ceil(b), "c"), F.greatest(b, F.lit(0.0)).alias("pos"), F.exp(b / 1e5).alias("e"))


@register("maps_and_structs", "SELECT c_nationkey, len(map_keys(m))::BIGINT AS n, m['BUILDING'] AS building, list_sort(map_keys(m))[1] AS first FROM (SELECT c_nationkey, map_from_entries(list({'k': c_mktsegment, 'v': n})) AS m FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey)")
def maps_and_structs(spark: SparkSession, sf: str) -> DataFrame:
    counts = read_table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(n())
    # A nation has as many entries as there are segments.
    maps = counts.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    return maps.select("c_nationkey", long(F.size("m"), "n"), F.try_element_at("m", F.lit("BUILDING")).alias("building"), F.element_at(F.sort_array(F.map_keys("m")), 1).alias("first"))


@register("array_sets", "SELECT vec_id, len(list_distinct(a))::BIGINT AS kinds, len(list_distinct(a || [1, 2]))::BIGINT AS joined, list_contains(a, 0) AS has0, list_has_any(a, [5, 7]) AS meets, array_to_string(list_sort(list_intersect(list_distinct(a), [0, 1, 2])), ',') AS both_, array_to_string(a[2:4], '/') AS cut FROM (SELECT vec_id, list_transform(embedding[1:12], lambda x: floor(x * 40)::BIGINT) AS a FROM embeddings)")
def array_sets(spark: SparkSession, sf: str) -> DataFrame:
    a = F.transform(F.slice("embedding", 1, 12), lambda x: F.floor(x * 40))
    rows = read_table(spark, sf, "embeddings").select("vec_id", a.alias("a"))
    of = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    text = lambda c: c.cast("array<string>")
    return rows.select(
        "vec_id", long(F.size(F.array_distinct("a")), "kinds"), long(F.size(F.array_union("a", of(1, 2))), "joined"), F.array_contains("a", F.lit(0).cast("long")).alias("has0"), F.arrays_overlap("a", of(5, 7)).alias("meets"),
        F.array_join(text(F.sort_array(F.array_intersect("a", of(0, 1, 2)))), ",").alias("both_"), F.array_join(text(F.slice("a", 2, 3)), "/").alias("cut"))


@register("array_positions", "SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] > 0.3")
def array_positions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).where(F.col("x") > F.lit(0.3).cast("float")).select("vec_id", long(F.col("pos"), "pos"), F.col("x").cast("double").alias("x"))


@register("json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, json_extract_string(props, '$.none.deep') AS missing FROM events")
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("v"), F.get_json_object("props", "$.none.deep").alias("missing"))


@register("rank_shares", "SELECT o_orderkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def rank_shares(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return read_table(spark, sf, "orders").select("o_orderkey", F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"))


@register(
    "exclude_peers",
    "SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,6)) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP)::DOUBLE AS others, sum(o_totalprice::DECIMAL(18,6)) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES)::DOUBLE AS untied FROM orders",
)
def exclude_peers(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").withColumn("price", exact("o_totalprice"))
    without = lambda row: windows.sum_excluding_peers("price", ["o_custkey"], "o_orderpriority", row).cast("double")
    return o.select("o_orderkey", without(False).alias("others"), without(True).alias("untied"))


@register("approximations", "SELECT event_type, count(DISTINCT user_id) AS users, median(value) AS middle, TRUE AS users_close, TRUE AS middle_close FROM events GROUP BY event_type")
def approximations(spark: SparkSession, sf: str) -> DataFrame:
    """Exact users and median of each type, and whether the approximate ones lie near: users within 15 %, the median within 2 % of the ranks."""
    e = read_table(spark, sf, "events")
    exact = windows.percentile(e, ["event_type"], "value", {"lo": 0.48, "middle": 0.5, "hi": 0.52})
    near = e.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("a"), F.count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5, 10000).alias("m"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("h"))
    close = lambda c: F.abs(F.col(c) - F.col("users")) <= 0.15 * F.col("users")
    return near.join(exact, "event_type").select("event_type", "users", "middle", (close("a") & close("h")).alias("users_close"), F.col("m").between(F.col("lo"), F.col("hi")).alias("middle_close"))


@register("distinct_sums", "SELECT p_type, sum(DISTINCT p_size)::BIGINT AS s, count(DISTINCT p_size) AS c FROM part GROUP BY p_type")
def distinct_sums(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").groupBy("p_type").agg(long(F.sum_distinct("p_size"), "s"), F.count_distinct("p_size").alias("c"))


@register("modes", "SELECT c_nationkey, c_mktsegment AS usual FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE k = 1")
def modes(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent segment of each nation, the first by name among equals."""
    counts = read_table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(n())
    return counts.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), F.col("c_mktsegment"))).alias("usual"))


@register("lateral_top", "SELECT n_nationkey, c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1)")
def lateral_top(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    best = c.where(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(1).select("c_custkey")
    return read_table(spark, sf, "nation").lateralJoin(best).select("n_nationkey", "c_custkey")


@register("hinted_joins", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hinted_joins(spark: SparkSession, sf: str) -> DataFrame:
    s, m, r = (read_table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(m.hint("shuffle_hash"), F.col("s_nationkey") == F.col("n_nationkey")).join(r.hint("merge"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@register("piped", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def piped(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("FROM {orders} |> WHERE o_totalprice > 1000 |> AGGREGATE count(*) AS n, max(o_totalprice) AS top GROUP BY o_orderstatus", orders=read_table(spark, sf, "orders"))


@register("variant_fields", "SELECT event_id, k AS key, json_extract(props, '$.' || k)::BIGINT AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def variant_fields(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each field of the parsed props; malformed JSON has none."""
    e = read_table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("p"))
    fields = spark.tvf.variant_explode(F.col("p").outer())
    return e.lateralJoin(fields).select("event_id", "key", F.try_variant_get("value", "$", "long").alias("v"))


@register("discrete_percentiles", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS middle, quantile_disc(l_quantity, 0.9) AS high FROM lineitem GROUP BY l_returnflag")
def discrete_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The least value that a share of the rows doesn't exceed: no group is held in one task."""
    return windows.discrete_percentile(read_table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", {"middle": 0.5, "high": 0.9})


@register("frequent_items", "SELECT event_type AS item, count(*) AS n FROM events GROUP BY event_type")
def frequent_items(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent types from a sketch of bounded size, exact as long as it tracks all distinct values."""
    top = read_table(spark, sf, "events").agg(F.expr("approx_top_k(event_type, 100, 1000)").alias("top"))
    return top.select(F.inline("top")).select("item", long(F.col("count"), "n"))


@register("sketches", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS shared, median(value) AS middle, TRUE AS middle_close FROM events GROUP BY event_type")
def sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Users of a type, and those it shares with all, by theta sketches of parts of the users, so that none overflows; whether a KLL sketch gives the median within 4 % of the ranks."""
    e = read_table(spark, sf, "events")
    exact = windows.percentile(e, ["event_type"], "value", {"lo": 0.46, "middle": 0.5, "hi": 0.54})
    close = e.groupBy("event_type").agg(F.expr("kll_sketch_agg_double(value)").alias("k"))
    kept = stored.distinct_states(e, ["event_type"], "user_id", 14)
    every = kept.groupBy("part").agg(F.theta_union_agg("state", 14).alias("every"))
    both = kept.join(every, "part").withColumn("both", F.theta_intersection("state", "every"))
    users = both.groupBy("event_type").agg(stored.distinct_values(F.col("state")).alias("users"), stored.distinct_values(F.col("both")).alias("shared"))
    median = F.call_function("kll_sketch_get_quantile_double", F.col("k"), F.lit(0.5))
    return users.join(close, "event_type").join(exact, "event_type").select("event_type", "users", "shared", "middle", median.between(F.col("lo"), F.col("hi")).alias("middle_close"))
