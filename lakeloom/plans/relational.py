"""Registered relational queries: each is a DataFrame plan with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import scalars
from lakeloom.operators import joins, windows
from lakeloom.sources.tables import read_table

from .registry import register


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def exact(x):
    """Money as a decimal: sums don't depend on the order of rows, as those of doubles do."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,6)")


def total(x):
    return F.sum(exact(x)).cast("double")


@register(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice::DECIMAL(18,6))::DOUBLE AS sum_price, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,6))::DOUBLE AS sum_disc_price, sum(l_quantity) / count(*) AS avg_qty, sum(l_discount::DECIMAL(18,6))::DOUBLE / count(*) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
)
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_price"), total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"),
        (F.sum("l_quantity") / F.count(F.lit(1))).alias("avg_qty"), (total("l_discount") / F.count(F.lit(1))).alias("avg_disc"), n(),
    )


@register("filter_range", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag IN ('A', 'R')")
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    keep = F.col("l_quantity").between(10, 12) & (F.col("l_shipdate") >= F.expr("timestamp_ntz'1996-01-01'")) & F.col("l_returnflag").isin("A", "R")
    return li.where(keep).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@register("case_coalesce", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, coalesce(nullif(p_type, 'PROMO'), 'none') AS kind FROM part WHERE p_name LIKE '%a%'")
def case_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return read_table(spark, sf, "part").where(F.col("p_name").like("%a%")).select("p_partkey", size.alias("size_class"), F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("none")).alias("kind"))


@register("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@register(
    "revenue_by_nation",
    "SELECT n_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,6))::DOUBLE AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
)
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda x: read_table(spark, sf, x)
    # From the small side: lineitem meets only the orders of the region.
    j = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    j = t("customer").join(j, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    j = t("orders").join(j, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    j = t("lineitem").join(j, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("n_name").agg(total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), n())


@register("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def left_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").where("o_orderstatus = 'P'")
    # Orders are counted before the join, so each customer meets one row.
    o = o.groupBy("o_custkey").agg(n())
    return read_table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS parts FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def full_join(spark: SparkSession, sf: str) -> DataFrame:
    a = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(n("orders"))
    b = read_table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(n("parts"))
    return a.join(b, "k", "full")


@register("semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").where("l_quantity > 49")
    return read_table(spark, sf, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@register("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").join(read_table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@register("scalar_subquery", "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
def scalar_subquery(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    mean = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    return p.join(mean, "p_brand").where("p_retailprice > mean").select("p_partkey", "p_retailprice")


@register(
    "asof_purchase",
    "SELECT c.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts",
)
def asof_purchase(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    p = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return joins.asof_join(e.where("event_type = 'click'"), p, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@register("interval_join", "SELECT l_orderkey, l_linenumber, l_partkey, r.id FROM lineitem JOIN (SELECT p_partkey AS id, p_retailprice AS lo, p_retailprice + 5 AS hi FROM part WHERE p_size = 1) r ON l_extendedprice BETWEEN lo AND hi")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    return joins.interval_join(read_table(spark, sf, "lineitem"), r, "l_extendedprice", "lo", "hi", 5.0).select("l_orderkey", "l_linenumber", "l_partkey", "id")


@register("time_range_join", "SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def time_range_join(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = 3600 * 10**6
    a = e.where("event_type = 'click'").select("user_id", at.alias("lo"), (at + hour).alias("hi"), F.col("event_id").alias("click_id"))
    b = e.where("event_type = 'purchase'").select("user_id", at.alias("at"), F.col("event_id").alias("purchase_id"))
    return joins.interval_join(b, a, "at", "lo", "hi", hour, ["user_id"]).select("click_id", "purchase_id")


@register("salted_join", "SELECT event_type, c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL")
def salted_join(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    e = read_table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return joins.salted_join(e, c, ["user_id"], 4).groupBy("event_type", "c_mktsegment").agg(n())


@register("having_distinct", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, sum(o_totalprice::DECIMAL(18,6))::DOUBLE AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_distinct(spark: SparkSession, sf: str) -> DataFrame:
    out = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds"), total("o_totalprice").alias("total"), n())
    return out.where("n > 12").drop("n")


@register("filtered_aggregates", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, sum(l_quantity) FILTER (WHERE l_tax < 0.02) AS untaxed, bool_and(l_quantity > 0) AS positive, bit_xor(l_orderkey) AS mixed FROM lineitem GROUP BY l_returnflag")
def filtered_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_tax") < 0.02, F.col("l_quantity"))).alias("untaxed"),
        F.bool_and(F.col("l_quantity") > 0).alias("positive"), F.bit_xor("l_orderkey").alias("mixed"),
    )


@register("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, (grouping(o_orderstatus) * 2 + grouping(o_orderpriority))::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(n(), F.grouping_id().cast("long").alias("level"))


@register("cube_parts", "SELECT p_type, p_size % 3 AS m, count(*) AS n FROM part GROUP BY CUBE (p_type, m)")
def cube_parts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").withColumn("m", F.col("p_size") % 3).cube("p_type", "m").agg(n())


@register("grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@register("moments", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS var, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt, round(corr(value, user_id), 6) AS corr FROM events GROUP BY event_type")
def moments(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return read_table(spark, sf, "events").groupBy("event_type").agg(
        r(F.stddev_samp("value")).alias("sd"), r(F.var_pop("value")).alias("var"), r(scalars.sample_skewness("value")).alias("skew"),
        r(scalars.sample_kurtosis("value")).alias("kurt"), r(F.corr("value", "user_id")).alias("corr"),
    )


@register("percentiles", "SELECT l_shipdate::DATE - TIMESTAMP '1995-01-01'::DATE > 1000 AS late, quantile_cont(l_quantity, 0.9) AS p90, median(l_extendedprice) AS med FROM lineitem GROUP BY 1")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    late = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01")) > 1000
    # Both columns in one pass: their names are a key.
    value = lambda c: F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))
    li = read_table(spark, sf, "lineitem").select(late.alias("late"), F.inline(F.array(value("l_quantity"), value("l_extendedprice"))))
    found = windows.percentile(li, ["late", "c"], "v", {"p90": 0.9, "med": 0.5})
    of = lambda c, name: F.max(F.when(F.col("c") == c, F.col(name))).alias(name)
    return found.groupBy("late").agg(of("l_quantity", "p90"), of("l_extendedprice", "med"))


@register("arg_extremes", "SELECT c_mktsegment, max_by(c_custkey, c_acctbal) AS richest, min_by(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_mktsegment")
def arg_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the greatest and the least balance; of those that tie the one of the smallest key. Null keys and balances are left out."""
    rows = read_table(spark, sf, "customer").withColumn("known", F.expr("c_custkey IS NOT NULL AND c_acctbal IS NOT NULL"))
    by = lambda tie: F.when(F.col("known"), F.struct("c_acctbal", tie))
    return rows.groupBy("c_mktsegment").agg(F.max_by("c_custkey", by(-F.col("c_custkey"))).alias("richest"), F.min_by("c_custkey", by("c_custkey")).alias("poorest"))


@register("ordered_lists", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts) AS trail FROM events GROUP BY user_id")
def ordered_lists(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.sort_array(F.collect_list(F.struct("ts", "event_type")))
    return read_table(spark, sf, "events").groupBy("user_id").agg(F.concat_ws(">", F.transform(steps, lambda s: s["event_type"])).alias("trail"))


@register("histogram", "SELECT least(greatest(floor((o_totalprice - 0) / 50000) + 1, 0), 11)::BIGINT AS bucket, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").groupBy(scalars.bucket_of("o_totalprice", 0.0, 500000.0, 10).cast("long").alias("bucket")).agg(n())


@register("pivot_status", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_status(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@register("unpivot_prices", "SELECT l_linestatus, 'tax' AS what, sum(l_tax::DECIMAL(18,6))::DOUBLE AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, 'discount', sum(l_discount::DECIMAL(18,6))::DOUBLE FROM lineitem GROUP BY 1")
def unpivot_prices(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "lineitem").groupBy("l_linestatus").agg(total("l_tax").alias("tax"), total("l_discount").alias("discount"))
    return s.unpivot("l_linestatus", ["tax", "discount"], "what", "v")


@register("ranks", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(3) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    long = lambda c, name: c.cast("long").alias(name)
    return read_table(spark, sf, "orders").select("o_orderkey", long(F.row_number().over(w), "rn"), long(F.rank().over(v), "rk"), long(F.dense_rank().over(v), "dr"), long(F.ntile(3).over(w), "nt"))


@register("lags", "SELECT event_id, lag(value) OVER w AS before, lead(event_type, 2, 'none') OVER w AS later, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def lags(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return read_table(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("event_type", 2, "none").over(w).alias("later"), F.first("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(w).alias("second_id"))


@register("moving_frames", "SELECT event_id, sum(value::DECIMAL(18,6)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS last3, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day FROM events")
def moving_frames(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    e = read_table(spark, sf, "events")
    day = F.expr("count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row)")
    return e.select("event_id", F.sum(exact("value")).over(w.rowsBetween(-2, 0)).cast("double").alias("last3"), day.alias("day"))


@register("groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM orders")
def groups_frame(spark: SparkSession, sf: str) -> DataFrame:
    return windows.over_groups(read_table(spark, sf, "orders"), "near", F.count(F.lit(1)), ["o_custkey"], "o_orderpriority", 1, 0).select("o_orderkey", "near")


@register("exclude_current", "SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,6)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)::DOUBLE AS others FROM orders")
def exclude_current(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-1, 1)
    return read_table(spark, sf, "orders").withColumn("price", exact("o_totalprice")).select("o_orderkey", windows.sum_excluding_row("price", w).cast("double").alias("others"))


@register("qualify_latest", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1")
def qualify_latest(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc())
    return windows.qualify(read_table(spark, sf, "events"), F.row_number().over(w) == 1).select("event_id", "user_id")


@register("top_k_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) <= 3")
def top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return windows.top_k(read_table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc()], 3, ties=True).select("o_custkey", "o_orderkey")


@register("user_sessions", "SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session_no FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(read_table(spark, sf, "events"), ["user_id"], "ts", "6 hours").select("event_id", "session_no")


@register("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice")


@register("set_operations", "(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation)")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    m = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return c.exceptAll(s).unionAll(c.intersectAll(s)).unionAll(s.union(m).distinct())


@register("strings", r"SELECT p_partkey, upper(left(p_name, 3)) AS u, lpad(p_partkey::VARCHAR, 8, '0') AS padded, reverse(p_brand) AS r, strpos(p_brand, '#')::BIGINT AS at, regexp_extract(p_brand, '#([0-9]+)', 1) AS no, md5(p_name) AS h, levenshtein(p_type, 'PROMO')::BIGINT AS far, concat_ws('-', p_type, p_brand) AS both_ FROM part")
def strings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").select(
        "p_partkey", F.upper(F.left("p_name", F.lit(3))).alias("u"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.reverse("p_brand").alias("r"),
        F.instr("p_brand", "#").cast("long").alias("at"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("no"), F.md5(F.col("p_name").cast("binary")).alias("h"),
        F.levenshtein("p_type", F.lit("PROMO")).cast("long").alias("far"), F.concat_ws("-", "p_type", "p_brand").alias("both_"),
    )


@register("dates", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q, dayofweek(o_orderdate)::BIGINT AS wd, weekofyear(o_orderdate)::BIGINT AS wk, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::BIGINT AS days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    d, long = F.col("o_orderdate"), lambda c, name: c.cast("long").alias(name)
    return read_table(spark, sf, "orders").select(
        "o_orderkey", long(F.year(d), "y"), long(F.quarter(d), "q"), long(scalars.weekday(d), "wd"), long(F.weekofyear(d), "wk"), long(F.datediff(d, F.lit("1995-01-01")), "days"),
        F.date_format(F.date_trunc("month", d), "yyyy-MM-dd").alias("month"), F.date_format(F.last_day(d), "yyyy-MM-dd").alias("last"),
    )


@register("math", "SELECT l_orderkey, l_linenumber, l_partkey, sqrt(l_quantity) AS root, ln(l_extendedprice) AS log, pow(l_tax + 1, 3) AS cube, floor(l_extendedprice)::BIGINT AS low, l_orderkey // 7 AS q, l_orderkey % 7 AS r, l_quantity / nullif(l_tax, 0) AS ratio FROM lineitem")
def math(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.sqrt("l_quantity").alias("root"), F.ln("l_extendedprice").alias("log"), F.pow(F.col("l_tax") + 1, F.lit(3)).alias("cube"),
        F.floor("l_extendedprice").cast("long").alias("low"), F.expr("l_orderkey div 7").alias("q"), (F.col("l_orderkey") % 7).alias("r"), scalars.safe_ratio(F.col("l_quantity"), F.col("l_tax")).alias("ratio"),
    )


@register("vectors", "SELECT vec_id, list_max(embedding)::DOUBLE AS top, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2, list_position(embedding, list_max(embedding))::BIGINT AS at, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive FROM embeddings")
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return read_table(spark, sf, "embeddings").select(
        "vec_id", F.array_max(v).cast("double").alias("top"), F.round(scalars.dot(v, v), 6).alias("norm2"), F.array_position(v, F.array_max(v)).alias("at"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"),
    )


@register("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k is not null")


@register("conversation_turns", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, max(length(text))::BIGINT AS longest FROM conversations GROUP BY conv_id")
def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return read_table(spark, sf, "conversations").groupBy("conv_id").agg(n("turns"), F.concat_ws(",", roles).alias("roles"), F.max(F.length("text")).cast("long").alias("longest"))


@register("tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = read_table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(n(), total("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@register("sliding_windows", "SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY w")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = read_table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(n())
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@register(
    "session_windows",
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
)
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = read_table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(n())
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@register("recursive_series", "WITH RECURSIVE t(i, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT i + 1, f * (i + 1) FROM t WHERE i < 15) SELECT i, f FROM t")
def recursive_series(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(i, f) AS (SELECT 1, 1L UNION ALL SELECT i + 1, f * (i + 1) FROM t WHERE i < 15) SELECT i, f FROM t")
