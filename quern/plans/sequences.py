"""Queries on windows, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relational as rel
from quern.operators import windows as win
from quern.plans.analytics import TOK, counts
from quern.plans.registry import register
from quern.sources.tables import table


def user_events(spark, folder):
    return table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")


@register("w01_average_rank", f"WITH {TOK}, c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY ALL) SELECT lang, w, rank() OVER (PARTITION BY lang ORDER BY n DESC) + (count(*) OVER (PARTITION BY lang, n) - 1) / 2 AS r, round(percent_rank() OVER (PARTITION BY lang ORDER BY n DESC), 9) AS pct FROM c")
def w01(spark, folder):
    pct = F.percent_rank().over(Window.partitionBy("lang").orderBy(F.desc("n")))
    return counts(spark, folder, "lang").select("lang", "w", win.average_rank(["lang"], "n").alias("r"), F.round(pct, 9).alias("pct"))


@register("w02_rank_percentile", "SELECT vec_id, label, round((row_number() OVER (PARTITION BY label ORDER BY embedding[1], vec_id) - 1) / (count(*) OVER (PARTITION BY label) - 1), 9) AS pct FROM embeddings")
def w02(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"))
    pct = (F.row_number().over(Window.partitionBy("label").orderBy("x", "vec_id")) - 1) / (F.count("*").over(Window.partitionBy("label")) - 1)
    return rows.select("vec_id", "label", F.round(pct, 9).alias("pct"))


@register("w03_cumulative_share", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def w03(spark, folder):
    total = F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return user_events(spark, folder).select("event_id", F.round(total, 4).alias("total"), F.round(total / F.sum("value").over(Window.partitionBy("user_id")), 6).alias("share"))


@register("w04_centred_mean", "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def w04(spark, folder):
    return user_events(spark, folder).select("event_id", F.round(win.centred_mean("value", ["user_id"], ["ts", "event_id"], 4), 6).alias("mean"))


@register("w05_trailing_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS sma FROM events")
def w05(spark, folder):
    return user_events(spark, folder).select("event_id", F.round(F.avg("value").over(win.trailing(["user_id"], ["ts", "event_id"], 5)), 6).alias("sma"))


@register("w06_ema", """WITH RECURSIVE r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
x AS (SELECT user_id, event_id, i, value::double AS e FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.event_id, r.i, (2.0::double / 6) * r.value + (1 - 2.0::double / 6) * x.e FROM x JOIN r ON r.user_id = x.user_id AND r.i = x.i + 1)
SELECT user_id, event_id, round(e, 4) AS ema FROM x""")
def w06(spark, folder):
    return win.ema(user_events(spark, folder), "user_id", "event_id", "value", 5).withColumn("ema", F.round("ema", 4))


@register("w07_volatility", "SELECT event_id, round(stddev_pop(value) OVER w / abs(avg(value) OVER w) * 100, 4) AS cv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def w07(spark, folder):
    w = win.trailing(["user_id"], ["ts", "event_id"], 5)
    spread, mean = F.stddev_pop("value").over(w), F.abs(F.avg("value").over(w))
    return user_events(spark, folder).select("event_id", F.round(win.ratio(spread, mean) * 100, 4).alias("cv"))


@register("w08_slope", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT event_id, round(coalesce(CASE WHEN count(*) OVER w >= 2 THEN covar_pop(value, i) OVER w / var_pop(i) OVER w END, 0), 5) AS slope FROM r
WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS 4 PRECEDING)""")
def w08(spark, folder):
    """Least-squares slope over the last five rows; 0 with fewer than two."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = user_events(spark, folder).withColumn("i", F.row_number().over(order).cast("double"))
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-4, 0)
    slope = F.covar_pop("value", "i").over(w) / F.nullif(F.var_pop("i").over(w), F.lit(0.0))
    return rows.select("event_id", F.round(F.coalesce(slope, F.lit(0.0)), 5).alias("slope"))


@register("w11_running_cdf", "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS cdf FROM events")
def w11(spark, folder):
    return user_events(spark, folder).select("event_id", F.round(F.cume_dist().over(Window.partitionBy("event_type").orderBy("value")), 9).alias("cdf"))


@register("w12_patience", """WITH b AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
g AS (SELECT *, best IS NULL OR value < best - 0.5::double AS better FROM b), i AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM g)
SELECT event_id, better, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1)::bigint AS waited FROM i""")
def w12(spark, folder):
    _, better = win.patience("value", ["user_id"], ["event_id"], 0.5)
    rows = user_events(spark, folder).withColumn("better", better)
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = rows.withColumn("island", F.sum(F.col("better").cast("int")).over(order))
    return rows.select("event_id", "better", (F.row_number().over(Window.partitionBy("user_id", "island").orderBy("event_id")) - 1).cast("bigint").alias("waited"))


@register("w13_schedules", "SELECT i AS step, round(CASE WHEN i < 100 THEN i / 100.0::double ELSE greatest(0, 0.5::double * (1 + cos(pi() * (i - 100) / 900.0::double))) END, 9) AS cosine, round(CASE WHEN i < 100 THEN i / 100.0::double ELSE greatest(0, (1000 - i) / 900.0::double) END, 9) AS linear FROM (SELECT unnest(range(0, 1000)) AS i)")
def w13(spark, folder):
    """Warm-up, then cosine or linear decay, as expressions of the step."""
    i = F.col("id")
    warm = i / 100.0
    return spark.range(1000).select(
        i.alias("step"), F.round(F.when(i < 100, warm).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.pi() * (i - 100) / 900.0)))), 9).alias("cosine"),
        F.round(F.when(i < 100, warm).otherwise(F.greatest(F.lit(0.0), (1000 - i) / 900.0)), 9).alias("linear"))


@register("t01_sorted_ranks", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def t01(spark, folder):
    sizes = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sizes.select("source", "n", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("bigint").alias("place"))


@register("t03_top_k_per_key", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3 AND value >= 10")
def t03(spark, folder):
    """The three best of each key, those above the threshold; ranks are limited before the shuffle."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return user_events(spark, folder).withColumn("r", r).where("r <= 3").where("value >= 10").select("user_id", "event_id", "value")


@register("t05_best_strategy", "SELECT o_custkey, o_orderpriority AS best FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY round(sum(o_totalprice) + count(*), 4) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1")
def t05(spark, folder):
    sums = table(spark, folder, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum("o_totalprice") + F.count("*"), 4).alias("score"))
    return rel.keep_first(sums, ["o_custkey"], [F.desc("score"), "o_orderpriority"]).select("o_custkey", F.col("o_orderpriority").alias("best"))


@register("t06_top_people", "SELECT l_orderkey, l_linenumber::bigint AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice * sqrt(l_quantity) DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def t06(spark, folder):
    """By score times the root of the area; ties in index order."""
    score = F.col("l_extendedprice") * F.sqrt("l_quantity")
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(score.desc(), "l_linenumber"))
    return table(spark, folder, "lineitem").withColumn("r", r).where("r <= 2").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


@register("t07_first_unique", "SELECT w, score FROM (SELECT p_type AS w, max(p_retailprice)::double AS score FROM part GROUP BY p_type) ORDER BY score DESC, w LIMIT 5")
def t07(spark, folder):
    """The first five different labels of a ranked list, each with its best score."""
    best = table(spark, folder, "part").groupBy(F.col("p_type").alias("w")).agg(F.max(F.col("p_retailprice").cast("double")).alias("score"))
    return best.orderBy(F.desc("score"), "w").limit(5)


@register("t09_local_maxima", """WITH g AS (SELECT p_size AS x, (p_partkey % 50)::bigint AS y, round(max(p_retailprice), 4) AS v FROM part GROUP BY ALL),
n AS (SELECT g.x, g.y, count(h.v) AS k FROM g LEFT JOIN g h ON abs(g.x - h.x) <= 1 AND abs(g.y - h.y) <= 1 AND NOT (g.x = h.x AND g.y = h.y) AND h.v >= g.v GROUP BY g.x, g.y)
SELECT g.x::bigint AS x, g.y, g.v FROM g JOIN n ON g.x = n.x AND g.y = n.y WHERE k = 0""")
def t09(spark, folder):
    """Cells above their eight neighbours: each cell sends its value to its neighbours, one aggregation a cell."""
    cells = table(spark, folder, "part").groupBy(F.col("p_size").cast("bigint").alias("x"), (F.col("p_partkey") % 50).alias("y")).agg(F.round(F.max("p_retailprice"), 4).alias("v"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = cells.select("x", "y", "v", F.explode(near).alias("d")).select((F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), F.when((F.col("d.i") == 0) & (F.col("d.j") == 0), F.col("v")).alias("own"), "v")
    found = sent.groupBy("x", "y").agg(F.max("own").alias("own"), F.max("v").alias("top"), F.collect_list("v").alias("vs"))
    alone = F.size(F.filter("vs", lambda u: u >= F.col("own"))) == 1
    return found.where(F.col("own").isNotNull() & alone).select("x", "y", F.col("own").alias("v"))


@register("t11_priority_rules", """SELECT page_id, CASE WHEN regexp_matches(url, '://m\\.') THEN 'mobile' WHEN regexp_matches(url, '://blog\\.') AND length(url) < 60 THEN 'blog' WHEN regexp_matches(url, '\\?') THEN 'query' ELSE 'other' END AS rule FROM pages""".replace("\\\\", "\\"))
def t11(spark, folder):
    """The rule of least priority value whose pattern hits and whose validator passes."""
    rules = [("mobile", r"://m\.", F.lit(True)), ("blog", r"://blog\.", F.length("url") < 60), ("query", r"\?", F.lit(True))]
    return table(spark, folder, "pages").select("page_id", rel.gate(*[(F.rlike("url", F.lit(p)) & ok, name) for name, p, ok in rules], passed="other").alias("rule"))


@register("g_as_of_join", """WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT l.user_id, l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of(spark, folder):
    events = user_events(spark, folder)
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    left = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return rel.as_of(left, views, ["user_id"], "ts", "value", "event_id").select("user_id", "event_id", "value")


@register("g_range_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey")
def range_join(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    near = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    return lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & near).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@register("g_full_semi_anti", "SELECT count(*) FILTER (o_orderkey IS NULL) AS no_orders, count(DISTINCT c_custkey) FILTER (o_orderkey IS NOT NULL) AS buyers FROM customer FULL JOIN orders ON c_custkey = o_custkey")
def full_semi_anti(spark, folder):
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    buyers = customers.join(orders, "c_custkey", "left_semi").agg(F.count("*"))
    return customers.join(orders, "c_custkey", "left_anti").agg(F.count("*").alias("no_orders")).select("no_orders", buyers.scalar().alias("buyers"))


@register("g_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, folder):
    return table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("bigint").alias("level"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@register("g_rollup", "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def rollup(spark, folder):
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@register("g_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""")
def pricing(spark, folder):
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@register("g_local_supplier_volume", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def volume(spark, folder):
    t = lambda n: table(spark, folder, n)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("g_tumbling_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, folder):
    w = F.window("ts", "1 day")
    return user_events(spark, folder).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@register("g_sliding_windows", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def sliding(spark, folder):
    return user_events(spark, folder).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@register("g_session_windows", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, folder):
    return user_events(spark, folder).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
