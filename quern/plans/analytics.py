"""Queries on label statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import distribution as dist
from quern.plans.etl import PAIR_SQL, _pairs
from quern.plans.registry import register
from quern.sources.tables import table

TOK = "t AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS w FROM documents)"
COUNTS = f"{TOK}, c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY ALL)"


def words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", "lang", F.explode(tokens("text")).alias("w"))


def counts(spark, folder, *by):
    return words(spark, folder).groupBy(*by, "w").agg(F.count("*").alias("n"))


@register("a02_frequency", f"WITH {COUNTS} SELECT lang, w, n FROM c")
def a02(spark, folder):
    return counts(spark, folder, "lang")


@register("a03_count_distinct", f"WITH {TOK} SELECT source, count(DISTINCT w) AS n_labels, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY source")
def a03(spark, folder):
    return words(spark, folder).groupBy("source").agg(F.countDistinct("w").alias("n_labels"), F.countDistinct("doc_id").alias("n_docs"))


@register("a06_lorenz", f"""WITH {COUNTS}, d AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n, w) AS i, count(*) OVER (PARTITION BY lang) AS k,
 sum(n) OVER (PARTITION BY lang ORDER BY n, w ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER (PARTITION BY lang) AS a FROM c)
SELECT lang, w, round(i / k, 9) AS label_share, round(s / a, 9) AS use_share FROM d""")
def a06(spark, folder):
    found = dist.lorenz(counts(spark, folder, "lang"), ["lang"], "w")
    return found.select("lang", "w", F.round("label_share", 9).alias("label_share"), F.round("use_share", 9).alias("use_share"))


@register("a07_power_law", f"WITH {COUNTS}, r AS (SELECT lang, ln(n) AS y, ln(row_number() OVER (PARTITION BY lang ORDER BY n DESC, w)) AS x FROM c) SELECT lang, round(-regr_slope(y, x), 6) AS exponent FROM r GROUP BY lang")
def a07(spark, folder):
    return dist.power_law(counts(spark, folder, "lang"), ["lang"], "w").select("lang", F.round("exponent", 6).alias("exponent"))


#: Label counts from which a label is head or torso.
HEAD, TORSO = 100, 10


@register("a08_tier_stats", f"""WITH {TOK}, c AS (SELECT w, count(*) AS n FROM t GROUP BY w), g AS (SELECT *, CASE WHEN n >= {HEAD} THEN 'head' WHEN n >= {TORSO} THEN 'torso' ELSE 'tail' END AS tier FROM c), m AS (SELECT tier, avg(n) AS mu, stddev_pop(n) AS sd FROM g GROUP BY tier)
SELECT g.tier, count(*) AS n_labels, round(max(mu), 6) AS mean, round(median(n), 6) AS median, round(max(sd), 6) AS std, round(max(sd) / max(mu), 6) AS cv, round(coalesce(avg(pow((n - mu) / nullif(sd, 0), 3)), 0), 4) AS skew,
 round(quantile_cont(n, 0.9), 6) AS p90, round(sum(n)::double / (SELECT sum(n) FROM c), 6) AS coverage FROM g JOIN m ON g.tier = m.tier GROUP BY g.tier""")
def a08(spark, folder):
    """Label counts within head, torso and tail, from the counts of their distinct values."""
    n, k = F.col("n").cast("double"), F.col("k")
    tier = F.when(F.col("n") >= HEAD, "head").when(F.col("n") >= TORSO, "torso").otherwise("tail")
    values = counts(spark, folder).groupBy("n").agg(F.count("*").alias("k")).withColumn("tier", tier)
    total = values.agg(F.sum(F.col("n") * k)).scalar()
    mean = values.groupBy("tier").agg((F.sum(n * k) / F.sum(k)).alias("mu"))
    spread = values.join(mean, "tier").groupBy("tier").agg(
        F.sum("k").alias("n_labels"), F.first("mu").alias("mu"), F.sqrt(F.sum(k * (n - F.col("mu")) ** 2) / F.sum(k)).alias("sd"), (F.sum(k * (n - F.col("mu")) ** 3) / F.sum(k)).alias("third"),
        F.percentile("n", F.lit(0.5), F.col("k")).alias("median"), F.percentile("n", F.lit(0.9), F.col("k")).alias("p90"), F.sum(F.col("n") * k).alias("own"))
    sd = F.col("sd")
    return spread.select(
        "tier", "n_labels", F.round("mu", 6).alias("mean"), F.round("median", 6).alias("median"), F.round(sd, 6).alias("std"), F.round(sd / F.col("mu"), 6).alias("cv"),
        F.round(F.when(sd > 0, F.col("third") / sd**3).otherwise(0.0), 4).alias("skew"), F.round("p90", 6).alias("p90"), F.round(F.col("own") / total, 6).alias("coverage"))


@register("a09_year_stats", """WITH y AS (SELECT o_orderpriority AS g, year(o_orderdate)::double AS y FROM orders), m AS (SELECT g, avg(y) AS mu, stddev_samp(y) AS sd, count(*) AS n FROM y GROUP BY g),
md AS (SELECT g, min(y) AS mode FROM (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY count(*) DESC) AS r FROM y GROUP BY g, y) WHERE r = 1 GROUP BY g)
SELECT y.g AS priority, round(max(mu), 6) AS mean, round(max(sd), 6) AS std, round(max(mu) - 1.96 * max(sd) / sqrt(max(n)), 6) AS low, round(max(mu) + 1.96 * max(sd) / sqrt(max(n)), 6) AS high,
 round(skewness(y), 5) AS skew, round(kurtosis(y), 5) AS kurt, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, max(md.mode) AS mode
FROM y JOIN m ON m.g = y.g JOIN md ON md.g = y.g GROUP BY y.g""")
def a09(spark, folder):
    """Sample skewness and excess kurtosis, bias-adjusted; Spark's own are the population forms."""
    years = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("double").alias("y"))
    n, margin = F.count("*").cast("double"), 1.96 * F.stddev_samp("y") / F.sqrt(F.count("*"))
    skew = F.skewness("y") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("y") + 6)
    return years.groupBy("priority").agg(
        F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_samp("y"), 6).alias("std"), F.round(F.avg("y") - margin, 6).alias("low"), F.round(F.avg("y") + margin, 6).alias("high"),
        F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurt"), F.percentile("y", F.lit(0.25)).alias("q1"), F.percentile("y", F.lit(0.75)).alias("q3"), F.mode("y", True).alias("mode"))


@register("a10_imbalance", f"""WITH {COUNTS}, r AS (SELECT lang, n, max(n) OVER (PARTITION BY lang) AS top, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS i, count(*) OVER (PARTITION BY lang) AS k,
 sum(n) OVER (PARTITION BY lang ORDER BY n DESC, w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY lang) AS cum FROM c)
SELECT lang, round(max(n) / min(n), 6) AS ratio, round(avg(n), 6) AS mean, median(n) AS median, count(*) FILTER (n < 0.01::double * top) AS n_rare, min(i) FILTER (cum >= 0.8::double) AS labels_for_80,
 round(max(cum) FILTER (i <= greatest(20, ceil(k * 0.1::double))), 6) AS head_coverage FROM r GROUP BY lang""")
def a10(spark, folder):
    found = dist.imbalance(counts(spark, folder, "lang"), ["lang"], "w")
    return found.select("lang", F.round("ratio", 6).alias("ratio"), F.round("mean", 6).alias("mean"), "median", "n_rare", "labels_for_80", F.round("head_coverage", 6).alias("head_coverage"))


@register("a11_crosstab", "SELECT l.quality, l.toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l.quality), 6) AS row_share FROM labels l GROUP BY l.quality, l.toxic")
def a11(spark, folder):
    cells = table(spark, folder, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return cells.withColumn("row_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("quality")), 6))


@register("a12_override_rates", """SELECT lang, count(*) AS n, round(count(*) FILTER (quality <> toxic) / count(*), 6) AS override_rate, count(*) FILTER (n_chars < 500) AS n_low, round(avg(n_chars), 4) AS mean_chars
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def a12(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("quality") != F.col("toxic")) / F.count("*"), 6).alias("override_rate"),
        F.count_if(F.col("n_chars") < 500).alias("n_low"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@register("a13_axis_moments", """SELECT event_type, axis, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, count(v) AS n FROM (
SELECT event_type, unnest(['value', 'k']) AS axis, unnest([value, try_cast(json_extract_string(props, '$.k') AS double)]) AS v FROM events) GROUP BY ALL""")
def a13(spark, folder):
    wide = table(spark, folder, "events").select("event_type", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    tall = wide.unpivot(["event_type"], ["value", "k"], "axis", "v")
    return tall.groupBy("event_type", "axis").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("median"), F.count("v").alias("n"))


@register("a14_compression", f"WITH {TOK} SELECT lang, round(1 - count(DISTINCT left(w, 4)) / count(DISTINCT w), 6) AS phi FROM t GROUP BY lang UNION ALL SELECT 'ALL', round(1 - count(DISTINCT left(w, 4)) / count(DISTINCT w), 6) FROM t")
def a14(spark, folder):
    """Share of the vocabulary saved by canonical forms (here: the first four letters), a group and overall."""
    pairs = words(spark, folder).select("lang", "w").distinct()
    phi = F.round(1 - F.countDistinct(F.left("w", F.lit(4))) / F.countDistinct("w"), 6).alias("phi")
    return pairs.groupBy("lang").agg(phi).unionByName(pairs.agg(phi).select(F.lit("ALL").alias("lang"), "phi"))


@register("a15_confidence_bins", """SELECT least(floor((value - lo) / (hi - lo) * 10), 9)::bigint AS bin, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""")
def a15(spark, folder):
    events = table(spark, folder, "events").select("value")
    low, high = events.agg(F.min("value")).scalar(), events.agg(F.max("value")).scalar()
    bin_ = F.least(F.floor((F.col("value") - low) / (high - low) * 10), F.lit(9)).cast("bigint")
    return events.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@register("a16_gate_per_sample", "SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) > 100) AS n_kept, round(count(*) FILTER (length(text) > 100) / count(*), 6) AS retained, count(*) FILTER (length(text) > 100) = 0 AS fallback, min_by(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def a16(spark, folder):
    kept = F.count_if(F.length("text") > 100)
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), kept.alias("n_kept"), F.round(kept / F.count("*"), 6).alias("retained"), (kept == 0).alias("fallback"), F.min_by("role", "turn").alias("first_role"))


EDGES = (1, 5, 10, 50, 100, 500)


@register("a17_frequency_bins", f"WITH {TOK}, c AS (SELECT w, count(*) AS n FROM t GROUP BY w) SELECT len(list_filter([{', '.join(map(str, EDGES))}], lambda e: e <= n))::bigint AS bin, count(*) AS n_labels, sum(n)::bigint AS n_uses FROM c GROUP BY 1")
def a17(spark, folder):
    edge = F.array(*[F.lit(e) for e in EDGES])
    bin_ = F.size(F.filter(edge, lambda e: e <= F.col("n"))).cast("bigint")
    return counts(spark, folder).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n_labels"), F.sum("n").alias("n_uses"))


@register("a18_cluster_entropy", "SELECT label, round(-sum(p * ln(p)), 6) AS entropy, max(k) AS k FROM (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p, count(*) OVER (PARTITION BY label) AS k FROM (SELECT label, vec_id % 7 AS sub, count(*) AS n FROM embeddings GROUP BY ALL)) GROUP BY label")
def a18(spark, folder):
    cells = table(spark, folder, "embeddings").groupBy("label", (F.col("vec_id") % 7).alias("sub")).agg(F.count("*").alias("n"))
    return dist.shares(cells, ["label"]).groupBy("label").agg(F.round(-F.sum(F.col("p") * F.ln("p")), 6).alias("entropy"), F.count("*").alias("k"))


@register("a19_agreement", f"""WITH {PAIR_SQL}, s AS (SELECT len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u, len(x) AS nx, len(y) AS ny FROM pair)
SELECT count(*) AS n, round(avg(CASE WHEN u > 0 THEN i / u END), 6) AS jaccard, round(avg(CASE WHEN i > 0 THEN 1.0::double ELSE 0 END), 6) AS overlap, round(avg(CASE WHEN i = nx AND i = ny THEN 1.0::double ELSE 0 END), 6) AS exact FROM s""")
def a19(spark, folder):
    inter, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return _pairs(spark, folder).select(inter.alias("i"), union.alias("u"), F.size("x").alias("nx"), F.size("y").alias("ny")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("u") > 0, F.col("i") / F.col("u"))), 6).alias("jaccard"),
        F.round(F.avg((F.col("i") > 0).cast("double")), 6).alias("overlap"), F.round(F.avg(((F.col("i") == F.col("nx")) & (F.col("i") == F.col("ny"))).cast("double")), 6).alias("exact"))


@register("a20_singletons", f"WITH {TOK}, c AS (SELECT source, w, count(*) AS n FROM t GROUP BY ALL) SELECT source, count(*) FILTER (n = 1) AS n_single, count(*) AS n_labels FROM c GROUP BY source")
def a20(spark, folder):
    return counts(spark, folder, "source").groupBy("source").agg(F.count_if(F.col("n") == 1).alias("n_single"), F.count("*").alias("n_labels"))


@register("a21_cooccurrence", f"""WITH {TOK}, d AS (SELECT DISTINCT doc_id, w FROM t), top AS (SELECT w, count(*) AS n FROM d GROUP BY w ORDER BY n DESC, w LIMIT 40), h AS (SELECT doc_id, d.w, n FROM d JOIN top ON d.w = top.w),
p AS (SELECT a.w AS a, b.w AS b, count(*) AS tp, max(a.n)::double AS na, max(b.n)::double AS nb FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY ALL), k AS (SELECT count(DISTINCT doc_id)::double AS n FROM d)
SELECT a, b, tp, round(tp / (na + nb - tp), 6) AS jaccard, round((tp * n - na * nb) / sqrt(na * nb * (n - na) * (n - nb)), 6) AS phi FROM p, k""")
def a21(spark, folder):
    found = dist.cooccurrence(words(spark, folder).select("doc_id", "w").distinct(), "doc_id", "w", 40)
    return found.select("a", "b", "tp", F.round("jaccard", 6).alias("jaccard"), F.round("phi", 6).alias("phi"))


@register("a22_class_weights", f"""WITH {TOK}, d AS (SELECT DISTINCT doc_id, w FROM t), c AS (SELECT w, count(*) AS f FROM d GROUP BY w), k AS (SELECT count(DISTINCT doc_id) AS n FROM d),
e AS (SELECT w, f, (n - f) / f AS pos_weight, (1 - 0.9999::double) / (1 - pow(0.9999::double, f)) AS raw FROM c, k)
SELECT w, f, round(pos_weight, 6) AS pos_weight, round(raw / avg(raw) OVER (), 6) AS effective FROM e""")
def a22(spark, folder):
    """Negative to positive ratio, and weights by the effective number of samples, scaled to mean 1."""
    items = words(spark, folder).select("doc_id", "w").distinct()
    n = items.agg(F.countDistinct("doc_id")).scalar()
    raw = (1 - F.lit(0.9999)) / (1 - F.pow(F.lit(0.9999), F.col("f")))
    freq = items.groupBy("w").agg(F.count("*").alias("f")).withColumn("raw", raw)
    mean = freq.agg(F.avg("raw")).scalar()
    return freq.select("w", "f", F.round((n - F.col("f")) / F.col("f"), 6).alias("pos_weight"), F.round(F.col("raw") / mean, 6).alias("effective"))


@register("a23_head_and_rare", """WITH c AS (SELECT p_type || p_brand AS w, count(*) AS n FROM part GROUP BY 1), r AS (SELECT w, n, coalesce(sum(n) OVER (ORDER BY n DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(n) OVER (), 0) AS before FROM c)
SELECT w, n, before <= 0.8::double AS head, n <= (SELECT quantile_cont(n, 0.2) FROM c) AS rare FROM r""")
def a23(spark, folder):
    freq = table(spark, folder, "part").groupBy(F.concat("p_type", "p_brand").alias("w")).agg(F.count("*").alias("n"))
    return dist.tiers(freq, "w")


@register("a24_shared_vocabulary", f"WITH {TOK}, s AS (SELECT w, count(DISTINCT lang) AS k, count(*) FILTER (lang = 'en') AS ref FROM t WHERE lang IN ('en', 'fr', 'de') GROUP BY w) SELECT w, ref FROM s WHERE k = 3")
def a24(spark, folder):
    """Labels of all three sources, with the reference source's frequency."""
    shared = words(spark, folder).where("lang IN ('en', 'fr', 'de')").groupBy("w").agg(F.countDistinct("lang").alias("k"), F.count_if(F.col("lang") == "en").alias("ref"))
    return shared.where("k = 3").select("w", "ref")


@register("a25_bigrams", f"""WITH x AS (SELECT doc_id, unnest(v) AS a, unnest(v[2:]) AS b FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS v FROM documents)),
g AS (SELECT a || ' ' || b AS bigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x WHERE b IS NOT NULL GROUP BY 1)
SELECT bigram, n, docs, docs > 0.08::double * (SELECT count(*) FROM documents) AS boilerplate FROM g ORDER BY n DESC, bigram LIMIT 50""")
def a25(spark, folder):
    """The fifty most frequent bigrams; boilerplate if in more than 8 % of rows."""
    docs = table(spark, folder, "documents")
    listed = docs.select("doc_id", tokens("text").alias("v")).where(F.size("v") > 1)
    pairs = listed.select("doc_id", F.explode(F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v")), lambda a, b: F.concat_ws(" ", a, b))).alias("bigram"))
    top = pairs.groupBy("bigram", "doc_id").agg(F.count("*").alias("k")).groupBy("bigram").agg(F.sum("k").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "bigram").limit(50)
    return top.withColumn("boilerplate", F.col("docs") > 0.08 * docs.agg(F.count("*")).scalar())


@register("a26_repeated_substrings", "WITH s AS (SELECT unnest(range(1, greatest(length(p_name) - 4, 1))) AS i, p_name AS t FROM part) SELECT substring(t, i::int, 6) AS piece, count(*) AS n FROM s WHERE length(trim(substring(t, i::int, 6))) = 6 GROUP BY 1 HAVING count(*) >= 20")
def a26(spark, folder):
    """Substrings of a fixed length that occur often."""
    names = table(spark, folder, "part").select(F.col("p_name").alias("t")).where(F.length("t") >= 6)
    pieces = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 5), lambda i: F.substr(F.col("t"), i, F.lit(6)))).alias("piece"))
    return pieces.where(F.length(F.trim("piece")) == 6).groupBy("piece").agg(F.count("*").alias("n")).where("n >= 20")


@register("a29_fold_average", "SELECT o_orderpriority AS metric, round(avg(v), 4) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high FROM (SELECT o_orderpriority, o_custkey % 5 AS fold, avg(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY 1")
def a29(spark, folder):
    folds = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("metric"), (F.col("o_custkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("v"))
    return folds.groupBy("metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"))


@register("a30_array_reductions", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) AS s, round(list_sum(list_transform(embedding, lambda x: abs(x::double))), 6) AS asum, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) AS sumsq, round(list_sum(list_transform(embedding, lambda x: x::double)) / len(embedding), 6) AS mean FROM embeddings")
def a30(spark, folder):
    def fold(f):
        return F.aggregate("embedding", F.lit(0.0), lambda s, x: s + f(x.cast("double")))

    return table(spark, folder, "embeddings").select(
        "vec_id", F.round(fold(lambda x: x), 6).alias("s"), F.round(fold(F.abs), 6).alias("asum"), F.round(fold(lambda x: x * x), 6).alias("sumsq"), F.round(fold(lambda x: x) / F.size("embedding"), 6).alias("mean"))


@register("a31_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part) SELECT round(corr(x, y), 6) AS rho FROM r""")
def a31(spark, folder):
    """Correlation of average ranks; values are counted first, so the ranking window sees one row a value."""
    part = table(spark, folder, "part").select("p_size", "p_retailprice")

    def ranks(column):
        sizes = part.groupBy(column).agg(F.count("*").alias("k"))
        before = F.coalesce(F.sum("k").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sizes.select(column, (before + (F.col("k") + 1) / 2).alias(f"r_{column}"))

    both = part.join(ranks("p_size"), "p_size").join(ranks("p_retailprice"), "p_retailprice")
    return both.agg(F.round(F.corr("r_p_size", "r_p_retailprice"), 6).alias("rho"))


@register("a35_synthetic_zipf", """WITH e AS (SELECT unnest(range(0, 100)) AS k), x AS (SELECT k, 0.5::double + k / 99.0::double AS s FROM e), i AS (SELECT unnest(range(1, 101)) AS r), f AS (SELECT k, s, r, 1000 / pow(r, s) AS v FROM x, i),
g AS (SELECT k, max(s) AS s, 2 * sum((101 - r) * v) / (100 * sum(v)) - 101.0::double / 100 AS gini FROM f GROUP BY k) SELECT round(s, 6) AS exponent, round(gini, 6) AS gini FROM g ORDER BY abs(gini - 0.6::double), k LIMIT 1""")
def a35(spark, folder):
    """The Zipf exponent of a grid whose frequencies over 100 labels have a Gini closest to 0.6."""
    grid = spark.range(100).select(F.col("id").alias("k"), (0.5 + F.col("id") / 99.0).alias("s")).select("k", "s", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("r"))
    v = 1000 / F.pow(F.col("r"), F.col("s"))
    found = grid.groupBy("k").agg(F.max("s").alias("s"), (2 * F.sum((101 - F.col("r")) * v) / (100 * F.sum(v)) - 1.01).alias("gini"))
    return found.orderBy(F.abs(F.col("gini") - 0.6), "k").limit(1).select(F.round("s", 6).alias("exponent"), F.round("gini", 6).alias("gini"))


@register("a36_top_n_other", f"WITH {TOK}, c AS (SELECT source AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM t GROUP BY source) SELECT CASE WHEN i <= 5 THEN label ELSE 'Other' END AS label, sum(n)::bigint AS n FROM c GROUP BY 1")
def a36(spark, folder):
    ranked = words(spark, folder).groupBy("source").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(Window.orderBy(F.desc("n"), "source")))
    return ranked.groupBy(F.when(F.col("i") <= 5, F.col("source")).otherwise("Other").alias("label")).agg(F.sum("n").alias("n"))


@register("a37_absolute_tiers", f"WITH {TOK}, c AS (SELECT w, count(*) AS n FROM t GROUP BY w) SELECT CASE WHEN n > 500 THEN 'head' WHEN n < 20 THEN 'tail' ELSE 'torso' END AS tier, count(*) AS n_labels, sum(n)::bigint AS n_uses FROM c GROUP BY 1")
def a37(spark, folder):
    tier = F.when(F.col("n") > 500, "head").when(F.col("n") < 20, "tail").otherwise("torso")
    return counts(spark, folder).groupBy(tier.alias("tier")).agg(F.count("*").alias("n_labels"), F.sum("n").alias("n_uses"))


@register("a38_vocabulary_funnel", f"WITH {TOK} SELECT count(*) AS n_uses, count(DISTINCT w) AS n_raw, count(DISTINCT CASE WHEN length(w) >= 3 THEN w END) AS n_long, count(DISTINCT CASE WHEN length(w) >= 3 THEN left(w, 4) END) AS n_canonical FROM t")
def a38(spark, folder):
    """Distinct counts by stage; each word is counted once before the stages."""
    once = counts(spark, folder)
    long = F.when(F.length("w") >= 3, F.col("w"))
    return once.agg(F.sum("n").alias("n_uses"), F.count("*").alias("n_raw"), F.count(long).alias("n_long"), F.countDistinct(F.left(long, F.lit(4))).alias("n_canonical"))


@register("a39_regime_label_matrix", f"""WITH {TOK}, d AS (SELECT DISTINCT doc_id, lang, w FROM t), top AS (SELECT w FROM d GROUP BY w ORDER BY count(*) DESC, w LIMIT 15), s AS (SELECT lang, count(DISTINCT doc_id) AS k FROM d GROUP BY lang)
SELECT d.lang, d.w, round(count(*) / max(k), 6) AS share FROM d JOIN top ON d.w = top.w JOIN s ON s.lang = d.lang GROUP BY d.lang, d.w""")
def a39(spark, folder):
    items = words(spark, folder).select("doc_id", "lang", "w").distinct()
    top = items.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(15).select("w")
    sizes = items.groupBy("lang").agg(F.countDistinct("doc_id").alias("k"))
    cells = items.join(F.broadcast(top), "w").groupBy("lang", "w").agg(F.count("*").alias("n")).join(sizes, "lang")
    return cells.select("lang", "w", F.round(F.col("n") / F.col("k"), 6).alias("share"))


@register("a40_labels_per_sample", f"WITH {TOK}, d AS (SELECT doc_id, lang, count(DISTINCT w) AS k FROM t GROUP BY ALL) SELECT lang, k, count(*) AS n FROM d GROUP BY ALL")
def a40(spark, folder):
    sizes = table(spark, folder, "documents").select("lang", F.size(F.array_distinct(tokens("text"))).cast("bigint").alias("k"))
    return sizes.where("k > 0").groupBy("lang", "k").agg(F.count("*").alias("n"))


@register("a42_mode", "SELECT c_mktsegment, min(c_nationkey)::bigint AS mode FROM (SELECT c_mktsegment, c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC) AS r FROM customer GROUP BY c_mktsegment, c_nationkey) WHERE r = 1 GROUP BY 1")
def a42(spark, folder):
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.mode("c_nationkey", True).cast("bigint").alias("mode"))


@register("a44_box_heatmap", "WITH b AS (SELECT p_size % 20 AS x, length(p_name) % 20 AS y FROM part), c AS (SELECT unnest(range(x, x + 3)) AS x, y FROM b), d AS (SELECT x, unnest(range(y, y + 2)) AS y FROM c) SELECT x::bigint AS x, y::bigint AS y, count(*) AS n FROM d GROUP BY ALL")
def a44(spark, folder):
    """Each box adds one to the cells it covers."""
    boxes = table(spark, folder, "part").select((F.col("p_size") % 20).cast("bigint").alias("x"), (F.length("p_name") % 20).cast("bigint").alias("y"))
    cells = boxes.select(F.explode(F.sequence("x", F.col("x") + 2)).alias("x"), "y").select("x", F.explode(F.sequence("y", F.col("y") + 1)).alias("y"))
    return cells.groupBy("x", "y").agg(F.count("*").alias("n"))
