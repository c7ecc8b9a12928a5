"""Queries of the supervision audit, on derived columns that stand for model outputs."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quern.operators import regimes as reg
from quern.plans.registry import register
from quern.sources.tables import table

#: Entailment scores are synthetic here: fixed functions of ids.
RAW = """s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS nl, count(*) FILTER (role <> 'user') AS nr, count(*) FILTER (length(text) % 3 = 0) AS m, sum(length(text)) AS chars FROM conversations GROUP BY conv_id),
g AS (SELECT *, CASE WHEN nl + nr > 0 THEN greatest(0, (nl + nr - 2 * least(m, least(nl, nr))) / (nl + nr)) END AS orphan, CASE WHEN chars % 11 = 0 THEN NULL ELSE round((chars % 100) / 100.0::double - 0.5::double, 4) END AS gap FROM s),
r AS (SELECT *, CASE WHEN chars % 29 = 0 THEN 'INVALID_JSON' WHEN nl = 0 OR nr = 0 THEN 'MISSING_MODALITY' WHEN orphan >= 0.6::double THEN 'HARD_CONFLICT' WHEN gap IS NULL THEN 'HARD_CONFLICT' WHEN abs(gap) >= 0.25::double THEN 'SOFT_CONFLICT' ELSE 'AGREEMENT' END AS regime FROM g)"""


def receipts(spark, folder):
    turns = table(spark, folder, "conversations")
    sums = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("nl"), F.count_if(F.col("role") != "user").alias("nr"),
        F.count_if(F.length("text") % 3 == 0).alias("m"), F.sum(F.length("text")).alias("chars"))
    matched = F.least("m", F.least("nl", "nr"))
    gap = F.when(F.col("chars") % 11 != 0, F.round((F.col("chars") % 100) / 100.0 - 0.5, 4))
    known = sums.withColumn("orphan", reg.orphan_ratio(F.col("nl"), F.col("nr"), matched)).withColumn("gap", gap)
    return known.withColumn("regime", reg.regime(F.col("chars") % 29 != 0, F.col("nl"), F.col("nr"), F.col("orphan"), F.col("gap")))


@register("f14_conflict_regimes", f"WITH {RAW} SELECT conv_id, round(orphan, 6) AS orphan, gap, regime FROM r")
def f14(spark, folder):
    return receipts(spark, folder).select("conv_id", F.round("orphan", 6).alias("orphan"), "gap", "regime")


@register("m04_orphan_ratio", f"WITH {RAW} SELECT regime, count(*) AS n, round(avg(orphan), 6) AS orphan FROM r GROUP BY regime")
def m04(spark, folder):
    return receipts(spark, folder).groupBy("regime").agg(F.count("*").alias("n"), F.round(F.avg("orphan"), 6).alias("orphan"))


ENTAIL = "p AS (SELECT a.conv_id, a.turn AS l, b.turn AS r, ((a.turn * 7 + b.turn * 13 + a.conv_id) % 100) / 100.0::double AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role <> 'user')"


@register("m05_asymmetry_gap", f"WITH {ENTAIL}, x AS (SELECT conv_id, round(avg(m), 4) AS a FROM (SELECT conv_id, l, max(s) AS m FROM p GROUP BY ALL) GROUP BY conv_id), y AS (SELECT conv_id, round(avg(m), 4) AS b FROM (SELECT conv_id, r, max(s) AS m FROM p GROUP BY ALL) GROUP BY conv_id) SELECT conv_id, a AS left_to_right, b AS right_to_left, round(a - b, 4) AS gap FROM x FULL JOIN y USING (conv_id)")
def m05(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    left = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("l"))
    right = turns.where("role <> 'user'").select("conv_id", F.col("turn").alias("r"))
    scored = left.join(right, "conv_id").withColumn("s", ((F.col("l") * 7 + F.col("r") * 13 + F.col("conv_id")) % 100) / 100.0)
    return reg.asymmetry(scored, "conv_id", "l", "r", "s")


@register("m06_concept_scores", """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS w FROM documents), c AS (SELECT w, count(*) AS f FROM t GROUP BY w)
SELECT w, f, round(1 - ln(1.0::double + f) / ln(1.0::double + (SELECT max(f) FROM c)), 4) AS coverage, round((1 - exp(-0.05::double * f)) * CASE WHEN length(w) > 3 THEN 1.0::double ELSE 0.8 END, 4) AS density FROM c""")
def m06(spark, folder):
    from quern.plans.analytics import counts

    freq = counts(spark, folder).withColumnRenamed("n", "f")
    top = freq.agg(F.max("f")).scalar()
    local = F.when(F.length("w") > 3, 1.0).otherwise(reg.PENALTY)
    return freq.select("w", "f", reg.coverage_score(F.col("f"), top).alias("coverage"), reg.density_score(F.col("f"), local).alias("density"))


@register("m07_regime_weights", f"""WITH {RAW} SELECT conv_id, round(CASE regime WHEN 'AGREEMENT' THEN 1.0::double WHEN 'SOFT_CONFLICT' THEN greatest(0.5::double, 1 - abs(gap)) WHEN 'HARD_CONFLICT' THEN 0.3 WHEN 'MISSING_MODALITY' THEN 0.5 ELSE 0 END, 4) AS w_pos,
 round(CASE WHEN regime = 'HARD_CONFLICT' THEN greatest(0, 1 - coalesce(orphan, 1)) ELSE 0 END::double, 4) AS w_neg FROM r""")
def m07(spark, folder):
    positive, negative = reg.weights(F.col("regime"), F.col("gap"), F.col("orphan"))
    return receipts(spark, folder).select("conv_id", positive.alias("w_pos"), negative.alias("w_neg"))


@register("m08_gmm_routing")
def m08(spark, folder):
    """Scale, fit three components, route by the most probable one; under 0.6 the rule's regime stays."""
    rows = receipts(spark, folder).select("conv_id", "regime", "orphan", F.coalesce("gap", F.lit(0.0)).alias("gap"))
    vectors = VectorAssembler(inputCols=["orphan", "gap"], outputCol="raw").transform(rows)
    scaled = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(vectors).transform(vectors)
    model = GaussianMixture(k=3, seed=42).fit(scaled)
    routed = model.transform(scaled).withColumn("p", F.array_max(vector_to_array("probability")))
    return routed.select("conv_id", "regime", "prediction", F.round("p", 4).alias("confidence"), (F.col("p") >= 0.6).alias("override"))


@register("p12_gmm_selection")
def p12(spark, folder):
    """Log likelihood, AIC and BIC for two to six components of a full covariance in two dimensions."""
    rows = receipts(spark, folder).select("orphan", F.coalesce("gap", F.lit(0.0)).alias("gap"))
    vectors = VectorAssembler(inputCols=["orphan", "gap"], outputCol="features").transform(rows).cache()
    n, found = vectors.count(), []
    import math

    for k in range(2, 7):
        likelihood = GaussianMixture(k=k, seed=42).fit(vectors).summary.logLikelihood
        free = k * 2 + k * 3 + k - 1
        found.append((k, likelihood, 2 * free - 2 * likelihood, free * math.log(max(n, 1)) - 2 * likelihood))
    return spark.createDataFrame(found, "k int, log_likelihood double, aic double, bic double")


@register("m09_normalisation", """SELECT event_id, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.5), 6) AS minmax, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0.5), 5) AS z,
 round(value / sqrt(sum(value * value) OVER w), 6) AS l2 FROM events WINDOW w AS (PARTITION BY event_type)""")
def m09(spark, folder):
    found = reg.normalise(table(spark, folder, "events").select("event_id", "event_type", "value"), "event_type", "value")
    return found.select("event_id", F.round("minmax", 6).alias("minmax"), F.round("z", 5).alias("z"), F.round("l2", 6).alias("l2"))


SCORE = "s AS (SELECT doc_id, lang, (n_chars % 997) / 997.0::double AS score FROM documents), g AS (SELECT unnest(range(0, 41)) AS i)"
SWEEP = f"{SCORE}, w AS (SELECT i / 40 AS tau, count(score) AS n, avg(score) AS mean FROM g LEFT JOIN s ON floor(score * 40) >= i GROUP BY i)"


def scores(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", ((F.col("n_chars") % 997) / 997.0).alias("score"))


@register("m11_threshold_sweep", f"WITH {SWEEP} SELECT round(tau, 6) AS tau, n, round(mean, 6) AS mean FROM w")
def m11(spark, folder):
    found = reg.sweep(scores(spark, folder), "score", 40)
    return found.select(F.round("tau", 6).alias("tau"), "n", F.round("mean", 6).alias("mean"))


@register("m10_knee", f"""WITH {SWEEP}, u AS (SELECT tau, n, (tau - min(tau) OVER ()) / (max(tau) OVER () - min(tau) OVER ()) AS x, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())::double AS y FROM w),
c AS (SELECT *, first(x) OVER o AS x0, last(x) OVER o AS x1, first(y) OVER o AS y0, last(y) OVER o AS y1 FROM u WINDOW o AS (ORDER BY tau ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT round(tau, 6) AS tau, n, round(abs((y1 - y0) * x - (x1 - x0) * y + x1 * y0 - y1 * x0), 9) AS distance FROM c ORDER BY distance DESC, tau LIMIT 1""")
def m10(spark, folder):
    points = reg.sweep(scores(spark, folder), "score", 40).select("tau", "n")
    return reg.knee(points, "tau", "n").withColumn("tau", F.round("tau", 6))


@register("m12_best_f1_threshold", """WITH s AS (SELECT (n_chars % 997) / 997.0::double AS score, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT unnest(range(15, 96)) / 100.0::double AS tau),
f AS (SELECT tau, count(*) FILTER (score >= tau AND quality = 1) AS tp, count(*) FILTER (score >= tau AND quality = 0) AS fp, count(*) FILTER (score < tau AND quality = 1) AS fn FROM s, g GROUP BY tau)
SELECT tau, round(2 * tp / (2 * tp + fp + fn)::double, 6) AS f1 FROM f ORDER BY f1 DESC, tau LIMIT 1""")
def m12(spark, folder):
    """The smallest threshold of a grid with the best F1; the grid is 81 values a row, aggregated before the shuffle."""
    rows = scores(spark, folder).join(table(spark, folder, "labels"), "doc_id").select("score", "quality")
    grid = rows.withColumn("tau", F.explode(F.array(*[F.lit(i / 100.0) for i in range(15, 96)])))
    over, good = F.col("score") >= F.col("tau"), F.col("quality") == 1
    found = grid.groupBy("tau").agg(F.count_if(over & good).alias("tp"), F.count_if(over & ~good).alias("fp"), F.count_if(~over & good).alias("fn"))
    f1 = F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1")
    return found.select("tau", f1).orderBy(F.desc("f1"), "tau").limit(1)


@register("m13_relative_gap", "WITH m AS (SELECT lang, avg(n_chars) FILTER (quality = 1) AS head, avg(n_chars) FILTER (quality = 0) AS rare FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, round((rare - head) / (head + 1e-8), 6) AS gap FROM m")
def m13(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    means = rows.groupBy("lang").agg(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("head"), F.avg(F.when(F.col("quality") == 0, F.col("n_chars"))).alias("rare"))
    return means.select("lang", F.round((F.col("rare") - F.col("head")) / (F.col("head") + F.lit(1e-8)), 6).alias("gap"))


@register("m14_softmax", "WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM embeddings) SELECT vec_id, i::bigint AS i, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 7) AS p, round(1 / (1 + exp(-x)), 7) AS s FROM x")
def m14(spark, folder):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.exp(x.cast("double")))
    rows = table(spark, folder, "embeddings").select("vec_id", total.alias("z"), F.posexplode("embedding").alias("i", "x"))
    x = F.col("x").cast("double")
    return rows.select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round(F.exp(x) / F.col("z"), 7).alias("p"), F.round(1 / (1 + F.exp(-x)), 7).alias("s"))


@register("m15_weighted_bce", "WITH s AS (SELECT lang, least(greatest((n_chars % 997) / 997.0::double, 1e-6), 1 - 1e-6) AS p, quality AS y, 1 + toxic AS w FROM documents JOIN labels USING (doc_id)) SELECT lang, round(sum(-w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 6) AS loss FROM s GROUP BY lang")
def m15(spark, folder):
    rows = scores(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    p, y, w = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6)), F.col("quality"), 1 + F.col("toxic")
    return rows.groupBy("lang").agg(F.round(F.sum(-w * (y * F.ln(p) + (1 - y) * F.ln(1 - p))) / F.sum(w), 6).alias("loss"))


@register("m16_weight_resolution", f"WITH {RAW} SELECT conv_id, CASE WHEN regime = 'INVALID_JSON' THEN 0 ELSE greatest(0.05::double, least(1.0::double, coalesce(gap * 2, 0.05::double))) END AS w FROM r")
def m16(spark, folder):
    return receipts(spark, folder).select("conv_id", reg.resolved_weight(F.col("regime"), F.col("gap") * 2, ["INVALID_JSON"]).alias("w"))


@register("m17_json_flatten", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.key') AS bigint), try_cast(json_extract_string(props, '$.k') AS bigint)) AS k FROM events")
def m17(spark, folder):
    """The first of several alias keys that is there."""
    at = lambda path: F.try_variant_get(F.try_parse_json("props"), path, "bigint")
    return table(spark, folder, "events").select("event_id", F.coalesce(at("$.key"), at("$.k")).alias("k"))


@register("m21_elementwise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(x::double, 0))), 6) AS relu, round(list_sum(list_transform(embedding, lambda x: tanh(x::double))), 6) AS tanh, round(list_sum(list_transform(embedding, lambda x: pow(x::double, 2) * 0.5 + 1)), 6) AS power, round(list_sum(list_transform(embedding, lambda x: least(greatest(x::double, -0.1), 0.1))), 6) AS clip FROM embeddings")
def m21(spark, folder):
    def total(f):
        return F.round(F.aggregate(F.transform("embedding", lambda x: f(x.cast("double"))), F.lit(0.0), lambda s, x: s + x), 6)

    return table(spark, folder, "embeddings").select(
        "vec_id", total(lambda x: F.greatest(x, F.lit(0.0))).alias("relu"), total(F.tanh).alias("tanh"), total(lambda x: F.pow(x, F.lit(2.0)) * 0.5 + 1).alias("power"),
        total(lambda x: F.least(F.greatest(x, F.lit(-0.1)), F.lit(0.1))).alias("clip"))
