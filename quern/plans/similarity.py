"""Queries on vectors, matching and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import matching, ranking
from quern.operators import vectors as vec
from quern.plans.registry import register
from quern.sources.tables import table

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"


def embeddings(spark, folder):
    return table(spark, folder, "embeddings")


def queries(spark, folder):
    """The stated query set: every row whose id is divisible by 50, against all rows."""
    return embeddings(spark, folder).where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding", F.col("label").alias("q_label"))


E_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v, sqrt(list_inner_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))) AS s FROM embeddings)"
SIM_SQL = f"{E_SQL}, sim AS (SELECT q.vec_id AS q_id, q.label AS q_label, r.vec_id, r.label, round(list_inner_product(q.v, r.v) / (q.s * r.s), 6) AS sim FROM e q, e r WHERE q.vec_id % 50 = 0)"
RANK_SQL = f"{SIM_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS rank FROM sim WHERE q_id <> vec_id)"


def ranked(spark, folder, k):
    """The k nearest other rows of each query, relevant if of its label, and the number of relevant rows."""
    rows = embeddings(spark, folder)
    near = vec.top_k(queries(spark, folder), rows, k + 1).where("q_id <> vec_id")
    again = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id"))
    near = near.withColumn("rank", again).where(F.col("rank") <= k)
    labels = rows.select("vec_id", "label")
    own = queries(spark, folder).select("q_id", "q_label")
    hits = near.join(labels, "vec_id").join(own, "q_id").withColumn("relevant", F.col("label") == F.col("q_label"))
    sizes = rows.groupBy("label").agg((F.count("*") - 1).alias("r_q"))
    return hits, own.join(sizes, own["q_label"] == sizes["label"]).select("q_id", "q_label", "r_q")


@register("m01_cosine_to_centroid", f"WITH {E_SQL}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label) SELECT vec_id, round(list_inner_product(v, c) / (s * sqrt(list_inner_product(c, c))), 5) AS sim FROM e JOIN c ON e.label = c.label")
def m01(spark, folder):
    rows = embeddings(spark, folder)
    return rows.join(vec.centroids(rows, "label"), "label").select("vec_id", F.round(vec.cosine("embedding", "centroid"), 5).alias("sim"))


@register("m02_l2_normalise", f"WITH {E_SQL} SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x / s))), 5) AS l1, round(v[1] / s, 6) AS first FROM e")
def m02(spark, folder):
    unit = embeddings(spark, folder).select("vec_id", vec.normalised("embedding").alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"), F.round(F.col("u")[0], 6).alias("first"))


@register("m03_set_similarity", f"WITH {E_SQL}, x AS (SELECT label, vec_id % 2 AS side, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, side, i, avg(x) AS m FROM x GROUP BY ALL) SELECT a.label, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 5) AS sim FROM m a JOIN m b ON a.label = b.label AND a.i = b.i AND a.side = 0 AND b.side = 1 GROUP BY a.label")
def m03(spark, folder):
    rows = embeddings(spark, folder)
    sides = [vec.centroids(rows.where(F.col("vec_id") % 2 == s), "label").withColumnRenamed("centroid", f"c{s}") for s in (0, 1)]
    return sides[0].join(sides[1], "label").select("label", F.round(vec.cosine("c0", "c1"), 5).alias("sim"))


@register("j05_nearest_with_threshold", f"WITH {E_SQL}, a AS (SELECT q.vec_id, r.vec_id AS near, round(list_inner_product(q.v, r.v) / (q.s * r.s), 6) AS sim FROM e q, e r WHERE q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, near) AS i FROM a) SELECT vec_id, CASE WHEN sim >= 0.6 THEN near END AS near, sim FROM b WHERE i = 1")
def j05(spark, folder):
    """The nearest other row of each query, or null below the threshold."""
    best = vec.top_k(queries(spark, folder), embeddings(spark, folder), 2).where("q_id <> vec_id")
    first = F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))
    return best.withColumn("i", first).where("i = 1").select(F.col("q_id").alias("vec_id"), F.when(F.col("sim") >= 0.6, F.col("vec_id")).alias("near"), "sim")


PAIRS = f"{E_SQL}, p AS (SELECT a.vec_id // 100 AS sample, a.vec_id AS l, b.vec_id AS r, round(list_inner_product(a.v, b.v) / (a.s * b.s), 6) AS sim FROM e a JOIN e b ON a.vec_id // 100 = b.vec_id // 100 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"


def sample_pairs(spark, folder):
    """Every row belongs to a sample, a hundred successive ids; its even ids are one side, its odd ids the other.

    A sample has at most 50 * 50 pairs, so there are 25 a row, however many rows there are.
    """
    rows = embeddings(spark, folder).withColumn("sample", F.floor(F.col("vec_id") / 100).cast("bigint"))
    left = rows.where("vec_id % 2 = 0").select("sample", F.col("vec_id").alias("l"), F.col("embedding").alias("a"))
    right = rows.where("vec_id % 2 = 1").select("sample", F.col("vec_id").alias("r"), F.col("embedding").alias("b"))
    return left.join(right, "sample").select("sample", "l", "r", F.round(vec.cosine("a", "b"), 6).alias("sim"))


@register("j06_mutual_best", f"WITH {PAIRS} SELECT sample, l, r, sim FROM (SELECT *, row_number() OVER (PARTITION BY sample, l ORDER BY sim DESC, r) AS x, row_number() OVER (PARTITION BY sample, r ORDER BY sim DESC, l) AS y FROM p) WHERE x = 1 AND y = 1")
def j06(spark, folder):
    return vec.mutual_best(sample_pairs(spark, folder), "sample", "l", "r", "sim")


@register("j07_bipartite_matching")
def j07(spark, folder):
    return matching.maximum(sample_pairs(spark, folder), "sample", "l", "r", "sim", 0.2)


@register("j12_greedy_connection")
def j12(spark, folder):
    return matching.greedy(sample_pairs(spark, folder), "sample", "l", "r", "sim", 0.0)


@register("t02_top_k_cosine", f"WITH {SIM_SQL} SELECT q_id, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS i FROM sim) WHERE i <= 10")
def t02(spark, folder):
    return vec.top_k(queries(spark, folder), embeddings(spark, folder), 10).select("q_id", "vec_id", "sim")


@register("t04_rerank", f"WITH {RANK_SQL} SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY round(sim + label / 10.0::double, 6) DESC, vec_id) AS place FROM rk WHERE rank <= 10")
def t04(spark, folder):
    """The ten nearest of each query in a new order, by similarity plus a second score; the rest is never rescored."""
    hits, _ = ranked(spark, folder, 10)
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round(F.col("sim") + F.col("label") / 10.0, 6).desc(), "vec_id"))
    return hits.select("q_id", "vec_id", place.cast("bigint").alias("place"))


METRICS_SQL = f"""{RANK_SQL}, k AS (SELECT *, label = q_label AS rel FROM rk WHERE rank <= 10), z AS (SELECT label, count(*) - 1 AS r_q FROM embeddings GROUP BY label),
w AS (SELECT *, sum(rel::int) OVER (PARTITION BY q_id ORDER BY rank) / rank AS prec FROM k),
q AS (SELECT q_id, q_label, sum(rel::int) AS hits, sum(CASE WHEN rel THEN prec ELSE 0 END) AS ap, min(rank) FILTER (rel) AS first, sum(rel::int / log2(rank + 1)) AS dcg, count(*) AS depth FROM w GROUP BY q_id, q_label),
m AS (SELECT q_id, q_label, r_q, hits / depth AS precision, CASE WHEN r_q > 0 THEN ap / least(r_q, 10) END AS ap_min_rq_k, CASE WHEN hits > 0 THEN ap / hits ELSE 0 END AS ap_hits_found, CASE WHEN r_q > 0 THEN hits / r_q END AS recall,
 (hits > 0)::int::double AS hit, 1.0::double / first AS rr, CASE WHEN r_q > 0 THEN dcg / list_sum(list_transform(range(1, least(r_q, 10) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg FROM q JOIN z ON z.label = q.q_label)"""
AVERAGES = "count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("precision", "ap_min_rq_k", "ap_hits_found", "recall", "hit", "rr", "ndcg"))


def metrics(spark, folder):
    hits, sizes = ranked(spark, folder, 10)
    return ranking.query_metrics(hits, sizes, 10)


@register("r01_r05_retrieval_metrics", f"WITH {METRICS_SQL} SELECT {AVERAGES} FROM m")
def r01(spark, folder):
    return ranking.averaged(metrics(spark, folder))


@register("r06_per_class_metrics", f"WITH {METRICS_SQL} SELECT q_label, {AVERAGES} FROM m GROUP BY q_label")
def r06(spark, folder):
    return ranking.averaged(metrics(spark, folder).join(queries(spark, folder).select("q_id", "q_label"), "q_id"), "q_label")


@register("r07_tiered_metrics", f"WITH {METRICS_SQL}, t AS (SELECT *, CASE WHEN r_q >= (SELECT quantile_cont(r_q, 0.5) FROM z) THEN 'head' ELSE 'rare' END AS tier FROM m) SELECT tier, {AVERAGES} FROM t GROUP BY tier UNION ALL SELECT 'overall', {AVERAGES} FROM m")
def r07(spark, folder):
    """Overall, and by the support of the query's class: at least the median support is head."""
    found = metrics(spark, folder)
    sizes = embeddings(spark, folder).groupBy("label").agg((F.count("*") - 1).alias("s"))
    cut = sizes.agg(F.percentile("s", F.lit(0.5))).scalar()
    tier = F.when(F.col("r_q") >= cut, "head").otherwise("rare")
    return ranking.averaged(found.withColumn("tier", tier), "tier").unionByName(ranking.averaged(found.withColumn("tier", F.lit("overall")), "tier"))


@register("r08_rank_statistics", f"WITH {RANK_SQL}, f AS (SELECT q_id, min(rank) AS r FROM rk WHERE label = q_label GROUP BY q_id) SELECT round(avg(r), 6) AS mean_rank, median(r) AS median_rank, round(avg((r <= 1)::int), 6) AS r1, round(avg((r <= 5)::int), 6) AS r5, round(avg((r <= 10)::int), 6) AS r10 FROM f")
def r08(spark, folder):
    """Rank of the best relevant row of each query among all rows: one more than the rows that come before it."""
    first = vec.first_ranks(queries(spark, folder), embeddings(spark, folder), "label", "q_label").select("q_id", F.col("rank").alias("r"))
    at = lambda k: F.round(F.avg((F.col("r") <= k).cast("int")), 6).alias(f"r{k}")
    return first.agg(F.round(F.avg("r"), 6).alias("mean_rank"), F.percentile("r", F.lit(0.5)).alias("median_rank"), at(1), at(5), at(10))


@register("r09_subset_accuracy", f"WITH {RANK_SQL} SELECT k, round(avg(ok::int), 6) AS accuracy FROM (SELECT q_id, k, bool_or(label = q_label) AS ok FROM rk, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY ALL) GROUP BY k")
def r09(spark, folder):
    hits, _ = ranked(spark, folder, 5)
    at = hits.select("q_id", "rank", "relevant", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k")).where("rank <= k")
    return at.groupBy("q_id", "k").agg(F.bool_or("relevant").alias("ok")).groupBy("k").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"))


@register("r10_alignment_score", f"WITH {E_SQL}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label) SELECT e.label, round(avg(list_inner_product(v, c) / (s * sqrt(list_inner_product(c, c)))), 5) AS score FROM e JOIN c ON e.label = c.label GROUP BY e.label")
def r10(spark, folder):
    rows = embeddings(spark, folder)
    return rows.join(vec.centroids(rows, "label"), "label").groupBy("label").agg(F.round(F.avg(vec.cosine("embedding", "centroid")), 5).alias("score"))


@register("r11_stratified_metrics", f"WITH {METRICS_SQL}, s AS (SELECT *, CASE WHEN q_label % 2 = 0 THEN 'even' ELSE 'odd' END AS regime FROM m) SELECT regime, {AVERAGES} FROM s GROUP BY regime UNION ALL SELECT 'ALL', {AVERAGES} FROM s")
def r11(spark, folder):
    labelled = metrics(spark, folder).join(queries(spark, folder).select("q_id", "q_label"), "q_id")
    regime = F.when(F.col("q_label") % 2 == 0, "even").otherwise("odd")
    both = labelled.withColumn("regime", F.explode(F.array(regime, F.lit("ALL"))))
    return ranking.averaged(both, "regime")


@register("r13_pr_roc_points", """WITH s AS (SELECT lang, round(n_chars / 500) AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY ALL),
w AS (SELECT lang, score, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY lang) AS ap, sum(n) OVER (PARTITION BY lang) AS an FROM c WINDOW d AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, score, round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall, round(fp / nullif(an, 0), 6) AS fpr FROM w""")
def r13(spark, folder):
    scored = table(spark, folder, "documents").select("doc_id", "lang", F.round(F.col("n_chars") / 500).alias("score")).join(table(spark, folder, "labels"), "doc_id")
    points = ranking.curve(scored, "lang", "score", F.col("quality") == 1)
    return points.select("lang", "score", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr")])


@register("r14_argmax_accuracy", f"WITH {E_SQL}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label), a AS (SELECT vec_id, e.label, c.label AS guess, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(v, c) / (s * sqrt(list_inner_product(c, c))), 6) DESC, c.label) AS i FROM e, c) SELECT label, round(avg((label = guess)::int), 6) AS accuracy FROM a WHERE i = 1 GROUP BY label")
def r14(spark, folder):
    """The class with the most similar centroid; the class table (one row a class) is the stated query set."""
    rows = embeddings(spark, folder)
    means = vec.centroids(rows, "label").select(F.col("label").alias("q_id"), F.col("centroid").alias("embedding"))
    held = means.select(F.collect_list(F.struct("q_id", "embedding")).alias("means"))
    scored = rows.withColumn("means", held.scalar()).select("vec_id", "label", F.explode("means").alias("m"), "embedding")
    guess = scored.groupBy("vec_id", "label").agg(F.max_by("m.q_id", F.struct(F.round(vec.cosine("embedding", "m.embedding"), 6), -F.col("m.q_id"))).alias("guess"))
    return guess.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("guess")).cast("int")), 6).alias("accuracy"))


@register("a43_embedding_drift", f"WITH {E_SQL} SELECT a.label, round(1 - avg(list_inner_product(a.v, b.v) / (a.s * b.s)), 5) AS drift FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 GROUP BY a.label")
def a43(spark, folder):
    """One less the mean cosine between aligned rows: here, each row and the next."""
    rows = embeddings(spark, folder)
    base = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("base"))
    return rows.join(base, "vec_id").groupBy("label").agg(F.round(1 - F.avg(vec.cosine("embedding", "base")), 5).alias("drift"))


@register("a27_domain_shift")
def a27(spark, folder):
    return matching.domain_shift(embeddings(spark, folder).withColumn("domain", F.col("vec_id") % 2), "domain", "embedding")


@register("p09_singleton_merge", f"WITH {E_SQL}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE label < 8) GROUP BY ALL) GROUP BY label), a AS (SELECT vec_id, c.label AS target, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(v, c) / (s * sqrt(list_inner_product(c, c))), 6) DESC, c.label) AS i FROM e, c WHERE e.label >= 8) SELECT vec_id, target FROM a WHERE i = 1")
def p09(spark, folder):
    """Rows of dissolved clusters move to the nearest remaining centroid."""
    rows = embeddings(spark, folder)
    means = vec.centroids(rows.where("label < 8"), "label").select(F.collect_list(F.struct("label", "centroid")))
    scored = rows.where("label >= 8").withColumn("means", means.scalar()).select("vec_id", "embedding", F.explode("means").alias("m"))
    return scored.groupBy("vec_id").agg(F.max_by("m.label", F.struct(F.round(vec.cosine("embedding", "m.centroid"), 6), -F.col("m.label"))).alias("target"))


@register("p11_drop_low_cohesion", f"WITH {E_SQL}, p AS (SELECT a.label, avg(list_inner_product(a.v, b.v) / (a.s * b.s)) AS intra FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label), k AS (SELECT label FROM p WHERE intra >= (SELECT avg(intra) FROM p)) SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::bigint AS cluster FROM k")
def p11(spark, folder):
    """Clusters of at least the mean cohesion, numbered anew."""
    found = vec.cohesion(embeddings(spark, folder), "label")
    kept = found.where(F.col("intra") >= found.agg(F.avg("intra")).scalar())
    return kept.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("bigint").alias("cluster"))
