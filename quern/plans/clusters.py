"""Queries on the quality and the names of clusters of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import cluster_quality as quality
from quern.operators import clustering
from quern.operators import vectors as vec
from quern.plans.registry import register
from quern.plans.similarity import E_SQL, embeddings
from quern.sources.scratch import scratch
from quern.sources.tables import table

#: One row a (cluster, name): the names of parts under the clusters of their vectors, with the mean of these.
POINTS = f"""{E_SQL}, freq AS (SELECT lower(p_name) AS name, count(*) AS f FROM part GROUP BY 1), mem AS (SELECT e.label AS cluster, lower(p_name) AS name, e.v FROM e JOIN part ON p_partkey = vec_id + 1),
pc AS (SELECT cluster, name, i, avg(x) AS m FROM (SELECT cluster, name, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM mem) GROUP BY ALL),
pv AS (SELECT cluster, name, list(m ORDER BY i) AS v FROM pc GROUP BY ALL), pts AS (SELECT cluster, name, f, v, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u, string_split(name, ' ') AS t FROM pv JOIN freq USING (name)),
cen AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pts) GROUP BY ALL) GROUP BY cluster)"""
NAMES = f"""{POINTS}, per AS (SELECT cluster, count(*) AS n, max(f) AS top, max(len(t)) AS longest FROM pts GROUP BY cluster), hd AS (SELECT cluster, t[-1] AS h, count(*) AS k FROM pts GROUP BY ALL),
ct AS (SELECT a.cluster, a.name, count(*) AS c FROM pts a JOIN pts b ON a.cluster = b.cluster AND list_has_all(b.t, a.t) GROUP BY ALL),
sg AS (SELECT p.cluster, p.name, f, round(list_cosine_similarity(p.v, cen.c), 9) AS sim, list_cosine_similarity(p.v, cen.c) AS s, ln(1 + f) / ln(1 + top) AS fr, k / n AS h, ct.c / n AS co, 1 - (len(t) - 1) / longest AS br FROM pts p JOIN cen USING (cluster) JOIN per USING (cluster) JOIN hd ON hd.cluster = p.cluster AND hd.h = t[-1] JOIN ct ON ct.cluster = p.cluster AND ct.name = p.name),
sc AS (SELECT *, round(0.30::double * s + 0.15::double * fr + 0.20::double * h + 0.25::double * co + 0.10::double * br, 9) AS score FROM sg),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, name) AS i, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, name) AS j FROM sc),
ch AS (SELECT b.cluster, b.name <> p.name AND b.f / greatest(p.f, 1) >= 3 AS overruled, CASE WHEN b.f / greatest(p.f, 1) >= 3 THEN b.name ELSE p.name END AS canonical, CASE WHEN b.f / greatest(p.f, 1) >= 3 THEN b.score ELSE p.score END AS score FROM rk b JOIN rk p ON b.cluster = p.cluster AND b.i = 1 AND p.j = 1)"""
PROFILE = f"""{NAMES}, pr AS (SELECT a.cluster, a.name, b.name AS other, list_inner_product(a.u, b.u) AS sim FROM pts a JOIN pts b ON a.cluster = b.cluster),
ia AS (SELECT cluster, avg(sim) AS intra, 1 - min(sim) AS diameter FROM pr WHERE name <> other GROUP BY cluster), rp AS (SELECT cluster, name, avg(sim) AS rep FROM pr GROUP BY ALL),
en AS (SELECT cluster, sum(f) AS coverage, -sum(f / w * ln(f / w)) AS entropy FROM (SELECT cluster, f, sum(f) OVER (PARTITION BY cluster) AS w FROM pts) GROUP BY cluster),
pf AS (SELECT per.cluster, n AS size, canonical, coalesce(intra, 1) AS intra, greatest(coalesce(diameter, 0), 0) AS diameter, rep, entropy, coverage FROM per JOIN ch USING (cluster) JOIN rp ON rp.cluster = per.cluster AND rp.name = ch.canonical JOIN en ON en.cluster = per.cluster LEFT JOIN ia ON ia.cluster = per.cluster)"""


def named_points(spark, folder):
    parts = table(spark, folder, "part").select((F.col("p_partkey") - 1).alias("vec_id"), F.lower("p_name").alias("name"))
    members = embeddings(spark, folder).join(parts, "vec_id").select(F.struct(F.col("label").cast("bigint").alias("cluster"), "name").alias("k"), "embedding")
    frequency = parts.groupBy("name").agg(F.count("*").alias("f"))
    return vec.centroids(members, "k").select("k.cluster", "k.name", F.col("centroid").alias("v")).join(frequency, "name").select("cluster", "name", "f", "v")


def _named(spark, folder):
    """Points and names, each written once, as every measure reads them."""
    points = _written(spark, named_points(spark, folder))
    return points, _written(spark, quality.canonical_names(points, "cluster", "name", "f", "v"))


def _written(spark, frame):
    path = scratch(spark)
    frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@register("p10_canonical_label", f"WITH {NAMES} SELECT cluster::bigint AS cluster, canonical, round(score, 6) AS score, overruled FROM ch")
def p10(spark, folder):
    """The name of each cluster by similarity, frequency, head word, containment and brevity."""
    return _named(spark, folder)[1].withColumn("score", F.round("score", 6))


@register("a32_cluster_quality", f"""WITH {PROFILE} SELECT cluster::bigint AS cluster, size, canonical, round(intra, 5) AS intra, round(diameter, 5) AS diameter, round(rep, 5) AS representativeness, round(entropy, 5) AS entropy, coverage::bigint AS coverage,
 coalesce(nullif(concat_ws('|', CASE WHEN intra < 0.5 THEN 'LOW_COHESION' END, CASE WHEN rep < 0.6 THEN 'POOR_CANONICAL' END, CASE WHEN diameter > 0.8 THEN 'LARGE_DIAMETER' END, CASE WHEN size = 1 THEN 'SINGLETON' END), ''), 'OK') AS flags FROM pf""")
def a32(spark, folder):
    points, names = _named(spark, folder)
    found = quality.profile(points, names, "cluster", "name", "f", "v")
    return found.select("cluster", "size", "canonical", *[F.round(c, 5).alias(c) for c in ("intra", "diameter", "representativeness", "entropy")], "coverage", "flags")


@register("a32_size_quantiles", "WITH z AS (SELECT count(*) AS size FROM embeddings GROUP BY label) SELECT count(*) AS n_clusters, count(*) FILTER (size = 1) AS singletons, quantile_cont(size, 0.25)::double AS p25, quantile_cont(size, 0.5)::double AS p50, quantile_cont(size, 0.75)::double AS p75, quantile_cont(size, 0.9)::double AS p90, quantile_cont(size, 0.99)::double AS p99 FROM z")
def a32_sizes(spark, folder):
    sizes = embeddings(spark, folder).groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("k"))
    points = [F.percentile("size", F.lit(p), F.col("k")).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75, 0.9, 0.99)]
    return sizes.agg(F.sum("k").alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("k"))), F.lit(0).cast("bigint")).alias("singletons"), *points)


@register("a33_cluster_validation", f"""WITH {PROFILE}, cp AS (SELECT avg(1 - list_cosine_similarity(a.c, b.c)) AS separation, min(1 - list_cosine_similarity(a.c, b.c)) AS nearest FROM cen a JOIN cen b ON a.cluster <> b.cluster),
dd AS (SELECT a.cluster, a.name, b.cluster AS oc, sum(1 - list_inner_product(a.u, b.u)) AS d, count(*) AS m FROM pts a, pts b GROUP BY ALL),
sa AS (SELECT cluster, name, max(CASE WHEN oc = cluster THEN d / greatest(m - 1, 1) END) AS a, min(CASE WHEN oc <> cluster THEN d / m END) AS b, max(CASE WHEN oc = cluster THEN m END) AS m FROM dd GROUP BY ALL),
si AS (SELECT (avg(CASE WHEN m = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) + 1) / 2 AS silhouette FROM sa),
bs AS (SELECT r.cluster, avg(rep) AS base FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY name) AS i FROM rp) r WHERE i <= 10 GROUP BY r.cluster),
nm AS (SELECT avg(greatest(0, 1 - (len(string_split(canonical, ' ')) - al) / (al + 1e-10))) AS generality, least(avg(CASE WHEN size > 1 THEN (pf.rep - base) / base END) / 0.2::double, 1) AS centroid_method, avg(fc / top) AS frequency FROM pf JOIN bs USING (cluster) JOIN per USING (cluster) JOIN (SELECT cluster, avg(len(t)) AS al FROM pts GROUP BY cluster) USING (cluster) JOIN (SELECT cluster, name AS canonical, f AS fc FROM pts) USING (cluster, canonical)),
gi AS (SELECT 2 * sum(i * size)::double / (count(*) * sum(size)) - (count(*) + 1)::double / count(*) AS g FROM (SELECT size, row_number() OVER (ORDER BY size) AS i FROM pf)),
ba AS (SELECT avg(intra) FILTER (size > 1) AS cohesion, max(diameter) AS diameter, avg(rep) AS representativeness, 1 - (count(*) FILTER (size > 1 AND intra < 0.5))::double / count(*) AS no_outliers, count(DISTINCT canonical)::double / count(*) AS uniqueness FROM pf),
al AS (SELECT cohesion, separation, least(nearest / (diameter + 1e-10) / 0.5, 1) AS dunn, silhouette, 1 - least(g, 1) AS size_balance, no_outliers, representativeness, generality, uniqueness, centroid_method, frequency FROM ba, cp, si, nm, gi)
SELECT round(cohesion, 5) AS cohesion, round(separation, 5) AS separation, round(dunn, 5) AS dunn, round(silhouette, 5) AS silhouette, round(size_balance, 5) AS size_balance, round(no_outliers, 5) AS no_outliers, round(representativeness, 5) AS representativeness, round(generality, 5) AS generality, round(uniqueness, 5) AS uniqueness, round(centroid_method, 5) AS centroid_method, round(frequency, 5) AS frequency,
 round((0.20::double * cohesion + 0.10::double * separation + 0.10::double * dunn + 0.10::double * silhouette + 0.05::double * size_balance + 0.05::double * no_outliers + 0.20::double * representativeness + 0.10::double * generality + 0.05::double * uniqueness + 0.05::double * centroid_method + 0.10::double * frequency) / 1.1::double, 5) AS overall FROM al""")
def a33(spark, folder):
    points, names = _named(spark, folder)
    found = quality.validation(points, names, "cluster", "name", "f", "v")
    return found.select(*[F.round(c, 5).alias(c) for c in found.columns])


@register("p16_super_clusters")
def p16(spark, folder):
    """Ward's tree of group centroids, cut at the height of a grid with the best cosine silhouette."""
    groups = embeddings(spark, folder).withColumn("g", F.concat_ws("-", "label", F.col("vec_id") % 7))
    return clustering.super_clusters(vec.centroids(groups, "g"), "g", "centroid")
