"""Queries on sampling, clustering and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import clustering, naming, sampling
from quern.operators import vectors as vec
from quern.plans.registry import register
from quern.sources.tables import table
from quern.streaming import jobs


@register("p01_stratified_split", "WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('split:' || doc_id), doc_id) AS i FROM documents) SELECT doc_id, source, CASE WHEN i <= round(n * 0.35::double) THEN 'val' ELSE 'train' END AS split FROM r WHERE n > 1")
def p01(spark, folder):
    return sampling.stratified_split(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", "source", 0.35)


ITEMS = "t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS w FROM documents)"


@register("p02_multilabel_split", f"""WITH {ITEMS}, c AS (SELECT w, count(*) AS f FROM t GROUP BY w HAVING count(*) >= 6), s AS (SELECT doc_id, w AS stratum FROM (SELECT doc_id, t.w, row_number() OVER (PARTITION BY doc_id ORDER BY f, t.w) AS i FROM t JOIN c ON t.w = c.w) WHERE i = 1),
r AS (SELECT doc_id, stratum, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('multi:' || doc_id), doc_id) AS i FROM s) SELECT doc_id, stratum, CASE WHEN i <= round(n * 0.35::double) THEN 'val' ELSE 'train' END AS split FROM r WHERE n > 1""")
def p02(spark, folder):
    items = table(spark, folder, "documents").select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("w"))
    return sampling.multilabel_split(items, "doc_id", "w", 0.35, 2)


@register("p03_hash_split", "SELECT doc_id, CASE WHEN md5('plain:' || doc_id) < 'a6' THEN 'train' ELSE 'val' END AS split FROM documents")
def p03(spark, folder):
    """A seeded split without any shuffle: the hash alone decides (0xa6 / 256 is 65 %)."""
    return table(spark, folder, "documents").select("doc_id", F.when(sampling.draw("doc_id", "plain") < "a6", "train").otherwise("val").alias("split"))


@register("p04_tier_sampler", "WITH c AS (SELECT source, count(*) AS f FROM documents GROUP BY source), t AS (SELECT doc_id, d.source, CASE WHEN f > 200 THEN 'head' WHEN f < 30 THEN 'tail' ELSE 'torso' END AS tier FROM documents d JOIN c ON c.source = d.source), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('tier:' || doc_id), doc_id) AS i FROM t) SELECT doc_id, source, tier FROM r WHERE i <= 20")
def p04(spark, folder):
    return sampling.tier_sample(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", "source", 200, 30, 20).select("doc_id", "source", "tier")


@register("p05_long_tail", "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) SELECT vec_id, label FROM r WHERE i <= greatest(5, floor(40 * pow(0.7::double, label)))")
def p05(spark, folder):
    return sampling.long_tail(table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id", "label", 40, 0.7, 5)


@register("p06_row_sample", "SELECT doc_id FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 100")
def p06(spark, folder):
    return sampling.sample(table(spark, folder, "documents").select("doc_id"), "doc_id", 100)


@register("t10_stratified_top", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('top:' || doc_id), doc_id) AS i FROM documents) SELECT doc_id, lang FROM r WHERE i <= 8")
def t10(spark, folder):
    i = F.row_number().over(Window.partitionBy("lang").orderBy(sampling.draw("doc_id", "top"), "doc_id"))
    return table(spark, folder, "documents").select("doc_id", "lang").withColumn("i", i).where("i <= 8").drop("i")


@register("p07_ward_clusters")
def p07(spark, folder):
    """Ward clusters of group centroids, cut where the silhouette is best."""
    groups = table(spark, folder, "embeddings").withColumn("g", F.concat_ws("-", "label", F.col("vec_id") % 7))
    return clustering.ward(vec.centroids(groups, "g"), "g", "centroid")


@register("x19_containment", """WITH l AS (SELECT DISTINCT p_partkey % 40 AS cluster, lower(p_name) AS label FROM part), w AS (SELECT DISTINCT cluster, label, unnest(string_split(label, ' ')) AS w FROM l),
z AS (SELECT cluster, label, count(*) AS size FROM w GROUP BY ALL), h AS (SELECT a.cluster, a.label, b.label AS other, count(*) AS common FROM w a JOIN w b ON a.cluster = b.cluster AND a.w = b.w AND a.label <> b.label GROUP BY ALL),
k AS (SELECT h.cluster, h.label, count(*) AS k FROM h JOIN z ON z.cluster = h.cluster AND z.label = h.label WHERE common = size GROUP BY ALL), n AS (SELECT cluster, count(*) AS n FROM l GROUP BY cluster)
SELECT l.cluster, l.label, round(CASE WHEN n > 1 THEN coalesce(k, 0) / (n - 1) ELSE 0 END, 6) AS share FROM l JOIN n ON n.cluster = l.cluster LEFT JOIN k ON k.cluster = l.cluster AND k.label = l.label""")
def containment(spark, folder):
    labels = table(spark, folder, "part").select((F.col("p_partkey") % 40).alias("cluster"), F.lower("p_name").alias("label")).distinct()
    return naming.containment(labels, "cluster", "label").withColumn("share", F.round("share", 6))


@register("a34_cluster_coherence", "WITH e AS (SELECT label, vec_id, embedding::double[] AS v FROM embeddings), x AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM x GROUP BY label) SELECT e.label, round(avg(list_cosine_similarity(v, c)), 5) AS coherence, count(*) AS n FROM e JOIN c ON e.label = c.label GROUP BY e.label")
def a34(spark, folder):
    rows = table(spark, folder, "embeddings")
    near = rows.join(vec.centroids(rows, "label"), "label").select("label", vec.cosine("embedding", "centroid").alias("sim"))
    return near.groupBy("label").agg(F.round(F.avg("sim"), 5).alias("coherence"), F.count("*").alias("n"))


@register("a41_labels_per_dataset", f"WITH {ITEMS} SELECT source, count(DISTINCT w) AS n_labels, count(*) AS n_items FROM t JOIN documents USING (doc_id) GROUP BY source")
def a41(spark, folder):
    items = table(spark, folder, "documents").select("source", F.explode(F.array_distinct(tokens("text"))).alias("w"))
    cells = items.groupBy("source", "w").agg(F.count("*").alias("n"))
    return cells.groupBy("source").agg(F.count("*").alias("n_labels"), F.sum("n").alias("n_items"))


@register("j09_title_join", "SELECT page_id, d.doc_id, d.lang FROM pages JOIN documents d ON d.doc_id = try_cast(regexp_extract(url, '://[^/]*/[a-z]*/([0-9]+)', 1) AS bigint)")
def j09(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/[a-z]*/([0-9]+)", 1).try_cast("bigint").alias("doc_id"))
    return pages.join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").select("page_id", "doc_id", "lang")


@register("z_window_counts", "SELECT date_trunc('day', ts)::timestamptz AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL".replace("::timestamptz", ""))
def z_windows(spark, folder):
    """Streaming counts; the watermark's delay is the span of the events, so no row is late."""
    events = table(spark, folder, "events").select("ts", "event_type", "value")
    found = jobs.window_counts(events)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("z_deduplicate", "SELECT DISTINCT user_id FROM events")
def z_dedupe(spark, folder):
    return jobs.deduplicate(table(spark, folder, "events").select("user_id"), ["user_id"])


@register("z2_reorder", "SELECT conv_id AS key, turn AS seq, turn AS position FROM conversations")
def z_reorder(spark, folder):
    return jobs.reorder(table(spark, folder, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@register("z3_id_generator", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1000000 + row_number() OVER (PARTITION BY event_type ORDER BY event_id) ELSE event_id END AS id FROM events")
def z_ids(spark, folder):
    """Custom ids stay; rows without one are numbered."""
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return table(spark, folder, "events").select("event_id", F.when(F.col("event_type") == "error", 1_000_000 + i).otherwise(F.col("event_id")).alias("id"))
