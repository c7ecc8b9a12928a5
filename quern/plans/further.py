"""Queries on paged and chunked sources, nested reports, geometry and indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import index
from quern.operators import vectors as vec
from quern.plans.registry import register
from quern.plans.similarity import E_SQL, embeddings, queries
from quern.sources.scratch import scratch
from quern.sources.tables import table


@register("s11_ordered_chunks", "SELECT doc_id, (doc_id // 100)::bigint AS chunk, row_number() OVER (ORDER BY doc_id) AS place FROM documents")
def s11(spark, folder):
    """Numbered chunk files read together; their order is that of the numbers in their names, not of the names."""
    path = scratch(spark)
    docs = table(spark, folder, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("n"))
    docs.write.partitionBy("n").parquet(path)
    rows = spark.read.schema("doc_id bigint").parquet(f"{path}/n=*").withColumn("chunk", F.regexp_extract(F.col("_metadata.file_path"), "n=([0-9]+)/", 1).cast("bigint"))
    sizes = rows.groupBy("chunk").agg(F.count("*").alias("k"))
    before = sizes.select("chunk", F.coalesce(F.sum("k").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("chunk").orderBy("doc_id"))
    return rows.withColumn("i", within).join(before, "chunk").select("doc_id", "chunk", (F.col("before") + F.col("i")).alias("place"))


@register("s13_tsv_rows", "SELECT conv_id, turn, role FROM conversations")
def s13(spark, folder):
    path = scratch(spark)
    table(spark, folder, "conversations").select("conv_id", "turn", "role").write.option("sep", "\t").option("header", True).csv(path)
    return spark.read.schema("conv_id bigint, turn bigint, role string").option("sep", "\t").option("header", True).csv(path)


@register("k05_nested_parquet", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def k05(spark, folder):
    """Lists of structs keep their types through Parquet."""
    path = scratch(spark)
    table(spark, folder, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "value")).alias("rows")).write.parquet(path)
    read = spark.read.schema("user_id bigint, rows array<struct<event_id:bigint,value:double>>").parquet(path)
    return read.select("user_id", F.size("rows").cast("bigint").alias("n"), F.round(F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["value"]), 4).alias("total"))


@register("j10_similarity_join", f"WITH {E_SQL} SELECT a.vec_id, min(b.vec_id) FILTER (a.v = b.v) AS class_id, (count(*) FILTER (round(list_inner_product(a.v, b.v) / (a.s * b.s), 6) >= 0.5 AND a.vec_id <> b.vec_id))::bigint AS n_links FROM e a, e b GROUP BY a.vec_id")
def j10(spark, folder):
    """Every row with its class of equal vectors and the number of rows at least 0.5 alike."""
    return vec.link_counts(table(spark, folder, "embeddings"), 0.5)


@register("a28_mean_and_std", "SELECT i::bigint AS i, round(avg(x), 6) AS mean, round(sqrt(avg(x * x) - avg(x) * avg(x)), 6) AS std FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM embeddings) GROUP BY i")
def a28(spark, folder):
    """Mean and deviation by position, from sums alone."""
    cells = embeddings(spark, folder).select(F.posexplode("embedding").alias("i", "x")).select((F.col("i") + 1).cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))
    sums = cells.groupBy("i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("i", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.col("q") / F.col("n") - mean * mean), 6).alias("std"))


@register("x09_query_split", r"SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(url, '[,;|\n/?&=.:]+'), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT regexp_matches(x, '[0-9]'))))::bigint AS n FROM pages")
def x09(spark, folder):
    """Distinct words between delimiters that a word list could hold."""
    parts = F.filter(F.transform(F.split("url", r"[,;|\n/?&=.:]+"), lambda x: F.lower(x)), lambda x: (F.length(x) > 2) & ~F.rlike(x, F.lit("[0-9]")))
    return table(spark, folder, "pages").select("page_id", F.size(F.array_distinct(parts)).cast("bigint").alias("n"))


@register("m18_nested_report", "SELECT source, lang, 'n' AS metric, count(*)::double AS value FROM documents GROUP BY source, lang UNION ALL SELECT source, lang, 'chars', sum(n_chars)::double FROM documents GROUP BY source, lang")
def m18(spark, folder):
    """A report nested by source, language and metric, flattened level by level."""
    cells = table(spark, folder, "documents").groupBy("source", "lang").agg(F.create_map(F.lit("n"), F.count("*").cast("double"), F.lit("chars"), F.sum("n_chars").cast("double")).alias("m"))
    nested = cells.groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "m")))).alias("report"))
    parsed = nested.select("source", F.from_json("report", "map<string,map<string,double>>").alias("r"))
    by_lang = parsed.select("source", F.explode("r").alias("lang", "m"))
    return by_lang.select("source", "lang", F.explode("m").alias("metric", "value"))


@register("m19_keypoint_geometry", "SELECT vec_id, round(sqrt(list_max([pow(embedding[1]::double - embedding[3]::double, 2) + pow(embedding[2]::double - embedding[4]::double, 2), pow(embedding[1]::double - embedding[5]::double, 2) + pow(embedding[2]::double - embedding[6]::double, 2), pow(embedding[3]::double - embedding[5]::double, 2) + pow(embedding[4]::double - embedding[6]::double, 2)])), 6) AS widest FROM embeddings")
def m19(spark, folder):
    """The largest distance between three points of a row."""
    at = lambda i: F.col("embedding")[i].cast("double")
    square = lambda a, b: F.pow(at(2 * a) - at(2 * b), F.lit(2)) + F.pow(at(2 * a + 1) - at(2 * b + 1), F.lit(2))
    return embeddings(spark, folder).select("vec_id", F.round(F.sqrt(F.greatest(square(0, 1), square(0, 2), square(1, 2))), 6).alias("widest"))


@register("p13_index_search")
def p13(spark, folder):
    """Approximate top 10 of the query set, every row indexed; ``recall`` is that against the exact search."""
    rows, asked = embeddings(spark, folder), queries(spark, folder)
    centre = index.fit(rows, 16)
    found = index.search(asked, rows, centre, 10, probes=11)
    exact = vec.top_k(asked, rows, 10).select("q_id", "vec_id", F.lit(True).alias("exact"))
    both = found.join(exact, ["q_id", "vec_id"], "full_outer")
    return both.groupBy("q_id").agg((F.count_if(F.col("exact") & F.col("sim").isNotNull()) / F.count_if("exact")).alias("recall"))


@register("r12_archive_shift", "WITH m AS (SELECT source, avg(quality) AS q, avg(toxic) AS t, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, n, round(q, 6) AS quality, round((q - (SELECT avg(quality) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))) / ((SELECT avg(quality) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) + 1e-8), 6) AS shift FROM m")
def r12(spark, folder):
    """A metric by archive and its relative shift from the whole."""
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    whole = rows.agg(F.avg("quality")).scalar()
    found = rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("q"))
    return found.select("source", "n", F.round("q", 6).alias("quality"), F.round((F.col("q") - whole) / (whole + F.lit(1e-8)), 6).alias("shift"))


@register("z1_latest_only", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i <= 5")
def z1(spark, folder):
    """A queue of five a key that drops its oldest entry when full: what is left in it at the end."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, folder, "events").select("user_id", "event_id", i.alias("i")).where("i <= 5").select("user_id", "event_id")


@register("s12_keep_loaded", "SELECT page_id FROM pages WHERE length(html) > 1000 AND contains(html, '</html>')")
def s12(spark, folder):
    """Rows whose content arrived whole."""
    return table(spark, folder, "pages").where((F.length("html") > 1000) & F.contains("html", F.lit("</html>"))).select("page_id")


@register("u09_benchmark_overlap", """WITH b AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS w FROM benchmark)),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS w FROM documents)) SELECT doc_id, item_id, count(*) AS n FROM d JOIN b ON d.g = b.g GROUP BY ALL""")
def u09(spark, folder):
    """Runs of eight words that documents share with benchmark items."""

    def runs(name, key):
        rows = table(spark, folder, name).select(key, tokens("text").alias("w")).where(F.size("w") >= 8)
        return rows.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice(F.col("w"), i, 8), " ")))).alias("g"))

    return runs("documents", "doc_id").join(runs("benchmark", "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


@register("j13_track_ids", "SELECT user_id, event_id, first_value(event_id) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS track FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events))")
def j13(spark, folder):
    """A row continues the track of the row before it if their values are near, else it starts one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    new = F.abs(F.col("value") - F.lag("value").over(order))
    marked = events.withColumn("gap", new).withColumn("k", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 5), 1).otherwise(0)).over(order))
    return marked.select("user_id", "event_id", F.first("event_id").over(Window.partitionBy("user_id", "k").orderBy("ts", "event_id")).alias("track"))
