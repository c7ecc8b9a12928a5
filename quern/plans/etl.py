"""Queries on sources, sinks, predicates, lookups and set operations."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import tokens
from quern.operators import relational as rel
from quern.plans.registry import register
from quern.sources import files
from quern.sources.scratch import scratch
from quern.sources.tables import table

DOC_SCHEMA = "doc_id bigint, lang string, source string, n_chars bigint"


@register("s01_csv_skip_malformed", "SELECT doc_id, lang, source, n_chars FROM documents")
def s01(spark, folder):
    """A CSV with broken lines in it: the broken ones are dropped, the types are fixed."""
    path = scratch(spark)
    docs = table(spark, folder, "documents")
    good = docs.select(F.concat_ws(",", "doc_id", "lang", "source", "n_chars").alias("value"))
    bad = docs.select(F.concat_ws(",", F.lit("x"), "doc_id", "lang", F.lit("y"), F.lit("z")).alias("value"))
    good.unionByName(bad).write.text(path)
    return files.read_csv(spark, path, DOC_SCHEMA)


@register("s02_csv_projection", "SELECT source, n_chars FROM documents")
def s02(spark, folder):
    path = scratch(spark)
    table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").write.option("header", True).csv(path)
    return files.project(spark.read.schema(DOC_SCHEMA).option("header", True).csv(path), ["source", "n_chars", "not_there"])


@register("s03_jsonl_require_keys", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL")
def s03(spark, folder):
    """JSON lines, some malformed, some without a required key."""
    path = scratch(spark)
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    lines = docs.select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("value"))
    broken = docs.select(F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "lang"')).alias("value"))
    partial = docs.select(F.to_json(F.struct("doc_id", "n_chars")).alias("value"))
    lines.unionByName(broken).unionByName(partial).write.text(path)
    return files.read_jsonl(spark, path, "doc_id bigint, lang string, n_chars bigint", ["doc_id", "lang"])


@register("s04_keyed_upsert", """
WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS props FROM events)
SELECT user_id, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN props IS NOT NULL THEN 0 ELSE 1 END, event_id) AS n FROM r) WHERE n = 1""")
def s04(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("props"))
    return rel.upsert(rows, "user_id", "event_id", F.col("props").isNotNull())


@register("s05_parquet_schema_assert", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def s05(spark, folder):
    rows = files.require(table(spark, folder, "embeddings"), {"vec_id", "embedding", "label"})
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@register("s08_html_scan", """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
  len(regexp_extract_all(html, '<p>'))::bigint AS n_paragraphs, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::bigint AS n_links,
  coalesce(array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' '), '') AS links FROM pages""")
def s08(spark, folder):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"),
        F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("n_paragraphs"), F.size(links).cast("bigint").alias("n_links"), F.array_join(links, " ").alias("links"),
    )


@register("s09_script_value", r"""SELECT page_id, regexp_extract(html, '<script>var t="([^"]*)"', 1) AS value, try_cast(regexp_extract(html, 'track\(([0-9]+)\)', 1) AS bigint) AS track FROM pages""")
def s09(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("html", '<script>var t="([^"]*)"', 1).alias("value"), F.regexp_extract("html", r"track\(([0-9]+)\)", 1).try_cast("bigint").alias("track"))


@register("s10_glob_with_origin", "SELECT lang AS dataset, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY lang")
def s10(spark, folder):
    """One folder a dataset, read by a glob; the dataset is taken from the path."""
    path = scratch(spark)
    table(spark, folder, "documents").select("doc_id", "n_chars", F.col("lang").alias("name")).write.partitionBy("name").parquet(path)
    rows = spark.read.schema("doc_id bigint, n_chars bigint").parquet(f"{path}/name=*")
    return rows.groupBy(F.regexp_extract(F.col("_metadata.file_path"), "name=([^/]*)/", 1).alias("dataset")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register("s15_captions", "SELECT conv_id, turn, role, text FROM conversations")
def s15(spark, folder):
    """Nested JSON, one line a conversation, flattened to captions."""
    path = scratch(spark)
    nested = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("captions"))
    nested.write.json(path)
    read = spark.read.schema("conv_id bigint, captions array<struct<turn:bigint,role:string,text:string>>").json(path)
    return read.select("conv_id", F.explode("captions").alias("c")).select("conv_id", "c.*")


@register("s16_frame_stride", "SELECT event_id, user_id FROM events WHERE event_id >= 10 AND (event_id - 10) % 3 = 0")
def s16(spark, folder):
    """Stride sampling of a frame stream: first frame, step and, where there is one, last frame are the operator's parameters."""
    return files.stride(table(spark, folder, "events"), "event_id", first=10, step=3).select("event_id", "user_id")


@register("k02_chunk_files", "SELECT count(*) AS n_rows, max(doc_id) AS last FROM documents")
def k02(spark, folder):
    path = scratch(spark)
    files.write_chunks(table(spark, folder, "documents").select("doc_id", "lang"), path, 100)
    parts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("part")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    checked = parts.withColumn("n", F.when(F.col("n") <= 100, F.col("n")))
    return checked.agg(F.sum("n").alias("n_rows"), F.max("last").alias("last"))


@register("k03_append_missing", "SELECT doc_id, n_chars FROM documents")
def k03(spark, folder):
    """A second run over the same input appends only what a first, partial one lacks."""
    path = scratch(spark)
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    files.append_missing(docs.where("lang = 'en'"), path, "doc_id")
    files.append_missing(docs, path, "doc_id")
    return spark.read.parquet(path)


@register("k07_people_json", """SELECT conv_id, count(*) AS n_turns, sum(length(text))::bigint AS chars FROM conversations GROUP BY conv_id""")
def k07(spark, folder):
    path = scratch(spark)
    table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("people")).select(F.to_json(F.struct("conv_id", "people")).alias("value")).write.text(path)
    read = spark.read.text(path).select(F.from_json("value", "conv_id bigint, people array<struct<turn:bigint,text:string>>").alias("v"))
    return read.select("v.conv_id", F.size("v.people").cast("bigint").alias("n_turns"), F.aggregate("v.people", F.lit(0).cast("bigint"), lambda s, p: s + F.length(p["text"])).alias("chars"))


@register("k09_keyed_json", "SELECT lang AS strategy, count(*) AS n FROM documents GROUP BY lang")
def k09(spark, folder):
    """Keyed results, one partition a strategy; writing a strategy again replaces its partition alone."""
    path = scratch(spark)
    counts = table(spark, folder, "documents").groupBy(F.col("lang").alias("strategy")).agg(F.count("*").alias("n"))
    files.replace_keys(counts.withColumn("n", F.lit(0).cast("bigint")), path, "strategy")
    files.replace_keys(counts, path, "strategy")
    return spark.read.schema("n bigint, strategy string").json(path)


F1_SQL = """SELECT o_orderkey, raw FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
WHERE raw IS NULL OR try_cast(raw AS date) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"""


def _raw_dates(spark, folder):
    key = F.col("o_orderkey")
    raw = F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 5 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))


@register("f01_date_range", F1_SQL)
def f01(spark, folder):
    """A missing date passes, an unreadable one does not."""
    day = F.col("raw").try_cast("date")
    return _raw_dates(spark, folder).where(F.col("raw").isNull() | day.between("1996-01-01", "1998-12-31"))


F2_SQL = r"""WITH r AS (SELECT doc_id, text || ' ' || CASE WHEN doc_id % 3 = 0 THEN '1944-06-0' || (doc_id % 9 + 1) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' circa ' || (1900 + doc_id % 100) ELSE '' END AS t FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ''), nullif(regexp_extract(t, '\b[0-9]{4}\b'), '')) AS found FROM r"""


@register("f02_date_fallback", F2_SQL)
def f02(spark, folder):
    """The first full date, else the first year."""
    i = F.col("doc_id")
    tail = F.concat(F.lit(" "), F.when(i % 3 == 0, F.concat(F.lit("1944-06-0"), i % 9 + 1)).otherwise(""), F.when(i % 4 == 0, F.concat(F.lit(" circa "), 1900 + i % 100)).otherwise(""))
    found = lambda p: F.nullif(F.regexp_extract("t", p, 0), F.lit(""))
    return table(spark, folder, "documents").select("doc_id", F.concat("text", tail).alias("t")).select("doc_id", F.coalesce(found("[0-9]{4}-[0-9]{2}-[0-9]{2}"), found(r"\b[0-9]{4}\b")).alias("found"))


@register("f03_year_bounds", "SELECT o_orderkey, year(o_orderdate)::bigint AS y FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999")
def f03(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y")).where("y IS NULL OR y BETWEEN 1996 AND 1999")


@register("f04_blocklist", "SELECT p_partkey FROM parts_view WHERE NOT (contains(lower(p_name), 'red') OR p_brand IN ('Brand#11', 'Brand#23'))".replace("parts_view", "part"))
def f04(spark, folder):
    """Blocked title terms match as lower-cased substrings, blocked creators as members of a list."""
    titles, creators = ["red"], ["Brand#11", "Brand#23"]
    blocked = functools.reduce(lambda a, b: a | b, [F.lower("p_name").contains(t) for t in titles]) | F.col("p_brand").isin(creators)
    return table(spark, folder, "part").where(~blocked).select("p_partkey")


@register("f05_collection_blocklist", """SELECT doc_id FROM documents WHERE NOT (contains(text, 'disgusting') OR contains(text, 'stupid'))""")
def f05(spark, folder):
    words = F.array(F.lit("disgusting"), F.lit("stupid"))
    return table(spark, folder, "documents").where(~F.exists(words, lambda w: F.contains(F.col("text"), w))).select("doc_id")


@register("f06_url_extension", r"""SELECT page_id, nullif(regexp_extract(regexp_extract(url, '://[^/]*([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1), '') AS ext FROM pages""")
def f06(spark, folder):
    path = F.parse_url("url", F.lit("PATH"))
    return table(spark, folder, "pages").select("page_id", F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit("")).alias("ext"))


STOPS = {"en": ("the", "of", "and", "to", "that"), "fr": ("le", "la", "les", "et", "est"), "de": ("der", "die", "das", "und", "ist"), "es": ("el", "los", "del", "que", "las")}
_share = lambda lang: "list_sum(list_transform(t, lambda x: CASE WHEN x IN (" + ", ".join(f"'{w}'" for w in STOPS[lang]) + ") THEN 1 ELSE 0 END))"


@register("f07_language_gate", f"""SELECT doc_id, n_tokens, round(hits / n_tokens, 6) AS confidence FROM (
SELECT doc_id, len(t)::bigint AS n_tokens, coalesce({_share('en')}, 0)::double AS hits FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS t FROM documents))
WHERE n_tokens > 0 AND hits / n_tokens > 0.05""")
def f07(spark, folder):
    """Share of English function words above a threshold; a stand-in of its own for a language model's confidence."""
    hits = F.size(F.filter("t", lambda x: x.isin(*STOPS["en"])))
    docs = table(spark, folder, "documents").select("doc_id", tokens("text").alias("t"))
    counted = docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), hits.alias("hits"))
    share = F.col("hits") / F.col("n_tokens")
    return counted.where((F.col("n_tokens") > 0) & (share > 0.05)).select("doc_id", "n_tokens", F.round(share, 6).alias("confidence"))


@register("f08_period_normalised", r"""SELECT p_partkey, CASE WHEN length(trim(p_name)) >= 3 THEN regexp_replace(trim(p_name), '\.+$', '') || '.' END AS title FROM part""")
def f08(spark, folder):
    name = F.trim("p_name")
    return table(spark, folder, "part").select("p_partkey", F.when(F.length(name) >= 3, F.concat(F.regexp_replace(name, r"\.+$", ""), F.lit("."))).alias("title"))


@register("f09_drop_null_key", "SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE quality IS NOT NULL")
def f09(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").dropna(subset=["quality"]).select("doc_id", "quality")


@register("f10_parse_lists", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events WHERE event_type <> 'click' OR event_id % 2 = 0")
def f10(spark, folder):
    """Rows whose JSON can not be read go."""
    raw = F.when((F.col("event_type") != "click") | (F.col("event_id") % 2 == 0), F.col("props")).otherwise(F.lit("{broken"))
    read = table(spark, folder, "events").select("event_id", F.from_json(raw, T.StructType([T.StructField("k", T.LongType())])).alias("v"), raw.alias("raw"))
    return read.where(F.schema_of_json(F.lit('{"k": 1}')).isNotNull() & F.get_json_object("raw", "$.k").isNotNull()).select("event_id", "v.k")


@register("f11_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f11(spark, folder):
    building = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(building, "o_custkey", "left_anti").select("o_orderkey")


ERAS = (("early", 1995, 1996), ("middle", 1997, 1998), ("late", 1999, 2001))


@register("f12_era_rule", "SELECT o_orderkey, era FROM orders JOIN (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in ERAS) + ") e(era, a, b) ON year(o_orderdate) BETWEEN a AND b")
def f12(spark, folder):
    """A range join with a table of eras; each year meets its era by equality, so the join is a hash join."""
    eras = spark.createDataFrame(ERAS, "era string, a int, b int").select("era", F.explode(F.sequence("a", "b")).alias("y"))
    return table(spark, folder, "orders").withColumn("y", F.year("o_orderdate")).join(eras, "y").select("o_orderkey", "era")


@register("f13_vocabulary_gate", r"""
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-zà-öø-ÿ]+')) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT reason, count(*) AS n_tokens, sum(n)::bigint AS n_uses FROM (SELECT n, CASE WHEN n < 2 THEN 'rare' WHEN length(token) = 1 THEN 'short'
 WHEN length(regexp_replace(token, '[^0-9]', '', 'g')) > 0.3 * length(token) THEN 'digits' WHEN token IN ('the', 'of', 'and') THEN 'blacklist' ELSE 'keep' END AS reason FROM c) GROUP BY reason""")
def f13(spark, folder):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([0-9a-zà-öø-ÿ]+)"), 1)
    counts = table(spark, folder, "documents").select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    digits = F.length(F.regexp_replace("token", "[^0-9]", ""))
    reason = rel.gate((F.col("n") < 2, "rare"), (F.length("token") == 1, "short"), (digits > 0.3 * F.length("token"), "digits"), (F.col("token").isin("the", "of", "and"), "blacklist"))
    return counts.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n_uses"))


@register("f15_archive_of_path", "SELECT page_id, CASE WHEN contains(url, '.example.org') THEN 'org' WHEN contains(url, '.example.net') THEN 'net' ELSE string_split(string_split(url, '://')[2], '/')[1] END AS archive FROM pages")
def f15(spark, folder):
    host = F.element_at(F.split(F.element_at(F.split("url", "://"), 2), "/"), 1)
    return table(spark, folder, "pages").select("page_id", F.when(F.contains("url", F.lit(".example.org")), "org").when(F.contains("url", F.lit(".example.net")), "net").otherwise(host).alias("archive"))


@register("f16_resume_filter", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f16(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left_anti").select("doc_id")


@register("j01_left_stats", "SELECT s.source, n, q FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) s LEFT JOIN (SELECT source, round(avg(quality), 6) AS q FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source) p ON s.source = p.source")
def j01(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    stats = docs.groupBy("source").agg(F.count("*").alias("n"))
    good = docs.join(table(spark, folder, "labels").where("toxic = 1"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("q"))
    return stats.join(good, "source", "left")


MAP_SQL = "(VALUES ('en', 'english'), ('fr', 'french')) m(key, value)"


@register("j02_lookup_keep", f"SELECT doc_id, coalesce(value, lang) AS lang FROM documents LEFT JOIN {MAP_SQL} ON lang = key")
def j02(spark, folder):
    mapping = spark.createDataFrame([("en", "english"), ("fr", "french")], "key string, value string")
    return rel.lookup(table(spark, folder, "documents").select("doc_id", "lang"), "lang", mapping).select("doc_id", "lang")


@register("j03_lookup_drop", f"SELECT doc_id, value AS lang FROM documents JOIN {MAP_SQL} ON lang = key")
def j03(spark, folder):
    mapping = spark.createDataFrame([("en", "english"), ("fr", "french")], "key string, value string")
    return rel.lookup(table(spark, folder, "documents").select("doc_id", "lang"), "lang", mapping, keep_unmatched=False).select("doc_id", "lang")


@register("j04_lookup_default", "SELECT doc_id, coalesce(quality, -1)::bigint AS quality, coalesce(toxic, 0)::bigint AS toxic, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def j04(spark, folder):
    found = table(spark, folder, "labels").withColumn("missing", F.lit(False))
    return rel.lookup_default(table(spark, folder, "documents").select("doc_id"), "doc_id", found, {"quality": F.lit(-1), "toxic": F.lit(0), "missing": F.lit(True)}).select("doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"), "missing")


@register("j08_coverage", "SELECT count(*) FILTER (d.k IS NOT NULL AND l.k IS NOT NULL) AS n_both, count(*) FILTER (l.k IS NULL) AS n_left_only, count(*) FILTER (d.k IS NULL) AS n_right_only FROM (SELECT DISTINCT doc_id AS k FROM documents) d FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) l ON d.k = l.k")
def j08(spark, folder):
    return rel.coverage(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@register("j11_assemble_frames", "SELECT conv_id, count(*) AS n_turns, string_agg(role, ' ' ORDER BY turn) AS roles, max(turn) + 1 = count(*) AS complete FROM conversations GROUP BY conv_id")
def j11(spark, folder):
    """Sub-views of a frame gathered by id, in their order; complete if none is missing."""
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("v"), F.max("turn").alias("top"))
    return rows.select("conv_id", "n_turns", F.array_join("v.role", " ").alias("roles"), (F.col("top") + 1 == F.col("n_turns")).alias("complete"))


@register("a01_group_first_and_set", """SELECT o_custkey, (array_agg(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'))[1] AS first_priority, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS statuses FROM orders GROUP BY o_custkey""")
def a01(spark, folder):
    orders = table(spark, folder, "orders").withColumn("p", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    return orders.groupBy("o_custkey").agg(rel.first_not_null("p", "o_orderkey").alias("first_priority"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@register("u01_union_by_name", "SELECT doc_id AS id, lang, NULL::varchar AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def u01(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    return docs.unionByName(table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "role"), allowMissingColumns=True)


@register("u02_distinct_keep_first", "SELECT doc_id, text_hash FROM (SELECT doc_id, md5(text) AS text_hash, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def u02(spark, folder):
    return rel.keep_first(table(spark, folder, "documents").select("doc_id", F.md5("text").alias("text_hash")), ["text_hash"], ["doc_id"])


@register("u03_list_dedupe", """WITH x AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS t FROM documents)),
f AS (SELECT doc_id, w, min(i) AS i FROM x GROUP BY ALL) SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words, count(*) AS n FROM f GROUP BY doc_id""")
def u03(spark, folder):
    """Order-preserving removal of repeats within a list."""
    kept = table(spark, folder, "documents").select("doc_id", F.array_distinct(tokens("text")).alias("w")).where(F.size("w") > 0)
    return kept.select("doc_id", F.md5(F.array_join("w", " ")).alias("words"), F.size("w").cast("bigint").alias("n"))


PAIR_SQL = """pair AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(a.text), '[a-zà-öø-ÿ]+')) AS x, list_distinct(regexp_extract_all(lower(b.text), '[a-zà-öø-ÿ]+')) AS y
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _pairs(spark, folder):
    """Two label lists a sample: the words of a turn and of the next one."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.array_distinct(tokens("text")).alias("x"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return turns.join(following, ["conv_id", "turn"])


@register("u04_list_union", f"WITH {PAIR_SQL} SELECT conv_id, turn, len(list_distinct(list_concat(x, y)))::bigint AS n, md5(array_to_string(list_sort(list_distinct(list_concat(x, y))), ' ')) AS labels FROM pair")
def u04(spark, folder):
    both = F.sort_array(F.array_union(F.coalesce("x", F.array()), F.coalesce("y", F.array())))
    return _pairs(spark, folder).select("conv_id", "turn", F.size(both).cast("bigint").alias("n"), F.md5(F.array_join(both, " ")).alias("labels"))


VOCAB_SQL = "v AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS w FROM documents)"


@register("u05_vocabulary_sets", f"WITH {VOCAB_SQL}, e AS (SELECT w FROM v WHERE lang = 'en'), f AS (SELECT w FROM v WHERE lang = 'fr') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM e INTERSECT SELECT * FROM f) UNION ALL SELECT 'en_only', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT 'fr_only', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM e)")
def u05(spark, folder):
    words = table(spark, folder, "documents").where("lang IN ('en', 'fr')").select("lang", F.explode(tokens("text")).alias("w"))
    sides = words.groupBy("w").agg(F.bool_or(F.col("lang") == "en").alias("en"), F.bool_or(F.col("lang") == "fr").alias("fr"))
    part = F.when(F.col("en") & F.col("fr"), "both").when(F.col("en"), "en_only").otherwise("fr_only")
    return sides.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@register("u06_label_combinations", "SELECT combo, count(*) AS n FROM (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '+') AS combo FROM orders GROUP BY o_custkey) GROUP BY combo")
def u06(spark, folder):
    sets = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "+").alias("combo"))
    return sets.groupBy("combo").agg(F.count("*").alias("n"))


@register("u08_compute_once", "SELECT doc_id, length(text)::bigint AS chars, length(regexp_replace(text, '[^a-z]', '', 'g'))::bigint AS small FROM documents")
def u08(spark, folder):
    """An expensive function runs on distinct inputs, by content address, and is joined back."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("k"), "text")
    once = docs.groupBy("k").agg(F.first("text").alias("text")).select("k", F.length("text").cast("bigint").alias("chars"), F.length(F.regexp_replace("text", "[^a-z]", "")).cast("bigint").alias("small"))
    return docs.drop("text").join(once, "k").select("doc_id", "chars", "small")
