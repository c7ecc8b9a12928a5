"""Queries on text cleaning, parsing and label names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import matching, naming
from quern.plans.registry import register
from quern.sources.tables import table

W = "[a-zà-öø-ÿ]+"


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


@register("x01_basic_clean", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\x20\x09-\x0D]+', ' ', 'g'), '(?i)all rights reserved\.?', ' ', 'g'), '\([^()]*\)', ' ', 'g'), '["''|%$&*#]+', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS cleaned FROM documents""")
def x01(spark, folder):
    return docs(spark, folder).select("doc_id", F.md5(tx.clean("text")).alias("cleaned"))


@register("x02_query_clean", rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{W}'), lambda w: length(w) >= 2 AND w NOT IN ('photo', 'image', 'picture')) AS w FROM documents) SELECT doc_id, len(w)::bigint AS n, md5(array_to_string(w, ' ')) AS query FROM t""")
def x02(spark, folder):
    kept = F.filter(tx.tokens("text"), lambda w: (F.length(w) >= 2) & ~w.isin("photo", "image", "picture"))
    return docs(spark, folder).select("doc_id", F.size(kept).cast("bigint").alias("n"), F.md5(F.array_join(kept, " ")).alias("query"))


@register("x03_single_quotes", r"""SELECT p_partkey, regexp_replace(regexp_replace('''' || p_name || '''s', '^''|''$', '', 'g'), '''s', 's', 'g') AS name FROM part""")
def x03(spark, folder):
    quoted = F.concat(F.lit("'"), "p_name", F.lit("'s"))
    return table(spark, folder, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(quoted, "^'|'$", ""), "'s", "s").alias("name"))


@register("x04_enriched_description", "SELECT p_partkey, rtrim(concat_ws('. ', nullif(p_name, ''), nullif(p_brand, ''), CASE WHEN p_size > 25 THEN p_type END), '.') || '.' AS description FROM part")
def x04(spark, folder):
    parts = F.concat_ws(". ", F.nullif("p_name", F.lit("")), F.nullif("p_brand", F.lit("")), F.when(F.col("p_size") > 25, F.col("p_type")))
    return table(spark, folder, "part").select("p_partkey", F.concat(F.rtrim(parts, F.lit(".")), F.lit(".")).alias("description"))


@register("x05_label_post_process", rf"""WITH t AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ('the', 'and', 'for', 'that', 'with', 'red', 'blue', 'mrs'))) AS w FROM documents)
SELECT doc_id, len(w)::bigint AS n, CASE WHEN len(w) > 0 THEN md5(array_to_string(list_sort(w), ' ')) END AS labels FROM t""")
def x05(spark, folder):
    """Lower-cased labels of at least three letters without digits, stop, colour and title words; none: null."""
    stop = ("the", "and", "for", "that", "with", "red", "blue", "mrs")
    words = F.transform(F.regexp_extract_all("text", F.lit("([0-9A-Za-zÀ-ÖØ-öø-ÿ]+)"), 1), lambda w: F.lower(w))
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.rlike(w, F.lit("[0-9]")) & ~w.isin(*stop)))
    return docs(spark, folder).select("doc_id", kept.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n"), F.when(F.size("w") > 0, F.md5(F.array_join(F.array_sort("w"), " "))).alias("labels"))


@register("x06_collapse_repeats")
def x06(spark, folder):
    """Immediately repeated words become one (a back reference, which RE2 lacks)."""
    return docs(spark, folder).select("doc_id", F.md5(tx.collapse_repeats("text")).alias("collapsed"))


@register("x07_semantic_category", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_name), 'a') THEN 'a' ELSE 'none' END AS category FROM part")
def x07(spark, folder):
    anyof = lambda c, *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(c), w))
    return table(spark, folder, "part").select("p_partkey", F.when(anyof("p_type", "steel", "brass"), "metal").when(anyof("p_name", "a"), "a").otherwise("none").alias("category"))


@register("x08_phrase_split", r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,;\n]+'), lambda p: trim(p)), lambda p: p <> '') AS p FROM documents) SELECT doc_id, len(list_distinct(p))::bigint AS n, list_min(p) AS least FROM s")
def x08(spark, folder):
    phrases = F.array_distinct(F.filter(F.transform(F.split("text", r"[.,;\n]+"), lambda p: F.trim(p)), lambda p: p != ""))
    return docs(spark, folder).select("doc_id", F.size(phrases).cast("bigint").alias("n"), F.array_min(phrases).alias("least"))


@register("x10_caption_truncate", r"SELECT doc_id, md5(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[.!\"()*#:;~]', ' ', 'g'), '[\x20\x09-\x0D]{1,}', ' ', 'g')), ' '), lambda w: true)[1:50], ' ')) AS caption FROM documents")
def x10(spark, folder):
    """Lower-cased captions without marks, of at most fifty words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r'[.!"()*#:;~]', " "), r"[\x20\x09-\x0D]{1,}", " "))
    return docs(spark, folder).select("doc_id", F.md5(F.array_join(F.slice(F.split(plain, " "), 1, 50), " ")).alias("caption"))


@register("x11_token_vocabulary", f"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY w HAVING count(*) >= 20) SELECT w, row_number() OVER (ORDER BY n DESC, w) + 3 AS id FROM c UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<start>', 1), ('<end>', 2), ('<unk>', 3))")
def x11(spark, folder):
    counts = docs(spark, folder).select(F.explode(tx.tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 20")
    words = counts.select("w", (F.row_number().over(Window.orderBy(F.desc("n"), "w")) + 3).cast("bigint").alias("id"))
    special = spark.createDataFrame([("<pad>", 0), ("<start>", 1), ("<end>", 2), ("<unk>", 3)], "w string, id bigint")
    return special.unionByName(words)


@register("x13_text_stats", r"SELECT doc_id, length(text)::bigint AS chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint AS words, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text), 6) AS upper, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 6) AS digits FROM documents WHERE length(text) > 0")
def x13(spark, folder):
    share = lambda p: F.round(F.length(F.regexp_replace("text", p, "")) / F.length("text"), 6)
    return docs(spark, folder).where(F.length("text") > 0).select(
        "doc_id", F.length("text").cast("bigint").alias("chars"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"), share("[^A-Z]").alias("upper"), share("[^0-9]").alias("digits"))


@register("x14_iqr_outliers", "WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) SELECT doc_id, n_chars FROM documents, q WHERE n_chars < a - 3 * (b - a) OR n_chars > b + 3 * (b - a)")
def x14(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "n_chars")
    q = lambda p: rows.agg(F.percentile("n_chars", F.lit(p))).scalar()
    low, high = q(0.25), q(0.75)
    return rows.where((F.col("n_chars") < low - 3 * (high - low)) | (F.col("n_chars") > high + 3 * (high - low)))


#: Field names, and limits of length, special and upper-case shares of the text checks.
FIELDS = "category|subcategory|subjects|war theater|photo series|property number"
SHORT, SPECIAL, UPPER = 20, 0.15, 0.3


@register("x15_quality_flags", rf"""WITH d AS (SELECT lang, text, length(text) AS n FROM documents) SELECT lang, count(*) AS n_texts,
 count(*) FILTER (regexp_matches(text, '(?i)(^|[^a-z0-9_])({FIELDS}):')) AS metadata, count(*) FILTER (regexp_matches(text, '(^|[^0-9A-Za-z_])[0-9]{{6,}}([^0-9A-Za-z_]|$)')) AS long_numbers,
 count(*) FILTER (regexp_matches(text, '\[[^\]]{{3,}}\]')) AS brackets, count(*) FILTER (length(trim(text, E' \t\n\r')) < {SHORT}) AS short,
 count(*) FILTER (length(regexp_replace(text, '[\p{{L}}\p{{N}} \t\n\r]', '', 'g')) > {SPECIAL}::double * greatest(n, 1)) AS special,
 count(*) FILTER (n > {SHORT} AND length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) > {UPPER}::double * n) AS shouting FROM d GROUP BY lang""")
def x15(spark, folder):
    """How many texts of a language show each sign of poor cleaning."""
    size = F.length("text")
    count = lambda p: F.length(F.regexp_replace("text", p, ""))
    return docs(spark, folder).groupBy("lang").agg(
        F.count("*").alias("n_texts"), F.count_if(F.rlike("text", F.lit(rf"(?i)(^|[^a-z0-9_])({FIELDS}):"))).alias("metadata"),
        F.count_if(F.rlike("text", F.lit(r"(^|[^0-9A-Za-z_])[0-9]{6,}([^0-9A-Za-z_]|$)"))).alias("long_numbers"), F.count_if(F.rlike("text", F.lit(r"\[[^\]]{3,}\]"))).alias("brackets"),
        F.count_if(F.length(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) < SHORT).alias("short"), F.count_if(count(r"[\p{L}\p{N} \t\n\r]") > SPECIAL * F.greatest(size, F.lit(1))).alias("special"),
        F.count_if((size > SHORT) & (count(r"[^\p{Lu}]") > UPPER * size)).alias("shouting"))


@register("x16_url_parse", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS first, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), '') AS ref FROM pages")
def x16(spark, folder):
    part = lambda *p: F.try_parse_url("url", *[F.lit(x) for x in p])
    path = F.split(part("PATH"), "/")
    return table(spark, folder, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), F.coalesce(F.try_element_at(path, F.lit(2)), F.lit("")).alias("first"), F.coalesce(F.url_decode(part("QUERY", "ref")), F.lit("")).alias("ref"))


@register("x17_digit_dominance", "SELECT c_custkey, length(regexp_replace(c_name, '[^0-9]', '', 'g')) > 0.3::double * length(c_name) AS digits FROM customer")
def x17(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", (F.length(F.regexp_replace("c_name", "[^0-9]", "")) > 0.3 * F.length("c_name")).alias("digits"))


@register("x18_list_parser", """SELECT conv_id, len(l)::bigint AS n, array_to_string(l, '|') AS labels FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)""")
def x18(spark, folder):
    """Label lists as a model may write them (JSON, Python or plain), read back by the strategy that fits."""
    lists = table(spark, folder, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("l"))
    kind = F.col("conv_id") % 3
    quoted = lambda q: F.concat(F.lit("Labels: ["), F.array_join(F.transform("l", lambda x: F.concat(F.lit(q), x, F.lit(q))), ", "), F.lit("] done"))
    written = F.when(kind == 0, quoted('"')).when(kind == 1, quoted("'")).otherwise(F.array_join("l", "; "))
    parsed = tx.parse_list(written)
    return lists.select("conv_id", F.size(parsed).cast("bigint").alias("n"), F.array_join(parsed, "|").alias("labels"))



@register("x19_canonical_label", """WITH l AS (SELECT DISTINCT p_partkey % 40 AS cluster, lower(p_name) AS label, string_split(lower(p_name), ' ') AS t FROM part),
w AS (SELECT cluster, w, count(*) AS k FROM (SELECT cluster, unnest(list_distinct(t)) AS w FROM l) GROUP BY ALL), s AS (SELECT cluster, count(*) AS n FROM l GROUP BY cluster),
h AS (SELECT cluster, list(w) AS shared FROM w JOIN s USING (cluster) WHERE k >= greatest(2, ceil(n / 2)) GROUP BY cluster),
a AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY len(t) DESC, label) AS i, row_number() OVER (PARTITION BY cluster ORDER BY length(label) DESC, label) AS j FROM l),
e AS (SELECT cluster, t[-1] AS head, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, t[-1]) AS i FROM l GROUP BY cluster, t[-1]),
c AS (SELECT s.cluster, n, nullif(array_to_string(list_filter(a.t, lambda x: list_contains(shared, x)), ' '), '') AS core FROM s JOIN a ON a.cluster = s.cluster AND a.i = 1 LEFT JOIN h ON h.cluster = s.cluster)
SELECT c.cluster, n, core, CASE WHEN core <> b.label THEN core END AS hypernym, head FROM c JOIN a b ON b.cluster = c.cluster AND b.j = 1 JOIN e ON e.cluster = c.cluster AND e.i = 1""")
def x19(spark, folder):
    """The words that at least half of a cluster's labels share."""
    labels = table(spark, folder, "part").select((F.col("p_partkey") % 40).alias("cluster"), F.lower("p_name").alias("label")).distinct()
    return naming.shared_core(labels, "cluster", "label")


@register("x20_bleu", f"""WITH p AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '{W}') AS c, regexp_extract_all(lower(b.text), '{W}') AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
k AS (SELECT unnest([1, 2, 3, 4]) AS g), cg AS (SELECT conv_id, turn, g, unnest(list_transform(range(1, len(c) - g + 2), lambda i: array_to_string(c[i:i + g - 1], ' '))) AS x FROM p, k), rg AS (SELECT conv_id, turn, g, unnest(list_transform(range(1, len(r) - g + 2), lambda i: array_to_string(r[i:i + g - 1], ' '))) AS x FROM p, k),
cc AS (SELECT conv_id, turn, g, x, count(*) AS n FROM cg GROUP BY ALL), rc AS (SELECT conv_id, turn, g, x, count(*) AS n FROM rg GROUP BY ALL),
m AS (SELECT g, sum(least(cc.n, coalesce(rc.n, 0))) AS hit, sum(cc.n) AS total FROM cc LEFT JOIN rc USING (conv_id, turn, g, x) GROUP BY g), l AS (SELECT sum(len(c)) AS c, sum(len(r)) AS r FROM p)
SELECT CASE WHEN min(hit) = 0 THEN 0 ELSE round(exp(avg(ln(nullif(hit, 0) / total))) * max(CASE WHEN l.c > l.r THEN 1 ELSE exp(1 - l.r / l.c) END), 6) END::double AS bleu FROM m, l""")
def x20(spark, folder):
    """Corpus BLEU of runs of one to four words, each turn against the next."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", tx.tokens("text").alias("c"))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("c").alias("r")), ["conv_id", "turn"])
    return naming.bleu(pairs, ["conv_id", "turn"], "c", "r", 4)


@register("x21_keyword_clean", "SELECT conv_id, array_to_string(list_filter(list_transform(string_split(k, ';'), lambda x: trim(x)), lambda x: length(x) > 2), ', ') AS keywords FROM (SELECT conv_id, string_agg(role, ' ; ' ORDER BY turn) || '; x' AS k FROM conversations GROUP BY conv_id)")
def x21(spark, folder):
    raw = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("v")).select("conv_id", F.concat(F.array_join("v.role", " ; "), F.lit("; x")).alias("k"))
    return raw.select("conv_id", F.array_join(F.filter(F.transform(F.split("k", ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 2), ", ").alias("keywords"))


@register("x22_md5_key", "SELECT page_id, md5(url || '|' || page_id) AS key FROM pages")
def x22(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(F.concat_ws("|", "url", "page_id")).alias("key"))


@register("u07_fuzzy_dedupe")
def u07(spark, folder):
    labels = table(spark, folder, "part").select((F.col("p_partkey") % 100).alias("sample"), F.lower("p_name").alias("label"))
    return matching.fuzzy_dedupe(labels, "sample", "label")


@register("t08_box_suppression")
def t08(spark, folder):
    e = F.col("embedding")
    box = table(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("sample"), F.col("vec_id").alias("box"), e[0].cast("double").alias("x0"), e[1].cast("double").alias("y0"),
        (e[0] + 0.1 + F.abs(e[2])).cast("double").alias("x1"), (e[1] + 0.1 + F.abs(e[3])).cast("double").alias("y1"), e[4].cast("double").alias("score"))
    return matching.suppress(box, "sample", 0.5)
