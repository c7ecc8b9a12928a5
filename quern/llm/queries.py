"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import imatch, langid, mixing, packing, pii, quality, secrets, simhash, token_store, url_reputation
from quern.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, len({WORDS_SQL})::bigint AS size,
    md5('mix:' || coalesce(doc_id::varchar, 'null')) AS spread, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT src, no_src, sum(size)::bigint AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3.0::double, 1.0, 2.0][((row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1)::int] AS weight FROM s),
r AS (SELECT *, 2 * source_size / weight AS dry FROM w),
p AS (SELECT *, 1.5::double * sum(source_size) OVER () AS budget,
    coalesce(sum(2.0 * source_size) OVER (ORDER BY dry, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS spent,
    sum(weight) OVER (ORDER BY dry, no_src, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sending FROM r),
l AS (SELECT (budget - spent) / sending AS level FROM p WHERE spent + dry * sending >= budget ORDER BY dry, no_src, src LIMIT 1),
t AS (SELECT src, no_src, source_size, weight, least(weight * level, 2.0::double * source_size) AS target FROM p, l),
q AS (SELECT d.*, row_number() OVER () AS id, source_size, target, weight, greatest(1, source_size // 4096)::bigint AS piece,
    sum(size) OVER (PARTITION BY src, no_src ORDER BY spread, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead
    FROM d JOIN t USING (src, no_src)),
e AS (SELECT *, unnest(range(1, ((size + piece - 1) // piece + 1)::bigint)) AS k FROM (SELECT *, unnest([0, 1]) AS epoch FROM q)),
f AS (SELECT id, no_src, src, (epoch * source_size + ahead + least(k * piece, size)) / weight AS finish, least(k * piece, size) - (k - 1) * piece AS words FROM e),
g AS (SELECT *, sum(words) OVER (ORDER BY finish, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through, floor(0.75::double * sum(words) OVER ()) AS budget FROM f),
h AS (SELECT id, sum(greatest(0, least(words, budget - through + words))) AS taken FROM g GROUP BY id)
SELECT doc_id, size, source_size::bigint AS source_size, target::double AS target, coalesce(taken, 0)::bigint AS taken FROM q LEFT JOIN h USING (id)
"""


@_query("op1_mix_sources", OP1_SQL)
def op1_mix_sources(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    planned = mixing.schedule(docs, ["doc_id"])
    taken = F.aggregate("packets", F.lit(0).cast("bigint"), lambda sum_, p: sum_ + p["take"])
    return planned.select("doc.doc_id", "size", "source_size", "target", taken.alias("taken"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op2_pack_sequences")
def op2_pack_sequences(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path()).drop("loss_tokens")


def _spans_sql(rank: int, rule: secrets.Rule) -> str:
    pattern = rf"(?s)(.*?)({rule.pattern}|\z)".replace("'", "''")
    value = 3 if rule.value else 2
    return f"""
SELECT id, {rank} AS rank, '{rule.name}' AS kind, stop - len(hit) AS start, stop AS "end" FROM (
  SELECT id, hit, val, sum(len(gap) + len(hit)) OVER (PARTITION BY id ORDER BY i) AS stop FROM (
    SELECT id, unnest(regexp_extract_all(t, '{pattern}', 1)) AS gap, unnest(regexp_extract_all(t, '{pattern}', 2)) AS hit,
      unnest(regexp_extract_all(t, '{pattern}', {value})) AS val, generate_subscripts(regexp_extract_all(t, '{pattern}', 1), 1) AS i FROM d))
WHERE len(hit) >= {max(1, rule.least)} AND len(val) >= {max(1, rule.value)}"""


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES))}),
g AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM f GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)
"""


@_query("op3_scan_secrets", OP3_SQL)
def op3_scan_secrets(spark, folder):
    return secrets.digest(secrets.scan(table(spark, folder, "documents").select("doc_id", "text")))


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
x AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY id ORDER BY i)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
v AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY id),
l AS (SELECT id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.id, doc_id, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint AS n_symbols, len(l)::bigint AS n_lines,
  (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(v.n, 0)::bigint AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]+', '', 'g')) AS n_letters
  FROM d JOIN l ON l.id = d.id LEFT JOIN v ON v.id = d.id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words OR 2 * n_upper > n_letters) AS kept
FROM b
"""


@_query("op4_quality_rules", OP4_SQL)
def op4_quality_rules(spark, folder):
    marks = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    base = ~quality.passes(F.col("bits"), quality.POLICIES["base"])
    return marks.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), quality.passes(F.col("bits"), quality.POLICIES["v1"]).alias("kept"),
    )


@_query("op5_personal_data")
def op5_personal_data(spark, folder):
    return pii.digest(pii.detect(table(spark, folder, "documents").select("doc_id", "text")))


@_query("op6_token_store")
def op6_token_store(spark, folder):
    path = shared_dir(spark)
    token_store.write_store(table(spark, folder, "documents").select("doc_id", "text"), path, tokenizer_path())
    return token_store.read_digests(spark, path)


@_query("op7_imatch")
def op7_imatch(spark, folder):
    return imatch.compare(table(spark, folder, "documents").select("doc_id", "text"))


@_query("op8_simhash_golay")
def op8_simhash_golay(spark, folder):
    found = simhash.link_64(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op9_language_spans")
def op9_language_spans(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 4 == 2, F.lit(False))
    labelled = docs.where(~held_out & docs["lang"].isNotNull() & docs["text"].isNotNull()).select("doc_id", "text", "lang")
    found = langid.label(docs.select("doc_id", "text"), langid.fit(labelled), with_spans=False)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def _shrink_sql(name: str, units: str, parent: str) -> str:
    return f"""
{name}_k AS (SELECT (1 - rho) / rho AS kappa FROM (SELECT greatest(0.001, least(0.5, coalesce(CASE WHEN room > k THEN (s - k + 1) / (room - k + 1) END, 0.05)))::double AS rho FROM (
  SELECT coalesce(sum(n * pow(bad / n - {parent}, 2) / ({parent} * (1 - {parent}))), 0) AS s, count(*)::double AS k,
    coalesce(sum(n), 0) - coalesce(sum(n * n) / sum(n), 0) AS room FROM {units} WHERE n > 0 AND {parent} * (1 - {parent}) > 0))),
{name} AS (SELECT u.*, bad + kappa * {parent} AS alpha, n - bad + kappa * (1 - {parent}) AS beta, (bad + kappa * {parent}) / (n + kappa) AS mean FROM {units} u, {name}_k)"""


_RULE_CASES = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{a} {r}'"
    for a, r in sorted(url_reputation.RULES, key=lambda x: -len(x[1]))
)
_LONG = ", ".join(f"'{s}'" for s in url_reputation.LONG_SUFFIXES)
OP10_SQL = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL AND quality IS NULL THEN NULL ELSE 0 END AS bad FROM p JOIN labels l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS bigint)),
seen AS (SELECT host, count(*)::double AS n, sum(bad)::double AS bad FROM o WHERE bad IS NOT NULL GROUP BY host),
cut AS (SELECT *, string_split(host, '.') AS part FROM (SELECT DISTINCT host FROM p)),
units AS (SELECT host, CASE WHEN array_to_string(part[-2:], '.') IN ({_LONG}) THEN array_to_string(part[-2:], '.') ELSE part[-1] END AS suffix,
  CASE WHEN array_to_string(part[-2:], '.') IN ({_LONG}) THEN array_to_string(part[-3:], '.') ELSE array_to_string(part[-2:], '.') END AS domain,
  coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM cut LEFT JOIN seen USING (host)),
total AS (SELECT (sum(bad) + 0.1 * 2) / (sum(n) + 2) AS corpus_mean FROM units),
su AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, max(corpus_mean) AS corpus_mean FROM units, total GROUP BY suffix),
{_shrink_sql("s", "su", "corpus_mean")},
du AS (SELECT u.suffix, domain, sum(u.n) AS n, sum(u.bad) AS bad, max(s.mean) AS suffix_mean FROM units u JOIN s USING (suffix) GROUP BY ALL),
{_shrink_sql("dm", "du", "suffix_mean")},
hu AS (SELECT u.*, dm.mean AS domain_mean FROM units u JOIN dm USING (suffix, domain)),
{_shrink_sql("h", "hu", "domain_mean")},
v AS (SELECT host, greatest(0, mean - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))) AS bound FROM h),
j AS (SELECT p.*, bound, CASE {_RULE_CASES} END AS fit FROM p LEFT JOIN v USING (host))
SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN string_split(fit, ' ')[2] END AS rule,
  CASE WHEN fit IS NOT NULL THEN string_split(fit, ' ')[1] WHEN bound > corpus_mean THEN 'block' ELSE 'allow' END AS verdict FROM j, total
"""


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page's path names the document it shows, whose label tells its outcome; bad if toxic or of low quality."""
    number = F.regexp_extract(url_reputation.path_of(pages["url"]), "/([0-9]+)", 1).try_cast("bigint")
    shown = pages.select(url_reputation.host_of(pages["url"]).alias("host"), number.alias("doc_id"))
    worse = (F.col("toxic") == 1) | (F.col("quality") == 0)
    bad = F.when(worse, 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return shown.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("host", "bad")


@_query("op10_url_reputation", OP10_SQL)
def op10_url_reputation(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, table(spark, folder, "labels"))
    return url_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")
