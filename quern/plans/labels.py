"""Queries on token and label distributions."""

from quern.functions.text import tokens
from quern.operators.distribution import vocabulary_profile
from quern.plans.registry import register
from quern.sources.tables import table
from pyspark.sql import functions as F

TOKENS_SQL = """
tok AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS token FROM documents)
"""


@register(
    "source_vocabulary",
    f"""
WITH {TOKENS_SQL}, c AS (SELECT source, token, count(*) AS n FROM tok GROUP BY ALL),
t AS (SELECT source, sum(n)::double AS total, count(*) AS uniq FROM c GROUP BY source),
r AS (SELECT c.source, n, total, uniq, row_number() OVER (PARTITION BY c.source ORDER BY n, token) AS i FROM c JOIN t USING (source)),
e AS (SELECT source, max(total)::bigint AS n_tokens, max(uniq) AS n_labels, -sum(n / total * log2(n / total)) AS h,
  sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::bigint AS n_singletons,
  2 * sum(i * n) / (max(uniq) * max(total)) - (max(uniq) + 1.0) / max(uniq) AS g FROM r GROUP BY source)
SELECT source, n_tokens, n_labels, n_singletons, round(h, 6) AS entropy,
  round(CASE WHEN n_labels > 1 THEN h / log2(n_labels) ELSE 0 END, 6) AS entropy_norm,
  round(pow(2, h), 4) AS perplexity, round(g, 6) AS gini FROM e
""",
)
def source_vocabulary(spark, folder):
    docs = table(spark, folder, "documents").select("source", F.explode(tokens("text")).alias("token"))
    return vocabulary_profile(docs, ["source"], "token").withColumnRenamed("n_rows", "n_tokens")
