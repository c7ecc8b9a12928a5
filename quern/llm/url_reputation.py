"""URL filtering by rules and an empirical-Bayes host reputation.

A host's share of bad pages is estimated from labelled outcomes with beta-binomial shrinkage: suffix towards the
corpus, registered domain towards its suffix, host towards its domain. How strongly each level shrinks is estimated
from the data by the moments of the beta-binomial. A page is blocked if the lower posterior bound of its host's
share of bad pages exceeds a threshold, by default the corpus's own share: the host is then worse than the corpus with
the certainty of the bound. Hosts without outcomes inherit their domain's, suffix's or the corpus's.

The levels are written as tables of a row a host, suffix or domain; of each only its prior weight, one number, reaches
the driver. The suffix is a host's last label and the registered domain its last two, unless the last two are listed
in ``long_suffixes``, a parameter: for real hosts, pass the public suffix list there.
Null urls and urls without ``://`` have an empty host and path and no rule; the empty host is a host like any other.
Very long urls are read whole, repeated rows are judged each, equal bounds get equal verdicts. An empty table of pages
gives an empty result, empty outcomes leave only the weak prior, by which nothing is blocked. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, shared_dir

#: Fixed values: (action, rule), longest match wins.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Default of a parameter: second-level suffixes that count as one suffix.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIOR_RATE, PRIOR_WEIGHT = 0.1, 2.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct (action, rule), or null. The rule list is a parameter, not data."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r)):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def domain_parts(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    is_long = two.isin(*long_suffixes)
    return F.when(is_long, two).otherwise(F.substring_index(host, ".", -1)), F.when(is_long, three).otherwise(two)


def _strength(units: DataFrame, parent_mean: str) -> float:
    """Prior weight kappa from the spread of bad shares over units (n, bad) around their parents' means.

    kappa = (1 - rho) / rho, where rho is the moment estimate of the intra-class correlation.
    """
    q = F.col(parent_mean) * (1 - F.col(parent_mean))
    sums = units.where((F.col("n") > 0) & (q > 0)).agg(
        F.coalesce(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(parent_mean), 2) / q), F.lit(0.0)).alias("s"),
        F.count("*").cast("double").alias("k"),
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("all"),
        F.coalesce(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("q"),
    ).first()
    room = sums["all"] - sums["q"]
    rho = (sums["s"] - sums["k"] + 1) / (room - sums["k"] + 1) if room > sums["k"] else 0.05
    rho = max(0.001, min(0.5, rho))
    return (1 - rho) / rho


def _shrink(units: DataFrame, parent_mean: str) -> DataFrame:
    """Adds alpha, beta of each unit's posterior and its mean, shrunk towards ``parent_mean``."""
    kappa = F.lit(_strength(units, parent_mean))
    alpha = F.col("bad") + kappa * F.col(parent_mean)
    beta = F.col("n") - F.col("bad") + kappa * (1 - F.col(parent_mean))
    return units.select(*units.columns, alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("mean"))


def corpus_share(units: DataFrame) -> float:
    """The share of bad outcomes among all, with the weak prior."""
    row = units.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    return (row["bad"] + PRIOR_RATE * PRIOR_WEIGHT) / (row["n"] + PRIOR_WEIGHT)


def reputations(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, lower, upper, corpus) for every host of ``hosts``; corpus is the corpus's share of bad outcomes.

    ``hosts`` has a column host, ``outcomes`` columns host and bad (0 or 1; nulls are ignored). Everything after the
    first aggregation has one row a host at most.
    """
    folder = shared_dir(hosts.sparkSession)
    seen = outcomes.where(outcomes["bad"].isNotNull()).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    suffix, domain = domain_parts(F.col("host"), long_suffixes)
    units = (
        hosts.select("host").distinct().join(seen, "host", "left")
        .select("host", suffix.alias("suffix"), domain.alias("domain"), F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("bad", F.lit(0.0)).alias("bad"))
    )
    units = materialize(units, f"{folder}/hosts")
    corpus = corpus_share(units)
    suffixes = units.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("corpus_mean", F.lit(corpus))
    suffixes = materialize(_shrink(suffixes, "corpus_mean").select("suffix", F.col("mean").alias("suffix_mean")), f"{folder}/suffixes")
    domains = materialize(units.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix"), f"{folder}/domains")
    domains = _shrink(domains, "suffix_mean").select("suffix", "domain", F.col("mean").alias("domain_mean"))
    rated = _shrink(materialize(units.join(domains, ["suffix", "domain"]), f"{folder}/rated"), "domain_mean")
    total_weight = F.col("alpha") + F.col("beta")
    spread = z * F.sqrt(F.col("alpha") * F.col("beta") / (total_weight * total_weight * (total_weight + 1)))
    return rated.select(
        "host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - spread).alias("lower"), F.least(F.lit(1.0), F.col("mean") + spread).alias("upper"), F.lit(corpus).alias("corpus"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most_bad: float | None = None, z: float = 1.645, long_suffixes: Sequence[str] = LONG_SUFFIXES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation, bound) for every page; other columns are ignored.

    ``most_bad`` is the threshold of the bound; None: the corpus's own share of bad outcomes.
    The join by host meets a table with one row a host, so a hot host is split by adaptive execution.
    """
    located = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    threshold = F.col("corpus") if most_bad is None else F.lit(most_bad)
    rated = reputations(located, outcomes, z, long_suffixes).select("host", F.col("mean").alias("reputation"), F.col("lower").alias("bound"), (F.col("lower") > threshold).alias("worse"))
    fits = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("worse"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        located.join(rated, "host", "left").withColumn("fit", fits)
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.action"), method).alias("verdict"), "reputation", "bound")
    )
