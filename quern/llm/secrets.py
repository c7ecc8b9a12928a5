"""Secret scanning with an incremental blob ledger.

A blob is a text under its content address (sha256). The ledger is a table that holds which rule versions a blob has
been scanned with and what each of them found. A scan takes the distinct blobs of all document versions, runs on each
only the rule versions the ledger has not seen for it, appends their findings, and joins the findings of the current
rule versions back to every document with that content. A rule whose version moves on is scanned anew, and what its
old version found stays in the ledger without showing; a rule that is taken out and put back is not scanned again.

All of it is DataFrame expressions. Offsets are code points: a match's end is the running length of the gaps and
matches up to it, taken from two extractions over the same pattern ``gap, then match or end of text``; the running sum
is a window over the matches of a blob, so it is linear in them.
Null texts count as empty, empty texts have no findings, repeated rows share their blob's findings, very long texts
are scanned whole, an empty table has an empty result. Kept columns may have any names: they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import exists, materialize, shared_dir, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A detector. ``pattern`` has no capturing groups but, where ``value`` is set, one around the value that
    needs ``value`` characters; ``least`` is the least length of the whole match. Failing matches are dropped
    after the scan, so they still consume their text. ``hint`` must match wherever the pattern can."""

    name: str
    version: int
    pattern: str
    hint: str
    least: int = 0
    value: int = 0
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base kinds in their order, then the kinds this method adds.
RULES = (
    Rule("assign", 1, r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         r"[:=]", value=6, base=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", least=20, base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", least=24, base=True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN ", least=1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_", least=1),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-", least=1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.", least=1),
)

FINDING = "array<struct<rank:int,kind:string,start:bigint,end:bigint>>"
MATCH = "array<struct<rule:string,i:int,gap:int,hit:int,good:boolean>>"
LEDGER_SCHEMA = "blob string, scanned array<string>, findings array<struct<rule:string,start:bigint,end:bigint>>"


def _matches(rule: Rule, text: Column) -> Column:
    """The matches of one rule in their order, each with the length of the gap before it; the last is the end of the text."""
    scan = F.lit(rf"(?s)(.*?)({rule.pattern}|\z)")
    gaps, hits = F.regexp_extract_all(text, scan, F.lit(1)), F.regexp_extract_all(text, scan, F.lit(2))
    values = F.regexp_extract_all(text, scan, F.lit(3)) if rule.value else hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    good = lambda row: (F.length(row["hit"]) >= max(rule.least, 1)) & (F.length(row["value"]) >= max(rule.value, 1))
    return F.transform(rows, lambda row, i: F.struct(
        F.lit(rule.key).alias("rule"), i.alias("i"), F.length(row["gap"]).alias("gap"), F.length(row["hit"]).alias("hit"), good(row).alias("good")))


def matches(text: Column, rules: Sequence[Rule] = RULES, seen: Column | None = None) -> Column:
    """Matches of all ``rules`` in a text, but for rules whose key is in ``seen``.

    A rule's hint is tested first: most texts end there, without building any array.
    """
    none = F.array().cast(MATCH)
    parts = []
    for rule in rules:
        run = F.rlike(text, F.lit(rule.hint))
        if rule.value:
            run = run & F.rlike(text, F.lit(rule.pattern))
        if seen is not None:
            run = ~F.array_contains(seen, rule.key) & run
        parts.append(F.when(run, _matches(rule, text)).otherwise(none))
    return F.concat(*parts)


def rendered(findings: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(findings, lambda f: F.struct(f["start"], f["rank"], f["end"], f["kind"])))
    return F.array_join(F.transform(ordered, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def addressed(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc, blob, content): every document version with its content address; doc is a struct of the columns ``keep``."""
    text = text_or_empty(docs)
    return docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), F.sha2(text, 256).alias("blob"), text.alias("content"))


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows: blobs of ``versions`` with a rule version the ledger has not run on them.

    Which blobs those are is found without their texts; only texts of such blobs are then exchanged, once, by an
    aggregation with map-side combine, so a text that fills a third of the rows is sent once a task. The window and
    the last aggregation need no further exchange.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
        left = versions.select("blob").distinct().join(done, "blob", "left").select("blob", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        unseen = materialize(left.where(F.size("todo") > 0), f"{shared_dir(versions.sparkSession)}/unseen")
        blobs = versions.join(unseen.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("content").alias("content")).join(unseen, "blob")
        found = blobs.select("blob", F.col("todo").alias("scanned"), matches(F.col("content"), rules, F.array_except(keys, F.col("todo"))).alias("found"))
    else:
        blobs = versions.groupBy("blob").agg(F.first("content").alias("content"))
        found = blobs.select("blob", keys.alias("scanned"), matches(F.col("content"), rules).alias("found"))
    rows = found.select("blob", "scanned", F.explode_outer("found").alias("m"))
    stop = F.sum(F.col("m.gap") + F.col("m.hit")).over(Window.partitionBy("blob", "m.rule").orderBy("m.i"))
    spans = rows.select("blob", "scanned", "m", stop.alias("stop"))
    one = F.when(F.col("m.good"), F.struct(F.col("m.rule").alias("rule"), (F.col("stop") - F.col("m.hit")).alias("start"), F.col("stop").alias("end")))
    return spans.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.collect_list(one).alias("findings"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, if there is one."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if exists(spark, path) else None


def update_ledger(spark: SparkSession, docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it there, and return the whole ledger."""
    scan_blobs(addressed(docs), read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def join_back(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc, blob, findings): every document version with what the current versions of ``rules`` found in its blob.

    The blobs with findings are written out first, one row each, so the join meets them straight from an exchange and
    adaptive execution can split a blob that very many versions share.
    """
    keys, names = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.name) for r in rules])
    rank = F.array_position(keys, F.col("f.rule")).cast("int")
    one = F.struct((rank - 1).alias("rank"), F.element_at(names, rank).alias("kind"), F.col("f.start").alias("start"), F.col("f.end").alias("end"))
    found = ledger.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.array_contains(keys, F.col("f.rule"))).groupBy("blob").agg(F.collect_set(one).alias("findings"))
    found = materialize(found, f"{shared_dir(ledger.sparkSession)}/found")
    joined = versions.select("doc", "blob").join(found, "blob", "left")
    return joined.select("doc", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), path: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc, blob, findings) of every document, through the ledger at ``path`` (a new one, if none is named)."""
    spark = docs.sparkSession
    ledger = update_ledger(spark, docs, path or f"{shared_dir(spark)}/ledger", rules)
    return join_back(addressed(docs, keep), ledger, rules)


def digest(findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans."""
    base = [r.name for r in rules if r.base]
    only = F.filter("findings", lambda f: f["kind"].isin(*base))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    return findings.select("doc.doc_id", *counts, F.sha2(rendered(only), 256).alias("base_sha256"), rendered(F.col("findings")).alias("spans"))
