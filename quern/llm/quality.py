"""Quality rules as a bitmask ledger.

Each text is measured once; every rule leaves one bit (set: failed) and its measurements stay beside the mask.
Policies are versioned masks: applying one, or asking what another would have kept, is bit arithmetic over the
ledger and never touches a text again.

Null texts count as texts without words. Lines are parted by ``\\n``; a repeated line counts if it has a word.
Empty tables give empty ledgers, repeated rows a ledger row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, text_or_empty

#: Bits of the rules, in order.
FEW_WORDS, REPEATED_WORDS, SYMBOLS, REPEATED_LINES, WORD_LENGTH, SHOUTING = (1 << i for i in range(6))
RULE_NAMES = {FEW_WORDS: "few_words", REPEATED_WORDS: "repeated_words", SYMBOLS: "symbols", REPEATED_LINES: "repeated_lines", WORD_LENGTH: "word_length", SHOUTING: "shouting"}
BASE_MASK = FEW_WORDS | REPEATED_WORDS
SYMBOL_SET = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Policy:
    """A version of what is dropped: a text goes if it fails any rule of ``mask``."""

    version: str
    mask: int


POLICIES = {p.version: p for p in (Policy("base", BASE_MASK), Policy("v1", (1 << 6) - 1))}


def _repeated(windows: Column) -> Column:
    """The distinct windows that occur twice or more: in the sorted array they stand beside an equal one.

    The two shifted copies are compared element by element, without lookups by position.
    """
    ordered = F.sort_array(windows)
    same = F.zip_with(F.slice(ordered, 2, F.size(windows)), F.slice(ordered, 1, F.size(windows) - 1), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.array_compact(same))


def _positions(windows: Column, repeated: Column) -> Column:
    """Ascending positions of the windows that are ``repeated``."""
    few = F.array_compact(F.transform(windows, lambda w, i: F.when(F.array_contains(repeated, w), i)))
    # With many repeated windows a lookup each would be quadratic: sort (window, position) instead.
    runs = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    first, second = F.slice(runs, 1, F.size(windows) - 1), F.slice(runs, 2, F.size(windows))
    pairs = F.zip_with(first, second, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    many = F.array_sort(F.array_distinct(F.flatten(F.array_compact(pairs))))
    return F.when(F.size(repeated) == 0, F.array().cast("array<int>")).when(F.size(repeated) <= 64, few).otherwise(many)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One pass over the texts: keep..., n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters.

    Explodes of one-element arrays keep the optimizer from computing an array once per use. Three-word windows come
    out of one regular expression over the text with single spaces: a look ahead takes three words, the match one.
    """
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    step = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), text_or_empty(docs).alias("t"))
    step = step.select("doc", "t", once(F.btrim(F.regexp_replace("t", SPACE, " "), F.lit(" ")), "s"))
    windows = F.regexp_extract_all(F.col("s"), F.lit("(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), 1)
    step = step.select("doc", "t", F.length("s").alias("chars"), F.length(F.replace("s", F.lit(" "), F.lit(""))).alias("word_chars"), once(windows, "w"))
    step = step.select("doc", "t", "chars", "word_chars", "w", once(F.when(F.size(F.array_distinct("w")) < F.size("w"), _repeated(F.col("w"))).otherwise(F.array().cast("array<string>")), "again"))
    step = step.select("doc", "t", "chars", "word_chars", once(_positions(F.col("w"), F.col("again")), "at"))
    # Each window covers three words, fewer where the next one begins earlier.
    gaps = F.zip_with(F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    lines = F.filter(F.split(F.col("t"), "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    step = step.select("doc", "t", "chars", "word_chars", covered.alias("c"), once(lines, "l"))
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    return step.select(
        "doc.*",
        F.when(F.col("chars") > 0, F.col("chars") - F.col("word_chars") + 1).otherwise(0).cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.col("c").cast("bigint").alias("n_repeat_words"),
        without("[A-Z]+").cast("bigint").alias("n_upper"),
        without("[A-Za-z]+").cast("bigint").alias("n_letters"),
    )


#: What a ledger adds to the kept columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def failure_bits() -> Column:
    """The mask of failed rules from the measurements, every rule evaluated."""
    c = F.col
    failed = {
        FEW_WORDS: c("n_words") < 50,
        REPEATED_WORDS: 100 * c("n_repeat_words") > 50 * c("n_words"),
        SYMBOLS: 10 * c("n_symbols") > c("n_words"),
        REPEATED_LINES: 10 * c("n_dup_lines") > 4 * c("n_lines"),
        WORD_LENGTH: (c("word_chars") > 12 * c("n_words")) | (2 * c("word_chars") < 5 * c("n_words")),
        SHOUTING: 2 * c("n_upper") > c("n_letters"),
    }
    bits = F.lit(0)
    for bit, test in failed.items():
        bits = bits.bitwiseOR(F.when(test, F.lit(bit)).otherwise(F.lit(0)))
    return bits


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., the measurements and ``bits``. Kept columns of the same names give way to the measurements."""
    keep = tuple(k for k in keep if k not in (*MEASURES, "bits"))
    return measure(docs, keep).withColumn("bits", failure_bits())


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def ablation(marks: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it fails, rows only it fails, rows kept without it. One aggregation of bits.

    Masks are first counted, so what follows has at most 64 rows whatever the ledger holds.
    """
    counts = marks.groupBy(F.col("bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("rows"))
    rules = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("rule")) for b, n in RULE_NAMES.items() if b & policy.mask]))
    tried = counts.select("bits", "rows", rules.alias("r")).select("bits", "rows", "r.*")
    has = tried["bits"].bitwiseAND(tried["bit"]) != 0
    alone = tried["bits"] == tried["bit"]
    without = tried["bits"].bitwiseAND(F.bitwise_not(tried["bit"])) == 0
    total = lambda test, name: F.sum(F.when(test, F.col("rows")).otherwise(0)).alias(name)
    return tried.groupBy("rule").agg(total(has, "failed"), total(alone, "failed_alone"), total(without, "kept_without"))


def keep_good(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    return ledger(held, ("row",)).where(passes(F.col("bits"), policy)).select("row.*")
