"""Personal data by patterns and by bootstrapped context.

The base detectors are fixed patterns with checks. Their hits are seeds: the words around them are lexical patterns,
and patterns and instances form a graph. A pattern's score is the share of its instances that are known, smoothed;
an unknown identifier-like token (or spaced number, or address with a written "(at)") scores as its best pattern does,
and counts as known in the next round, for all patterns around it. Rounds go on until no score changes. Patterns with
enough known instances and a high score then mark the unknown ones in their context.

All counts are aggregations over the whole corpus; a common pattern is pre-aggregated before it is shuffled, and the
iterations are checkpointed. Texts are read once and not shuffled for detection.
Null texts count as empty, very long ones are read whole, repeated rows get the same spans, an empty table gives an
empty result. Spans that start together stand in the order of their kinds. Other columns of the input are ignored by
``detect`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, fresh, materialize, shared_dir, text_or_empty

#: The base kinds in their order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its first digit alone; starting within it gives the same result.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
#: One part of a number written in groups; a written at and the domain after it.
_GROUP = re.compile(r"[+(]?[0-9][0-9()./-]*")
_AT = re.compile(r" ?[(\[] ?at ?[)\]] ?[a-z0-9-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[a-z0-9-]+)*", re.I)
_TRIM = ".,;:!?()[]{}<>\"'|"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
SPAN = "struct<rank:int,kind:string,start:bigint,end:bigint>"
MENTION = "struct<kind:string,instance:string,start:bigint,end:bigint,patterns:array<string>>"
MARKED = f"same string, doc_id bigint, spans array<{SPAN}>, mentions array<{MENTION}>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the characters before it, back to the last match, and the domain after it."""
    at, least = text.find("@"), 0
    while at >= 0:
        start, end = at, at + 1
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, end) if start < at else None
        if domain:
            end = least = domain.end()
            yield start, end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) of the base detectors, by start, then rank."""
    found = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda f: (f[1], f[0]))


def _shape(token: str) -> str | None:
    """What an unknown token may be: with an @ an e-mail, with seven digits or more a number."""
    if "@" in token[1:-1]:
        return "email"
    return "number" if len(_NOT_DIGIT.sub("", token)) >= 7 else None


#: A longer word stands in patterns by its hash.
LONG_WORD = 40


def _clean(word: str) -> str:
    word = _DIGIT.sub("0", word.lower())
    return word if len(word) <= LONG_WORD else "\x20" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def _context(words: list[str], i: int, j: int) -> list[str]:
    """Lexical patterns around words i to j: one and two words to the left, one on each side."""
    left, before, right = (_clean(words[k]) if 0 <= k < len(words) else "" for k in (i - 1, i - 2, j + 1))
    return [f"{left}\x20_", f"{before}\x20{left}\x20_", f"{left}\x20_\x20{right}"]


def _grouped(text: str, tokens: list) -> Iterator[tuple[int, int]]:
    """Numbers of seven digits or more in groups of less, one space apart."""
    start = end = digits = groups = 0
    for i, t in enumerate([*tokens, None]):
        last = t and t[0].rstrip(_TRIM)
        part = t and _GROUP.fullmatch(last) and len(_NOT_DIGIT.sub("", last)) < 7
        if groups and not (part and t.start() == tokens[i - 1].end() + 1 and text[end : tokens[i - 1].end()] in ("", ")")):
            if groups > 1 and digits >= 7:
                yield start, end
            groups = 0
        if part:
            if not groups:
                start, digits = t.start(), 0
            groups, digits, end = groups + 1, digits + len(_NOT_DIGIT.sub("", last)), t.start() + len(last)


def _written(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a written at, such as name (at) host."""
    for m in _AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()


def mentions(text: str, spans: Sequence[tuple[int, int, int]]) -> list[tuple]:
    """Seeds (with kind) and unknown identifier-like tokens and runs of tokens (without) with their contexts."""
    written = list(_written(text))
    if not written and not _DIGIT.search(text) and "@" not in text:
        return []
    tokens = list(_TOKEN.finditer(text))
    words, ends = [t[0] for t in tokens], [t.end() for t in tokens]

    def context(a: int, b: int) -> list[str]:
        return _context(words, bisect_right(ends, a), bisect_left(ends, b))

    out = [(KINDS[rank], text[a:b], a, b, context(a, b)) for rank, a, b in sorted(spans, key=lambda s: s[1])]
    single = []
    for t in tokens:
        if "@" in t[0] or _DIGIT.search(t[0]):
            token = t[0].strip(_TRIM)
            if _shape(token):
                a = t.start() + t[0].index(token)
                single.append((a, a + len(token)))
    taken = [(a, b) for _, a, b in spans]
    # Grouped numbers and single tokens never overlap.
    for several in (written, [*single, *_grouped(text, tokens)]):
        free = [(a, b) for a, b in several if not any(x < b and a < y for x, y in taken)]
        out += [(None, text[a:b], a, b, context(a, b)) for a, b in free]
        taken += free
    return out


def mark(docs: DataFrame) -> DataFrame:
    """Base spans and mentions of every text, see MARKED; ``same`` names a (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rank", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        mention = pa.list_(pa.struct([("kind", pa.string()), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            spans, named = [], []
            for t in batch.column(2):
                text = t.as_py()
                found = base_spans(text)
                spans.append([{"rank": r, "kind": KINDS[r], "start": a, "end": b} for r, a, b in found])
                named.append([dict(zip(("kind", "instance", "start", "end", "patterns"), m)) for m in mentions(text, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(named, mention)], names=["same", "doc_id", "spans", "mentions"])

    wanted = docs.select(same_key(docs).alias("same"), docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    return wanted.mapInArrow(run, MARKED)


def same_key(docs: DataFrame):
    return F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.md5(text_or_empty(docs))))


def _fits():
    """Whether the instance may be of the kind."""
    mail = F.col("instance").contains("@") | F.col("instance").rlike(r"(?i)[(\[] ?at ?[)\]]")
    return F.when(F.col("kind") == "email", mail).otherwise(~mail)


def learn(marked: DataFrame, least_seeds: int = 5, confident: float = 0.8) -> DataFrame:
    """(pattern, kind, score): patterns whose instances are mostly known, from at least ``least_seeds`` known ones.

    An unknown instance may take a kind its shape allows. Scores are smoothed as if each pattern had one more
    instance, an unknown one. They only grow from round to round, as what is known does, and settle.
    """
    edges = marked.select(F.explode("mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.instance", F.col("m.kind").alias("seed")).distinct()
    edges = checkpointed(edges)
    seeds = checkpointed(edges.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct())
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    links = checkpointed(edges.groupBy("pattern", "instance").agg(F.max(F.col("seed").isNull()).alias("unknown")).join(sizes, "pattern"))
    known, before = seeds, None
    while True:
        scored = links.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"), (F.sum("score") / (F.max("size") + 1)).alias("score"))
        patterns = checkpointed(scored.where((F.col("n") >= least_seeds) & (F.col("score") >= confident)).select("pattern", "kind", "score"))
        now = patterns.agg(F.count("*"), F.round(F.sum("score"), 6)).first()
        if now == before:
            return patterns
        before = now
        guessed = links.where("unknown").select("pattern", "instance").join(patterns, "pattern").where(_fits()).select("instance", "kind", "score")
        known = checkpointed(seeds.unionByName(guessed).groupBy("instance", "kind").agg(F.max("score").alias("score")))


def discover(marked: DataFrame, patterns: DataFrame) -> DataFrame:
    """(same, more): spans of unknown tokens within a confident pattern; of several kinds the best scored."""
    unknown = marked.select("same", F.explode("mentions").alias("m")).where("m.kind IS NULL")
    at = unknown.select("same", "m.instance", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    best = at.join(patterns, "pattern").where(_fits()).groupBy("same", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    span = F.struct(F.lit(len(KINDS)).alias("rank"), F.concat(F.lit("context_"), F.col("best.kind")).alias("kind"), "start", "end")
    return best.groupBy("same").agg(F.collect_set(span).alias("more"))


def recovered(docs: DataFrame, one_in: int = 5, least_seeds: int = 5, confident: float = 0.8) -> DataFrame:
    """(kind, hidden, found): a measure of the method. One base instance in ``one_in``, chosen by hash, is hidden from it
    wherever it stands; found are the mentions of those that the patterns of the others discover."""
    hide = lambda m: F.pmod(F.xxhash64(m["instance"]), F.lit(one_in)) == 0
    marked = materialize(mark(docs), f"{shared_dir(docs.sparkSession)}/marked")
    masked = marked.withColumn("mentions", F.transform("mentions", lambda m: m.withField("kind", F.when(~hide(m), m["kind"]))))
    more = discover(masked, learn(masked, least_seeds, confident)).select("same", F.explode("more").alias("s")).select("same", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(1).alias("hit"))
    hidden = marked.select("same", F.explode(F.filter("mentions", lambda m: m["kind"].isNotNull() & hide(m))).alias("m")).select("same", "m.kind", "m.start", "m.end")
    return hidden.join(more, ["same", "start", "end"], "left").groupBy("kind").agg(F.count("*").alias("hidden"), F.count("hit").alias("found"))


def detect(docs: DataFrame) -> DataFrame:
    """(same, doc_id, spans): base and discovered spans of every row, by start, then kind."""
    marked = materialize(mark(docs), f"{shared_dir(docs.sparkSession)}/marked")
    more = discover(marked, learn(marked))
    every = F.concat("spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    by_start = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))), lambda s: F.struct(s["rank"], s["kind"], s["start"], s["end"]))
    return marked.join(more, "same", "left").select("same", "doc_id", by_start.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans."""

    def rendered(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint").alias(f"n_{KINDS[rank]}")

    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return found.select("doc_id", *[count(r) for r in range(len(KINDS))], F.sha2(rendered(base), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets; n_chars, if there, follows.

    Overlapping spans are replaced as one, under the kind of the first. Rows without spans are unchanged.
    """
    key, spans = fresh(docs, "same", "spans")
    found = detect(docs).where(F.size("spans") > 0).select(F.col("same").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    joined = docs.withColumn(key, same_key(docs)).join(found, key, "left").drop(key)
    start = lambda s: s["start"]
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substr(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(F.lit(0), start(s) - state["at"]).cast("int"))
        shown = F.when(start(s) >= state["at"], F.concat(state["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), shown.alias("out"))

    done = F.aggregate(spans, empty, step, lambda state: F.concat(state["out"], F.substr(F.col("text"), (state["at"] + 1).cast("int"))))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(done)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
