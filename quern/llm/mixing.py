"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a pseudo-random order, repeated ``epochs`` times. A document's
virtual finish time is the number of words its source has sent once it is through, divided by the source's
weight. Documents are served in the order of finish times, sorted by ranges over all sources, and that order is cut
at the total budget. A queue that runs dry thereby leaves its share to the others, and each source comes to
``min(weight * T, epochs * size)`` words, where T is the virtual time at which the budget is used up.

So that long documents do not throw a source off its share, a document of more than 1/4096 of its source's words is
queued in pieces of that size (a source has at most 4096 of them besides its documents, however large it is): each
source meets its target to within one piece, and the total is the budget to the word.

Running totals are kept in two levels: (source, hash bucket) and rows within one, for the queues; ranges of finish
times and rows within the one range where the budget ends, for the cut. So no task sees a whole source or table, and
only the one row of the cut reaches the driver.
Null texts have size 0 and are never taken, the null source is a source of its own that ranks last, very long texts are
queued in pieces, and empty input gives empty output. Rows that repeat one another are separate documents; ties of
finish times go by source. Columns of any names are kept, as they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, materialize, shared_dir

#: Hex digits of a document's hash that name its bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
#: A document is queued in pieces of its source's words over this.
PIECES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_levels(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """Target words of each source: (src, no_src, source_size, weight, target).

    One row a source goes in, so the windows without a partition see as many rows as there are sources.
    Sorted by the time at which a source runs dry, the budget is used up in the first stretch whose end
    serves at least the budget; within it T follows from the sources that still send.
    """
    names = Window.orderBy("no_src", "src")
    dry = Window.orderBy("dry_at", "no_src", "src")
    before = dry.rowsBetween(Window.unboundedPreceding, -1)
    onward = dry.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = dry.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("dry_at", F.lit(float(epochs)) * F.col("source_size") / F.col("weight"))
    stretches = ranked.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(F.sum(F.lit(float(epochs)) * F.col("source_size")).over(before), F.lit(0.0)).alias("spent"),
        F.sum("weight").over(onward).alias("sending"),
    ).withColumn("reached", F.col("spent") + F.col("dry_at") * F.col("sending") >= F.col("budget"))
    # The first stretch that reaches the budget, not the least level of all that do.
    first = F.min(F.when(F.col("reached"), F.struct("dry_at", "no_src", "src", ((F.col("budget") - F.col("spent")) / F.col("sending")).alias("level")))).over(everything)
    return stretches.withColumn("level", first["level"]).select(
        "src", "no_src", "source_size", "weight",
        F.least(F.coalesce(F.col("weight") * F.col("level"), F.lit(float("inf"))), F.lit(float(epochs)) * F.col("source_size")).alias("target"),
    )


def _pieces(epoch: int) -> Column:
    """(end, words) of a document's pieces in one epoch; end is the number of words its source has sent by then."""
    begin = F.lit(epoch) * F.col("source_size") + F.col("begin")
    quantum = F.greatest(F.lit(1), F.floor(F.col("source_size") / PIECES)).cast("bigint")
    count = F.ceil(F.col("size") / quantum)
    numbers = F.when(F.col("size") > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
    end = lambda k: F.least(k * quantum, F.col("size"))
    return F.transform(numbers, lambda k: F.struct((begin + end(k)).alias("end"), (end(k) - (k - 1) * quantum).alias("words")))


def _cut(queued: DataFrame, share: float, epochs: int) -> tuple:
    """(finish, no_src, src, words) of the piece at which the budget is used up and the words of it that still fit; None if there is no word.

    The pieces are sorted by finish time over a range partitioning and written down; per range totals tell in which
    range the budget ends, and only that range is run through.
    """
    spark = queued.sparkSession
    pieces = F.explode(F.concat(*[_pieces(e) for e in range(epochs)]))
    rows = queued.select("no_src", "src", "weight", pieces.alias("p")).select((F.col("p.end") / F.col("weight")).alias("finish"), "no_src", "src", F.col("p.words").alias("words"))
    order = ["finish", "no_src", "src"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, f"{shared_dir(spark)}/served")
    through = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a range
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("range").agg(F.sum("words").alias("words")).select(
        "range", (F.sum("words").over(through) - F.col("words")).alias("before"), F.floor(F.lit(float(share) / epochs) * F.sum("words").over(everything)).alias("budget"),
        F.sum("words").over(through).alias("after"),
    )
    last = totals.where("before < budget AND budget <= after").join(ranged, "range")
    inside = Window.partitionBy("range").orderBy(*order)
    run = last.withColumn("through", F.col("before") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reached = run.where("through >= budget").select(*order, (F.col("words") - F.col("through") + F.col("budget")).alias("fit")).orderBy(*order).limit(1).first()
    return None if reached is None else tuple(reached)


def schedule(docs: DataFrame, keep: Sequence[str], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2, salt: str = "mix") -> DataFrame:
    """Each document with its packets, one an epoch.

    Returns doc (struct of the columns ``keep``), size, source_size, target and packets, an array of
    (epoch, finish, take): finish is the virtual finish time, take the words served before the budget is used up.
    Other columns of ``docs`` are ignored. ``share`` must not exceed ``epochs``.
    """
    if not 0 < share <= epochs:
        raise ValueError("share must lie between 0 and epochs")
    spread = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))))
    sized = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("doc"),
        word_count(docs["text"]).alias("size"),
        F.coalesce(docs["source"], F.lit("")).alias("src"),
        docs["source"].isNull().alias("no_src"),
        spread.alias("spread"),
        F.md5(F.coalesce(docs["text"], F.lit(""))).alias("tie"),
    ).withColumn("bucket", F.substring("spread", 1, BUCKET_DIGITS))
    narrow = materialize(sized.drop("doc"), f"{shared_dir(docs.sparkSession)}/sized")
    buckets = narrow.groupBy("src", "no_src", "bucket").agg(F.sum("size").alias("bucket_size"))
    levels = source_levels(buckets.groupBy("src", "no_src").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    earlier = Window.partitionBy("src", "no_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(levels, ["src", "no_src"]).drop("bucket_size")
    offsets = materialize(offsets, f"{shared_dir(docs.sparkSession)}/offsets")  # at most 4096 rows a source
    within = Window.partitionBy("src", "no_src", "bucket").orderBy("spread", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def queue(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("through", F.sum("size").over(within)).join(offsets, ["src", "no_src", "bucket"])
        return placed.withColumn("begin", F.col("offset") + F.col("through") - F.col("size"))

    cut = _cut(queue(narrow), share, epochs)

    def packet(epoch: int) -> Column:
        finish = (F.lit(epoch) * F.col("source_size") + F.col("begin") + F.col("size")) / F.col("weight")
        if cut is None:
            take = F.lit(0).cast("bigint")
        else:
            at = F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).alias("n"), F.lit(cut[2]).alias("s"))
            when = lambda p: F.struct((p["end"] / F.col("weight")).alias("f"), F.col("no_src").alias("n"), F.col("src").alias("s"))
            served = lambda p: F.when(when(p) < at, p["words"]).when(when(p) == at, F.lit(cut[3])).otherwise(F.lit(0)).cast("bigint")
            take = F.aggregate(_pieces(epoch), F.lit(0).cast("bigint"), lambda total, p: total + served(p))
        return F.struct(F.lit(epoch).alias("epoch"), finish.alias("finish"), take.alias("take"))

    packets = F.array(*[packet(e) for e in range(epochs)])
    return queue(sized).select("doc", "size", "source_size", "target", "spread", packets.alias("packets"))


def mix(docs: DataFrame, whole: bool = True, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, in the order of their virtual finish times, repeated as the mix takes them.

    The order is a range sort over all rows. With ``whole``, the one document a source has at the end of the
    budget is kept if at least half of its words fit, so texts stay whole; otherwise it is cut after those words.
    """
    planned = schedule(docs, docs.columns, **options)
    rows = planned.select("doc", "size", "spread", F.explode("packets").alias("p")).where(F.col("p.take") > 0)
    if whole:
        rows = rows.where(2 * F.col("p.take") >= F.col("size"))
    else:
        first = F.regexp_extract(F.col("doc.text"), r"(?s)^.*", 0)
        cut = F.expr(r"regexp_extract(doc.text, concat('^[\\x20\\x09-\\x0D]*(?:[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*){', p.take, '}'), 0)")
        rows = rows.withColumn("doc", F.col("doc").withField("text", F.when(F.col("p.take") < F.col("size"), cut).otherwise(first)))
    return rows.orderBy("p.finish", "spread", "p.epoch").select("doc.*")
