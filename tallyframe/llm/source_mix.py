"""Mixing sources to target weights, by blocks.

The words of a source, document after document, are packed into blocks of equal length. The output is a sequence of shards of
equally many slots. Each shard draws how many of its slots every source gets: multinomial counts, conditioned on
every source's total being its quota, which is drawing slots from all quotas without replacement. A source's slots
are counted through the shards; slot ``k`` of a source with ``n`` blocks is the place ``k mod n`` of its epoch
``k div n``, and a pseudorandom permutation of that epoch turns the place into a block index. Blocks meet documents by
index. Permutations are swap-or-not networks, one to one on any number of indexes and computed per row, so nothing is
sorted or gathered to shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, written

BLOCK = 128          # words of a block
SHARD = 1 << 16      # slots of an output shard
RUN = 1 << 12        # slots that are computed together
EPOCHS = 3           # times a source may be taken
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
ROUNDS = 48          # of a permutation
BUCKET = 5_000       # documents whose places are counted together
CELLS = 1024         # of the quota line, to find a slot's source
SEED = 13


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` and ``h``, a hash of the text: one row per document, repeated ones as one row with ``copies``."""
    d = columns(docs, doc_id="bigint", source="string", text="string")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    d = d.select("doc_id", "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    return d.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies"))


def targets(by_source: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_no, source_size, target`` from ``source, source_size``.

    The weights share the sum of all sizes; no target exceeds ``epochs`` times its source, and what is over goes to the others by
    weight until none exceeds. In rising order of limit by weight the sources at their limit come first, so one pass over
    the sources, one row each, finds the level of the rest. Sources are in order of code points, null last.
    """
    # One row per source: these windows never hold documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = by_source.withColumn("source_no", F.row_number().over(order).cast("long") - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("limit", F.col("source_size") * float(epochs))
    rising = Window.orderBy(F.col("limit") / F.col("w"), "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("full", F.col("limit") / F.col("w") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), "source_no", "level"))).over(every)["level"]
    return s.withColumn("target", F.when(F.col("full") | (F.col("source_size") == 0), F.col("limit"))
                        .otherwise(F.least(F.col("limit"), F.col("w") * rest))).select("source", "source_no", "source_size", "target")


def quotas(sources: DataFrame, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """Blocks of every source and how many slots come near its target: whole epochs, and blocks of one more."""
    blocks = F.ceil(F.col("source_size") / block)
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    slots = whole * blocks + F.round((F.col("target") - whole * F.col("source_size")) / block).cast("long")
    q = sources.withColumn("blocks", blocks).withColumn("slots", F.least(slots, epochs * blocks))
    upto = F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return q.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("slots"))


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The image of ``x`` under a permutation of 0 .. n-1: swap-or-not. Each round pairs ``x`` with
    ``k - x mod n`` and lets a hash that both partners share decide whether they change places."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.struct(
        F.pmod(F.xxhash64(F.lit(SEED), r, *key), n).alias("k"), r.alias("r"), F.xxhash64(r, *key).alias("salt")))

    def swap(at: Column, k: Column) -> Column:
        other = F.pmod(k["k"] - at, n)
        return F.when(F.xxhash64(k["salt"], F.greatest(at, other)) > 0, other).otherwise(at)
    return F.aggregate(keys, x.cast("long"), swap)


def shard_counts(quota: DataFrame, total: int, shard: int = SHARD) -> DataFrame:
    """``shard, source_no, n, first``: slots each source has in a shard, and how many it has in earlier ones.

    Slot ``g`` of all ``total`` draws the place ``permuted(g)`` on the line of quotas; its owner is found among the sources
    that touch the place's cell of the line. Counts leave the tasks, not slots.
    """
    spark = quota.sparkSession
    if total == 0:
        return spark.createDataFrame([], "shard long, source_no long, n long, first long")
    width = -(-total // CELLS)
    lines = quota.where("slots > 0").select("source_no", "before", "upto", F.explode(F.sequence(
        F.floor(F.col("before") / width), F.floor((F.col("upto") - 1) / width))).alias("cell"))
    draws = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), permuted(F.col("id"), F.lit(total)).alias("at"))
    draws = draws.withColumn("cell", F.floor(F.col("at") / width))
    counts = draws.join(lines, "cell").where("at >= before AND at < upto").groupBy("shard", "source_no").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("first", F.coalesce(first, F.lit(0)))


def slots(counts: DataFrame, quota: DataFrame, total: int) -> DataFrame:
    """``shard, source_no, k, block``: the block every slot of the mix holds; ``k`` counts a source's slots.

    Counts are few rows that stand for many slots, so they are cut into runs of slots and dealt out first.
    """
    rows = counts.join(quota.select("source_no", "blocks"), "source_no")
    cut = F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(RUN).cast("long")))
    rows = rows.withColumn("from", cut).withColumn("to", F.least(F.col("from") + RUN, F.col("first") + F.col("n")) - 1)
    rows = rows.repartition(max(1, -(-total // SHARD)), "source_no", "from")
    rows = rows.select("shard", "source_no", "blocks", F.explode(F.sequence("from", "to")).alias("k"))
    place, epoch = F.col("k") % F.col("blocks"), F.floor(F.col("k") / F.col("blocks"))
    return rows.select("shard", "source_no", "k", permuted(place, F.col("blocks"), F.col("source_no"), epoch).alias("block"))


def packed(docs: DataFrame) -> DataFrame:
    """``sizes`` rows with ``source_no`` and ``start``, the words of the source before the document.

    Documents are in hash order. Each bucket of a source counts its own, then sums of buckets are added, so
    a source that holds most rows is spread over many tasks.
    """
    n = docs.count()
    buckets = max(1, -(-n // BUCKET))
    d = docs.withColumn("bucket", F.pmod(F.xxhash64("h", "doc_id"), F.lit(buckets)))
    held = F.col("size") * F.col("copies")
    sums = d.groupBy("source_no", "bucket").agg(F.sum(held).alias("held"))
    ahead = F.sum("held").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_no", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum(held).over(Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size")
                              .rowsBetween(Window.unboundedPreceding, -1))
    return d.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(within, F.lit(0))).drop("bucket", "ahead")


class Mix:
    """A mix of documents: ``documents`` with their place, ``sources`` with targets and quotas, and ``slots``.

    The same documents give the same mix, in whatever order or partitions they come. A null text has no words, a null source is a
    source of its own, the last; documents without words stay and take nothing; an empty table gives empty tables.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, epochs: int = EPOCHS):
        self.block = block
        found = written(sizes(docs), "mix-sizes")
        by_source = found.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        self.sources = written(quotas(targets(by_source, weights, epochs), block, epochs), "mix-sources")
        named = self.sources.select(F.col("source").alias("of"), "source_no", "source_size", "target")
        rows = found.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
        rows = packed(rows).withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
        self.documents = written(rows.select("doc_id", "source_no", "start", "size", "source_size", "target"), "mix-documents")
        total = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first().n
        self.slots = slots(written(shard_counts(self.sources, total, shard), "mix-counts"), self.sources, total)

    def pieces(self) -> DataFrame:
        """``source_no, block, start, words``: the part of every document that lies in a block."""
        b = self.block
        at = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))
        rows = self.documents.where("size > 0").select("source_no", "start", "size", F.explode(at).alias("block"))
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return rows.select("source_no", "block", "start", (end - F.greatest("start", F.col("block") * b)).alias("words"))

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken``: how many words of each document the mix holds, repeats counted."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        used = (self.pieces().join(times, ["source_no", "block"]).groupBy("source_no", "start")
                .agg(F.sum(F.col("words") * F.col("times")).alias("taken")).withColumn("has", F.lit(True)))
        rows = self.documents.withColumn("has", F.col("size") > 0)
        return rows.join(used, ["source_no", "start", "has"], "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
