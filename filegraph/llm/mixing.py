"""Mixing sources to target weights by a low-discrepancy schedule.

Slot j of the schedule sits at the golden-ratio point frac((j + 1/2) * (sqrt(5) - 1) / 2). Cumulative target shares cut
the unit interval among the sources; a point falls to one source, so every stretch of the schedule holds the sources in
about their shares. Slots are ranked per source, and the source's slot r takes its block r. A source's blocks are equal
runs of BLOCK words of its documents, laid end to end in hash order and repeated up to the cap. The schedule is
as long as the whole blocks of every target need; slots of a source past its target are void. What then remains of a
target, less than one block, is taken by one closing slot of its source after the schedule. A row is taken as far as
slots hold its words.

Ranks and running sums are taken in two levels (within buckets, then over buckets), so that a source with most rows is
never gathered in one task. DataFrame and SQL functions only. The schedule starts with one slot for BLOCK words of input
and doubles until it is long enough.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at CAP times
the source's own words and the excess is shared again by weight until none is above.

Defined results: null, empty or blank texts have size 0 and taken 0. A source without words has target 0. Rows that
repeat, also under one doc_id, are each placed and returned; rows of one hash follow each other by row number. Very long
texts are counted whole and may span many blocks. Other columns are ignored. No row: no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filegraph.llm.common import WORD, staged

BLOCK, CAP, SEED, BUCKET, BINS = 1024, 3, 8, 20_000, 1024
_GOLDEN = 0.6180339887498949


def size_of(text: Column) -> Column:
    """Number of words of a whole text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row for each source, null included. Windows here hold one row for each source."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    # Sources reach their caps in the order of cap / weight; those before the first that doesn't are at their caps.
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("capped", F.coalesce(F.sum("source_size").over(fill), F.lit(0)) * CAP)
    own = own.withColumn("used", F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    own = own.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    own = own.withColumn("pool", F.col("all_size") - F.col("capped")).withColumn("left", F.col("all_weight") - F.col("used"))
    own = own.withColumn("free", F.col("weight") * F.col("pool") <= CAP * F.col("source_size") * F.col("left"))
    level = F.min(F.when(F.col("free"), F.struct("used", "pool", "left"))).over(every)
    own = own.withColumn("level", level)
    capped = F.col("level").isNull() | (F.col("used") < F.col("level.used"))
    target = F.when(capped, (CAP * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("level.pool")).cast("double") / F.col("level.left"))
    return own.select("source", "source_size", "rows", target.alias("target"))


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's start in its source's shuffled run of words."""
    h = F.xxhash64(F.lit(SEED), "doc_id", "size")
    df = sizes.join(sources.select(F.col("source").alias("s2"), "rows", "source_size", "target"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    df = df.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.ceil(F.col("rows") / BUCKET)))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("base", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    base = base.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base")
    return df.join(base, df["source"].eqNullSafe(base["s2"]) & (df["bucket"] == base["b2"])).withColumn("start", F.col("start") + F.col("base")).drop("s2", "b2", "base", "h", "bucket")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, source, block: the golden-ratio schedule, each slot with its rank among its source's slots."""
    spark = sources.sparkSession
    share = Window.orderBy(F.col("source").asc_nulls_last())
    cuts = sources.withColumn("hi", F.sum("target").over(share.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = cuts.withColumn("all", F.sum("target").over(Window.partitionBy())).filter("target > 0")
    cuts = cuts.select("source", ((F.col("hi") - F.col("target")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    last = F.max("hi").over(Window.partitionBy()) == F.col("hi")
    cuts = cuts.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    # A range join by bins of the unit interval: a point meets only the sources that reach into its bin.
    bins = cuts.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1).cast("long")))).alias("bin"))
    n = F.col("id") + F.lit(0.5)
    points = spark.range(slots).select(F.col("id").alias("slot"), (n * _GOLDEN - F.floor(n * _GOLDEN)).alias("u"), F.floor(F.col("id") / BUCKET).alias("chunk"))
    points = points.withColumn("bin", F.floor(F.col("u") * BINS)).join(bins, "bin").filter("u >= lo AND u < hi").select("slot", "chunk", "source")
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    points = points.withColumn("rank", F.row_number().over(inside) - 1)
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = points.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), "base")
    points = points.join(base, points["source"].eqNullSafe(base["s2"]) & (points["chunk"] == base["c2"]))
    return points.select("slot", "source", (F.col("rank") + F.col("base")).alias("block"))


def dealt(sources: DataFrame, words: int, block: int) -> DataFrame:
    """slot, source, block: the slots that the schedule gives each source up to its target, and the closing slots."""
    ends = sources.select("source", F.floor("target").alias("end")).filter("end > 0").withColumn("full", F.floor(F.col("end") / block))
    own = ends.select(F.col("source").alias("s2"), "full")
    need, n = ends.agg(F.sum("full")).first()[0] or 0, max(1, words // block)
    while True:
        slots = schedule(sources, n).join(own, F.col("source").eqNullSafe(F.col("s2"))).filter("block < full").select("slot", "source", "block")
        slots = staged(slots, "mix-slots")
        if slots.count() >= need:
            break
        n *= 2
    order = Window.orderBy(F.col("source").asc_nulls_last())
    closing = ends.filter(F.col("end") > F.col("full") * block).select((F.row_number().over(order) - 1 + n).cast("long").alias("slot"), "source", F.col("full").alias("block"))
    return slots.unionByName(closing)


def mix(docs: DataFrame, carry: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the row), first_slot, slots (the first of each time), __own (the row, if carried)."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("string")
    cols = [F.col("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"), own.alias("__own")]
    sizes = staged(docs.select(*cols), "mix-sizes")
    sources = staged(targets(sizes.select("source", "size")), "mix-sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    slots = dealt(sources, words, block)

    # The words of a row that its source's run up to the target holds, by pass over the run and by block.
    end = F.floor("target")
    placed = staged(_placed(sizes.drop("__own"), sources), "mix-placed")
    parts = placed.filter("size > 0").select("row", "source", "size", end.alias("end"), F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))).alias("pass"), "start", "source_size")
    parts = parts.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "end")).filter("hi > lo")
    parts = parts.select("row", "source", "pass", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("block"))
    parts = parts.withColumn("words", F.least("hi", (F.col("block") + 1) * block) - F.greatest("lo", F.col("block") * block))
    # The words of a block are taken by its slot alone.
    held = parts.join(slots.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "slot"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    held = held.groupBy("row", "pass").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    taken = held.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"), F.sort_array(F.collect_list("slot")).alias("slots"))
    out = placed.join(taken, "row", "left")
    if carry:
        out = out.join(sizes.select("row", "__own"), "row")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", *["slots", "__own"] * carry)


def report(docs: DataFrame) -> DataFrame:
    return mix(docs)


def emit(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, in the order of the slots: a row appears once for each time that any of its words are taken, whole each time."""
    rows = mix(docs, carry=True).filter("taken > 0").select("__own", F.explode("slots").alias("slot")).orderBy("slot")
    return rows.select(*[F.col(f"__own.`{c}`").alias(c) for c in docs.columns])
