"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

DataFrame functions only. Sizes are counted once; everything after works on numbers.

1. One row per source gets a weight by its place in code point order and a target: its share of
   all words, stopped at ``max_repeats`` times its own size, the excess reshared by weight.
2. A schedule deals ``total / block`` slots: the golden-ratio point of slot i falls in one
   source's interval of the cumulative targets. Slots are ranked within their source.
3. Each source's documents, in the order of a seeded hash, form one stream of words, repeated as
   often as its slots ask for and cut into blocks of equal length; slot rank k takes block k.

Repeated rows are separate documents. A null text has size 0. The null source is a source of its
own and comes last. A source of size 0 takes nothing. Input columns other than ``doc_id``,
``text`` and ``source`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 32
SEED = 7

# The schedule's points are multiples of 2^-40; GOLDEN is the odd number next to 2^40 / golden ratio.
POINT_BITS = 40
GOLDEN = int(2**POINT_BITS / ((1 + math.sqrt(5)) / 2)) | 1
CELL_BITS = 12
CHUNK_BITS = 12
SHUFFLE_BUCKET_BITS = 12
HASH_DIGITS = 15

WORD = r"[^\\x20\\x09-\\x0D]+"


def size_column(text: str = "text"):
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes(source, size)`` to ``(sid, source, source_size, weight, target)``, one row a source.

    Sources at their cap are those with the least cap for their weight, so with the sources in
    that order the water level after the first k are capped is a ratio of running sums, and k is
    the first for which the next source stays under its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(place) - 1)
    choices = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(choices, (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeats))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns(
        {
            "left": F.sum(F.col("source_size").cast("double")).over(everything)
            - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    per = per.withColumn("level", F.col("left") / F.col("weight_left"))
    per = per.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "sid", "level"))).over(everything)
    per = per.withColumn("final_level", final["level"])
    return per.select(
        "sid", "source", "source_size", "weight", F.least(F.col("final_level") * F.col("weight"), F.col("cap")).alias("target")
    )


def schedule(targets: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """``(slot, sid, rank)``: ``total / block`` slots dealt to sources in proportion to ``target``.

    A cell table joins points to intervals by equality: 2^CELL_BITS cells plus one more row for
    each inner boundary. Ranks come from counts of each chunk of slots plus the place within it,
    so no source's slots meet in one task.
    """
    spark = targets.sparkSession
    n = -(-total // block)
    scale = 1 << POINT_BITS
    order = Window.orderBy("sid")
    share = F.sum("target").over(order) / F.sum("target").over(Window.partitionBy())
    ends = targets.filter("target > 0").withColumn("hi", F.floor(share * float(scale)).cast("long"))
    last = F.max("sid").over(Window.partitionBy())
    ends = ends.withColumn("hi", F.when(F.col("sid") == last, F.lit(scale)).otherwise(F.col("hi")))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("long"))).filter("hi > lo")
    shift = POINT_BITS - CELL_BITS
    cells = ends.select(
        "sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell")
    )
    half = 1 << (POINT_BITS // 2)
    parts = max(spark.sparkContext.defaultParallelism, n >> 18)
    slots = spark.range(0, n, 1, parts).withColumnRenamed("id", "slot")
    low = (F.col("slot") % half) * GOLDEN % scale
    high = ((F.shiftright("slot", POINT_BITS // 2) % half) * GOLDEN % half) * half
    slots = slots.withColumn("point", (low + high) % scale).withColumn("cell", F.shiftright("point", shift))
    dealt = (
        slots.join(cells, "cell")
        .filter("point >= lo AND point < hi")
        .select("slot", F.col("sid"), F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    )
    counts = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = dealt.withColumn("k", F.row_number().over(within) - 1)
    return ranked.join(offsets, ["sid", "chunk"]).select("slot", "sid", (F.col("offset") + F.col("k")).alias("rank"))


def shuffled_streams(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``start``: words of the same source before this row, rows in seeded hash order.

    Prefix sums over hash buckets of a source, then within each bucket.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), 1, HASH_DIGITS), 16, 10).cast("long")
    rows = sizes.filter("size > 0").withColumn("h", h)
    rows = rows.withColumn("bucket", F.shiftright("h", 4 * HASH_DIGITS - SHUFFLE_BUCKET_BITS))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    so_far = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset"))
    order = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size")
    within = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0)))
    return rows.join(offsets, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("within")).drop("h", "bucket", "offset", "within")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row a document: ``doc_id, size, source, source_size, target, taken``."""
    sizes = materialize(docs.select("doc_id", "source", size_column("text").alias("size")), "sizes")
    targets = materialize(source_targets(sizes, weights, max_repeats), "targets")
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    known = sizes.join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    if total == 0:
        return known.select("doc_id", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    slots = materialize(schedule(targets, total, block), "slots")
    lengths = slots.groupBy("sid").agg(F.count("*").alias("slots"))
    streams = shuffled_streams(known, seed).join(lengths, "sid", "left").fillna(0, ["slots"])
    limit = F.least(F.col("slots") * block, F.col("source_size") * max_repeats)
    streams = streams.withColumn("limit", limit)
    epochs = F.floor((F.col("limit") - F.col("start") - 1) / F.col("source_size"))
    copies = streams.withColumn("epoch", F.explode(F.when(F.col("limit") > F.col("start"), F.sequence(F.lit(0).cast("long"), epochs))))
    copies = copies.withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
    copies = copies.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("limit")))
    pieces = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    words = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    used = (
        pieces.withColumn("words", words)
        .join(slots.select("sid", "rank"), ["sid", "rank"])
        .groupBy("sid", "start")
        .agg(F.sum("words").alias("taken"))
    )
    rows = shuffled_streams(known, seed).join(used, ["sid", "start"], "left")
    columns = ["doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    empty = known.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return rows.select(*columns).unionAll(empty.select(*columns[:-1], "taken"))
