"""Mixing sources to target weights by a low-discrepancy schedule (columns only).

Van der Corput points walk through the cumulative shares of the sources; each point is a slot of ``block`` words,
and the slots of a source are ranked, as many as its target has blocks. Each source's documents form a shuffled stream of words, cut into equal
blocks; slot r takes block r. A second epoch, shuffled anew, follows where a target exceeds its source.

Ranks and running sums are made in two levels (bounded chunks, then sums per chunk), so no task holds a source.

Defined cases: null texts count no words; documents without words take 0; a null source is a source of its own, the
last; equal rows (doc_id, source, size) are numbered as copies and treated as separate documents; an empty table
gives an empty result; if no source has words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, saved, text_of

WEIGHTS, SHARE, EPOCHS, BLOCK = (5.0, 2.0, 1.0), 1.5, 2, 256
CHUNK, SUBS = 4096, 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) → + sid, weight, target: shares by weight, none above ``epochs`` times its source.

    The level that fills all sources to ``share`` of all words is read off the sources in order of their cap per
    weight. One row per source; only this small table is ordered in one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    whole, size, weight = W.partitionBy(), F.col("source_size"), F.col("weight")
    by_cap = W.orderBy("ratio", "sid")
    s = (sources.withColumn("sid", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
         .withColumn("ratio", epochs * size / weight)
         .withColumn("level", (share * F.sum(size).over(whole)
                               - F.coalesce(F.sum(epochs * size).over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
                     / F.sum(weight).over(by_cap.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.col("level"))).over(whole)))
    return s.select("source", "source_size", "sid", "weight",
                    F.least((epochs * size).cast("double"), F.col("level") * weight).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots (slot, sid, block_no): which source fills each slot, and with which of its blocks.

    Every source gets as many slots as its target has blocks: the first points of the sequence that fall into its
    share. Among the first 2**k points those of a share are the multiples of 2**-k in it, each point's number being
    its multiple with the bits reversed; k is taken so large that the share holds enough of them.
    """
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = W.orderBy("sid")
    t = (targets.withColumn("hi", F.sum("target").over(order) / F.lit(total or 1.0))
         .withColumn("hi", F.when(F.lead("sid").over(order).isNull(), 1.0).otherwise(F.col("hi")))
         .withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).where("lo < hi")
         .withColumn("need", F.ceil(F.round("target") / block)).where("need > 0")
         .withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2((F.col("need") + 2) / (F.col("hi") - F.col("lo"))))).cast("int"))
         .withColumn("first", F.ceil(F.col("lo") * F.pow(F.lit(2.0), "bits")))
         .withColumn("last", F.ceil(F.col("hi") * F.pow(F.lit(2.0), "bits")) - 1))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / CHUNK)))
    stretches = t.select("*", stretch.alias("stretch")).repartition(parts, "sid", "stretch")
    start = F.col("first") + F.col("stretch") * CHUNK
    points = stretches.select("*", F.explode(F.sequence(start, F.least(start + CHUNK - 1, F.col("last")))).alias("point"))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    placed = (points.withColumn("slot", slot)
              .select("slot", "sid", "need", F.floor(F.col("slot") * (F.col("hi") - F.col("lo")) / CHUNK).alias("chunk")))
    before = W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    base = placed.groupBy("sid", "chunk").count().select(
        "sid", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot"))
    # planned sizes are those of the few sources, not of the slots made of them: without the hints Spark may broadcast slots
    return (placed.withColumn("rank", rank).hint("merge").join(base, ["sid", "chunk"])
            .withColumn("block_no", F.col("base") + F.col("rank") - 1).where("block_no < need").select("slot", "sid", "block_no"))


def mix(docs: DataFrame, seed: int = 0, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """Documents (doc_id, source, text) → (doc_id, copy, source, size, source_size, target, taken, first_slot).

    ``first_slot`` is the first slot of the schedule that takes words of the document (null: none does). Slots below
    any number hold the sources by their weights, so the mix can be read in slot order and stopped anywhere.
    """
    digest = saved(docs.select("doc_id", "source", word_count(text_of()).alias("size"))
                   .groupBy("doc_id", "source", "size").count()
                   .select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy")))
    targets = saved(source_targets(digest.groupBy("source").agg(F.sum("size").alias("source_size")), epochs=epochs))
    named = targets.withColumnRenamed("source", "name")
    rows = (digest.join(named, digest["source"].eqNullSafe(named["name"])).drop("name", "weight")
            .withColumn("last", F.round("target").cast("long")))
    e = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    rows = (rows.withColumn("epoch", e).where((F.col("epoch") == 0) | (F.col("epoch") * F.col("source_size") < F.col("last")))
            .withColumn("mark", F.xxhash64("doc_id", "copy", "epoch", F.lit(seed)))
            .withColumn("sub", F.shiftrightunsigned("mark", 64 - (SUBS - 1).bit_length())))
    sums = rows.groupBy("sid", "epoch", "sub").agg(F.sum("size").alias("words"))
    before = W.partitionBy("sid", "epoch").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("sid", "epoch", "sub", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("sid", "epoch", "sub").orderBy("mark", "doc_id", "size", "copy").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("epoch") * F.col("source_size") + F.col("base") + F.coalesce(F.col("within"), F.lit(0))
    rows = (rows.withColumn("within", F.sum("size").over(inside)).join(sums, ["sid", "epoch", "sub"])
            .withColumn("start", at).withColumn("stop", F.least(at + F.col("size"), F.col("last"))))
    first, final = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
    keys = ["doc_id", "copy", "source", "size", "source_size", "target"]
    pieces = (rows.withColumn("block_no", F.explode_outer(F.when(F.col("start") < F.col("stop"), F.sequence(first, final))))
              .select(*keys, "sid", "block_no",
                      (F.least("stop", (F.col("block_no") + 1) * block) - F.greatest("start", F.col("block_no") * block)).alias("words")))
    slots = schedule(targets, block)
    taken = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)
    return (pieces.join(slots.hint("merge"), ["sid", "block_no"], "left").groupBy(*keys)
            .agg(F.sum(taken).cast("long").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot")))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it (taken words over its size, rounded), 0 to 2 times.

    Documents without words carry none and are left out. Equal rows are separate documents.
    """
    m = mix(docs, seed).where("size > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_times"))
    m = m.groupBy("_id", "_source", "_size").agg(F.sum("_times").alias("_times"), F.count("*").alias("_rows")).where("_times > 0")
    # the row travels in a struct, so that no column name can clash
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), word_count(text_of()).alias("words"))
    # equal rows share their takes: the larger shares first, the same for whichever row comes first
    nth = F.row_number().over(W.partitionBy("_id", "_source", "_size").orderBy("row"))
    on = F.col("id").eqNullSafe(F.col("_id")) & F.col("of").eqNullSafe(F.col("_source")) & (F.col("words") == F.col("_size"))
    once = d.join(m.where("_rows = 1"), on)
    many = (d.join(m.where("_rows > 1"), on).withColumn("_nth", nth)
            .withColumn("_times", F.floor(F.col("_times") / F.col("_rows"))
                        + F.when(F.col("_nth") <= F.col("_times") % F.col("_rows"), 1).otherwise(0)).where("_times > 0"))
    out = once.select("row", F.col("_times").cast("long").alias("_times")).union(many.select("row", F.col("_times").cast("long").alias("_times")))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_n")).select("row.*")
