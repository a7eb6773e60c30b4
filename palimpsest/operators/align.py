"""Block alignment: sections, exact matches, gaps, similarity pairing, rows and moves.

One chain without a self-join: blocks are brought together per (pair, section) once, and every later
step explodes or annotates that table. Hashed on ``pair_id``, it is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import kernels as K
from palimpsest.operators.tokens import word_hashes
from palimpsest.options import CompareOptions
from palimpsest.schema import sec_ord

PS = ["pair_id", "sec"]
BLOCK = ["pos", "kind", "level", "align", "cells", "bkey", "key_len"]


def with_pairs(blocks: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Blocks of one side of every pair (``pairs``: pair_id, doc_a, doc_b)."""
    p = pairs.select("pair_id", F.col(f"doc_{side}").alias("doc_id"))
    return p.join(blocks, "doc_id").drop("doc_id")


def sections(a: DataFrame, b: DataFrame) -> DataFrame:
    """sections(pair_id, sec, a, b): the prepared blocks of both sides in reading order.

    Both sides go through one shuffle together; everything after it stays hashed on pair_id.
    """
    tag = lambda blocks, s: blocks.select(*PS, F.lit(s).alias("side"), F.struct(*BLOCK).alias("x"))
    both = tag(a, "a").unionByName(tag(b, "b")).repartition("pair_id")
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("x")))).alias(s)
    return both.groupBy(*PS).agg(pick("a"), pick("b"))


def split_stretches(secs: DataFrame) -> DataFrame:
    """stretches(pair_id, sec, seg, eq, a, b): equal runs and gaps of one longest order-preserving
    alignment of the block keys. Only 8-byte keys reach the kernel, and none for equal sections."""
    ka = F.transform("a", lambda x: x["bkey"])
    kb = F.transform("b", lambda x: x["bkey"])
    same = (F.size("a") == F.size("b")) & (ka == kb)
    null = F.lit(None).cast("array<bigint>")
    one_sided = (F.size("a") == 0) | (F.size("b") == 0)
    easy = same | one_sided
    t = secs.withColumn("st", K.key_stretches(F.when(easy, null).otherwise(ka), F.when(easy, null).otherwise(kb)))
    whole = F.array(F.struct(F.lit(0).alias("a0"), F.size("a").alias("an"), F.lit(0).alias("b0"),
                             F.size("b").alias("bn"), same.alias("eq")))
    parts = F.transform(F.when(easy, whole).otherwise(F.col("st")), lambda s, i: F.struct(
        i.alias("seg"), s["eq"].alias("eq"),
        F.slice("a", s["a0"] + 1, s["an"]).alias("a"), F.slice("b", s["b0"] + 1, s["bn"]).alias("b")))
    return t.select(*PS, F.explode(parts).alias("s")).select(*PS, "s.*")


def matched_blocks(stretches: DataFrame) -> DataFrame:
    """matches(pair_id, sec, a_pos, b_pos)."""
    return stretches.filter("eq").select(*PS, F.explode(F.arrays_zip(
        F.transform("a", lambda x: x["pos"]).alias("p"), F.transform("b", lambda x: x["pos"]).alias("q"))).alias("m")) \
        .select(*PS, F.col("m.p").alias("a_pos"), F.col("m.q").alias("b_pos"))


def gap_sizes(stretches: DataFrame) -> DataFrame:
    """gaps(pair_id, sec, seg, n, m)."""
    return stretches.filter(~F.col("eq")).select(*PS, "seg", F.size("a").alias("n"), F.size("b").alias("m"))


def degraded(gaps: DataFrame, o: CompareOptions) -> DataFrame:
    """Per pair: whether a gap was paired by position (only if asked for), whether that kept blocks from being split, largest gap."""
    area = F.col("n").cast("long") * F.col("m")
    return gaps.groupBy("pair_id").agg(
        F.bool_or(F.lit(o.by_position) & (area > 1)).alias("pair_fallback"),
        F.bool_or(F.lit(o.merge_paras and o.by_position) & (area > 1)).alias("merge_off"),
        F.max(area).alias("max_region"))


def pair_rows(stretches: DataFrame, o: CompareOptions) -> DataFrame:
    """rows(pair_id, row, sec, kind, a, b): a and b are the blocks of the row; every kept block is
    used exactly once. Only gaps with several blocks on a side reach the similarity kernel."""
    n, m = F.size("a"), F.size("b")
    ask = ~F.col("eq") & (n > 0) & (m > 0) & ~((n == 1) & (m == 1))
    words = lambda c: F.when(ask, F.transform(c, lambda x: word_hashes(x["cells"], o)))
    kernel = K.gap_groups_by_position if o.by_position else K.gap_groups_split if o.merge_paras else K.gap_groups
    t = stretches.withColumn("g", kernel(words("a"), words("b")))
    none = F.slice("a", 1, 0)
    item = lambda kind, i, a, b: F.struct(
        i.cast("int").alias("gi"), kind.alias("kind"), a.alias("a"), b.alias("b"))
    equal = F.transform("a", lambda x, i: item(F.lit("equal"), i, F.array(x), F.array(F.element_at("b", i + 1))))
    removed = F.transform("a", lambda x, i: item(F.lit("removed"), i, F.array(x), none))
    added = F.transform("b", lambda x, i: item(F.lit("added"), i, none, F.array(x)))
    single = F.array(item(F.lit("modified"), F.lit(0), F.col("a"), F.col("b")))
    solved = F.transform("g", lambda g, i: item(
        F.when(g["bn"] == 0, "removed").when(g["an"] == 0, "added").otherwise("modified"), i,
        F.slice("a", g["a0"] + 1, g["an"]), F.slice("b", g["b0"] + 1, g["bn"])))
    items = (F.when(F.col("eq"), equal).when(m == 0, removed).when(n == 0, added)
             .when((n == 1) & (m == 1), single).otherwise(solved))
    order = Window.partitionBy("pair_id").orderBy(sec_ord(F.col("sec")), "seg", "gi")
    return t.select(*PS, "seg", F.explode(items).alias("x")).select(*PS, "seg", "x.*") \
        .select("pair_id", (F.row_number().over(order) - 1).alias("row"), "sec", "kind", "a", "b")


def find_moves(rows: DataFrame) -> DataFrame:
    """Adds ``move_row``, ``move_to`` and the moved kinds: the k-th removed block of a key goes with
    the k-th added one. Body only; the key needs six visible characters."""
    blk = F.when(F.col("kind") == "removed", F.col("a")[0]).when(F.col("kind") == "added", F.col("b")[0])
    t = rows.withColumn("_k", F.when((F.col("sec") == "body") & (blk["key_len"] >= 6), blk["bkey"]))
    nth = Window.partitionBy("pair_id", "_k", "kind").orderBy("row")
    t = t.withColumn("_n", F.when(F.col("_k").isNotNull(), F.row_number().over(nth)))
    both = Window.partitionBy("pair_id", "_k", "_n")
    src = F.max(F.when(F.col("kind") == "removed", F.col("row"))).over(both)
    dst = F.max(F.when(F.col("kind") == "added", F.col("row"))).over(both)
    to = F.max(F.when(F.col("kind") == "added", F.col("b")[0]["pos"])).over(both)
    t = t.withColumn("_src", src).withColumn("_dst", dst).withColumn("_to", to)
    hit = F.col("_k").isNotNull() & F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    return t.select(
        "pair_id", "row", "sec",
        F.when(hit & (F.col("kind") == "removed"), "moved-from").when(hit & (F.col("kind") == "added"), "moved-to")
        .otherwise(F.col("kind")).alias("kind"), "a", "b",
        F.when(hit, F.when(F.col("kind") == "removed", F.col("_dst")).otherwise(F.col("_src"))).alias("move_row"),
        F.when(hit, F.col("_to") + 1).alias("move_to"))


def row_lists(rows: DataFrame) -> DataFrame:
    """The rows with block positions only: a_list, b_list."""
    pos = lambda c: F.transform(c, lambda x: x["pos"])
    keep = [c for c in rows.columns if c not in ("a", "b", "merged")]
    return rows.select(*keep, pos("a").alias("a_list"), pos("b").alias("b_list"))


# ---- the single measures, for tables of token keys ------------------------------------------------

def dice(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Multiset Dice per ``by`` group of two token tables (columns by + key); both empty gives 1."""
    return _overlap(left, right, by).select(
        *by, F.when(F.col("na") + F.col("nb") == 0, 1.0)
        .otherwise(2.0 * F.col("common") / (F.col("na") + F.col("nb"))).alias("dice"))


def containment(part: DataFrame, whole: DataFrame, by: list[str]) -> DataFrame:
    """Share of the part's tokens found in the whole, as multisets; an empty part gives 0."""
    return _overlap(part, whole, by).select(
        *by, F.when(F.col("na") == 0, 0.0).otherwise(F.col("common") / F.col("na")).alias("containment"))


def _overlap(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    # One aggregation over the union: combined before the shuffle, no join.
    tag = lambda df, x, y: df.select(*by, "key", F.lit(x).alias("x"), F.lit(y).alias("y"))
    counts = tag(left, 1, 0).unionByName(tag(right, 0, 1)).groupBy(*by, "key") \
        .agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    real = F.col("key").isNotNull()
    total = lambda c: F.sum(F.when(real, c).otherwise(0))
    return counts.groupBy(*by).agg(
        total(F.least("x", "y")).alias("common"), total(F.col("x")).alias("na"), total(F.col("y")).alias("nb"))
