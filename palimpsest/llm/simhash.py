"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes a vector of bit counts, one per 2-bit segment, packed as 32 fields of one long. The Manhattan
distance of two vectors is a lower bound of their Hamming distance, so fingerprints within 4 bits have vectors
within 4; then at least four of the eight groups of four segments have equal counts. The cells of the grid are the
counts of any four groups (70 cells per fingerprint): every link shares a cell. Links are verified by
``bit_count(xor)``.

Only distinct fingerprints enter. A cell is first linked to its smallest fingerprint; cells that this joins into one
component need no more. In the rest only pairs of different components are compared, inside the join condition, so
neither copies nor a large group of near copies are expanded into pairs, and no link between components is lost.

Defined cases: a text without words (null, empty, blank) has fingerprint 0, which links like any other; equal rows
share their component; a null doc_id takes the component of its fingerprint's others; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import components, id_key, rows_of, saved, text_of

WORDS, DISTANCE, GROUPS = 4, 4, 8
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if it is set in over half the shingle hashes."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    else:
        joined, stop = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        start = np.concatenate(([0], stop[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(start[: len(parts) - words + 1].tolist(), stop[words - 1:].tolist())]
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    set_in = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * set_in > len(hashes)).tolist())


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in text], np.uint64).view(np.int64))


def _cells(distinct: DataFrame, groups: int, distance: int) -> DataFrame:
    """(fp) → (fp, cell): the grid cells of a fingerprint."""
    width = 64 // groups
    masks = []
    for keep in combinations(range(groups), groups - distance):
        m = sum(((1 << width) - 1) << (width * g) for g in keep)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    fp, odd = F.col("fp"), F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # 0, 1 or 2 in each 2-bit field
    return (distinct.select("fp", counts.alias("v"), F.posexplode(F.array(*map(F.lit, masks))).alias("which", "mask"))
            .select("fp", F.xxhash64("which", F.col("v").bitwiseAND(F.col("mask"))).alias("cell")))


def linked(distinct: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """Distinct fingerprints (fp) → (node, component) of those that link with others, over the links of ``distance``."""
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    # spread before every fingerprint becomes many rows: small partitions would be merged by their size of now
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(distinct.repartition(parts, "fp"), groups, distance)
    lows = cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    # planned sizes leave out that a fingerprint has many cells: without the hint Spark may broadcast them
    crowded = saved(cells.hint("merge").join(lows.select("cell", "low"), "cell"))
    first = components(crowded.where((F.col("fp") != F.col("low")) & near("fp", "low"))
                       .select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct())
    home = crowded.select("cell", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "cell", "fp", F.coalesce("component", "fp").alias("home"))
    mixed = home.groupBy("cell").agg(F.min("home").alias("h0"), F.max("home").alias("h1")).where("h0 <> h1").select("cell")
    open_cells = saved(home.join(mixed, "cell", "left_semi"))
    a, b = open_cells.select("cell", F.col("fp").alias("x"), F.col("home").alias("a")), open_cells.select(
        "cell", F.col("fp").alias("y"), F.col("home").alias("b"))
    links = a.join(b, "cell").where((F.col("a") < F.col("b")) & near("x", "y")).select("a", "b").distinct()
    inner = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(inner.union(links))


def _least(rows: DataFrame, distance: int) -> DataFrame:
    """Rows (fp, rank) → (fp, least): the smallest rank in the component of each distinct fingerprint.

    Fingerprints without links are components of their own and enter no join on components. Both small tables are
    written, so that a join with them deals out both sides itself and AQE can split a hot component or fingerprint.
    """
    firsts = rows.groupBy("fp").agg(F.min("rank").alias("first"))
    found = saved(linked(firsts.select("fp"), distance).select(F.col("node").alias("fp"), "component"))
    least = saved(firsts.join(found, "fp").groupBy("component").agg(F.min("first").alias("least")))
    return saved(firsts.join(found.join(least, "component"), "fp", "left").select("fp", F.coalesce("least", "first").alias("least")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Documents (doc_id, text) → (doc_id, fingerprint, component_id), one row each."""
    rows = saved(docs.select(F.col("doc_id").alias("rank"), fingerprints("text").alias("fp")))
    return rows.join(_least(rows, distance), "fp").select(
        F.col("rank").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, all its columns: that with the smallest doc_id (null ids last).

    Of repeated doc_ids inside a component the one with the smallest text digest stays, then the smallest row.
    """
    digest = F.sha2(text_of(), 256)
    rank = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))
    rows = saved(docs.select(rank.alias("rank"), fingerprints("text").alias("fp")))
    stay = _least(rows, distance).select(id_key(F.col("least.id"), F.col("least.digest")).alias("_key"))
    return rows_of(docs, id_key(F.col("doc_id"), digest), stay)
