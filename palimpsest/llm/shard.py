"""Sharding by a Feistel permutation with cycle walking over global row numbers; law ``rows``.

Rows are numbered 0 … n-1 in an order that depends on their keys alone (hash bucket, then key), in two levels: row
numbers inside a bucket plus the sum of the buckets before it. A keyed Feistel network permutes [0, n): values
that fall outside are walked on until they are inside. Shard and slot of row r are the remainder and quotient of its
place, so both are computable for any number, as is the inverse (``row_at``). Counts differ by one at most, slots
have no gap.

Defined cases: a null text has no bytes (size 16, CRC 0); equal rows are numbered one after another and are
interchangeable; null keys are keys; an empty table gives an empty result. Equal texts are not kept together: the
law is ``rows``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import saved, text_of

SHARDS, ROUNDS, BUCKETS = 40, 6, 4096


def number_rows(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Distinct keys with their number of equal rows → one row per row: keys, row_no (0 …), n_rows."""
    folded = saved(df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets))))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = folded.groupBy("_b").agg(F.sum("_n").alias("_m")).select(
        "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"), F.sum("_m").over(W.partitionBy()).alias("n_rows"))
    inside = W.partitionBy("_b").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    return (folded.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(base, "_b")
            .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
            .select(*keys, (F.col("_base") + F.col("_at") + F.col("_i")).alias("row_no"), "n_rows"))


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: multiply and shift, on 64-bit words."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int, rounds: int) -> list[int]:
    return [int(k) for k in np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, rounds)]


def permute(x: np.ndarray, n: int, seed: int = 0, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of [0, n) (or its inverse) at each x."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), _keys(seed, rounds)

    def once(y: np.ndarray) -> np.ndarray:
        left, right = y >> shift, y & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_mix(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << shift) | right

    out = once(x.astype(np.uint64))
    while (away := out >= np.uint64(n)).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def place(row_no: Column, n_rows: Column, seed: int = 0) -> Column:
    """The place of each global row number after the shuffle."""
    @F.pandas_udf("long")
    def at(r: pd.Series, n: pd.Series) -> pd.Series:
        out = np.empty(len(r), np.int64)
        for size in n.unique():
            here = (n == size).to_numpy()
            out[here] = permute(r.to_numpy()[here], int(size), seed)
        return pd.Series(out)
    return at(row_no, n_rows)


def row_at(shard: int, slot: int, n_rows: int, shards: int = SHARDS, seed: int = 0) -> int:
    """The global row number stored in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n_rows, seed, inverse=True)[0])


def shard_rows(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Rows by their keys → keys, row_no, n_rows, shard, slot."""
    p = F.col("_p")
    return (number_rows(df, keys).withColumn("_p", place(F.col("row_no"), F.col("n_rows"), seed))
            .withColumn("shard", (p % shards).cast("int")).withColumn("slot", F.floor(p / shards).cast("long")).drop("_p"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Documents (doc_id, text) → doc_id, size, text_crc32, law, row_no, shard, slot, grown_shard."""
    digest = docs.select("doc_id", (F.octet_length(text_of()) + 16).cast("long").alias("size"),
                         F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return shard_rows(digest, ["doc_id", "size", "text_crc32"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_no", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
