"""Exact deduplication by content-defined chunk recipes (columns only).

A normalised text is cut where its own characters say so, so equal texts, and equal stretches of different texts,
give equal chunks. Chunks are deduplicated to identifiers: the 64-bit fingerprint, verified by one pass that moves
each distinct chunk once (after dropping repeats inside each task) and finds fingerprints that stand for several
texts; those few get a rank besides. Documents are then compared by their ordered identifier lists only.

Groups are made by a combined aggregate and joined back, so a group of any size stays spread over tasks.

Defined cases: a null text is empty, and all empty texts are equal; a text of blanks becomes one blank; rows that
repeat a doc_id with an equal text all carry its keep_id and count in group_size; a null doc_id is never the smallest
unless the group has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, id_key, rows_of, saved, text_of

SHORTEST, LONGEST = 512, 8192
# Cut characters: about a quarter of the letters and digits, picked by a multiplicative hash of their code.
CUTS = "".join(chr(c) for c in range(48, 123) if chr(c).isalnum() and (c * 2654435761 >> 9) % 4 == 0)


def normal(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text: each ends at the first three cut characters in a row after ``shortest`` characters."""
    pattern = f"(?s).{{{shortest},{longest}}}?[{CUTS}]{{3}}|.{{1,{longest + 3}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fingerprint(chunk: Column, bits: int = 64) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def clashing(pieces: DataFrame) -> DataFrame:
    """Chunks (fp, chunk, …) whose fingerprint stands for several texts: (fp, chunk, rank ≥ 1), usually none."""
    distinct = pieces.select("fp", "chunk").distinct()
    several = saved(distinct.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    if several.isEmpty():
        return several.select("fp", F.lit("").alias("chunk"), F.lit(0).alias("rank"))
    texts = pieces.join(several, "fp", "left_semi").select("fp", "chunk").distinct()
    return saved(texts.withColumn("rank", F.row_number().over(W.partitionBy("fp").orderBy("chunk"))))


def recipes(docs: DataFrame, bits: int = 64, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Documents (doc_id, text) → (doc_id, ids, text_sha256); ids is the ordered list of verified identifiers."""
    text = docs.select("doc_id", normal(text_of()).alias("_t"))
    listed = text.select("doc_id", "_t", chunks(F.col("_t"), shortest, longest).alias("_c"))
    pieces = listed.select(F.explode("_c").alias("chunk")).select(fingerprint(F.col("chunk"), bits).alias("fp"), "chunk")
    clash = clashing(pieces)
    ids = F.transform("_c", lambda c: fingerprint(c, bits))
    plain = listed.select("doc_id", ids.alias("ids"), F.sha2("_t", 256).alias("text_sha256"))
    if clash.isEmpty():
        return saved(plain.withColumn("ranks", F.array().cast("array<struct<pos:int,rank:int>>")))
    # a repeated row has the same list, so (doc_id, digest) says enough to bring the ranks back
    exploded = listed.select("doc_id", F.sha2("_t", 256).alias("text_sha256"), F.posexplode("_c").alias("pos", "chunk"))
    marked = (exploded.withColumn("fp", fingerprint(F.col("chunk"), bits)).join(clash, ["fp", "chunk"])
              .groupBy("doc_id", "text_sha256")
              .agg(F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))
              .withColumnsRenamed({"doc_id": "_d", "text_sha256": "_s"}))
    return saved(plain.join(marked, plain["doc_id"].eqNullSafe(marked["_d"]) & (plain["text_sha256"] == marked["_s"]), "left")
                 .select("doc_id", "ids", "text_sha256", F.coalesce("ranks", F.array()).alias("ranks")))


def exact_groups(docs: DataFrame, bits: int = 64, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Documents → (doc_id, keep_id, group_size, kept, text_sha256), one row each."""
    rows = recipes(docs, bits, shortest, longest)
    # written, so that the join deals out both sides itself and AQE can split the copies of one text
    groups = saved(rows.groupBy("ids", "ranks").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    return (rows.join(groups, ["ids", "ranks"], "left")
            .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all their columns; of repeated rows (same doc_id, equal text) the smallest stays."""
    kept = exact_groups(docs).where("kept").select(id_key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    return rows_of(docs, id_key(F.col("doc_id"), F.sha2(normal(text_of()), 256)), kept)
