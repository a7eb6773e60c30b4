"""From a corpus to its revisions: which documents are versions of each other, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import align, changes as ch, fingerprint as fp
from palimpsest.operators.tokens import plain_blocks
from palimpsest.options import CompareOptions
from palimpsest.plans import compare as cp
from palimpsest.session import checkpoint, written


def revision_pairs(docs: DataFrame) -> DataFrame:
    """pairs(pair_id, doc_a, doc_b, score): every document with its best other version.

    Copies are one document here (the smallest id stands for them); a pair found from both sides is one
    pair. One partner per document keeps the work proportional to the corpus.
    """
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    c = fp.classes(fp.fingerprints(fp.paragraph_hashes(lines, ["doc_id"]), ["doc_id"]))
    one = written(c.groupBy("cls").agg(F.min("doc_id").alias("ver_id"), F.first("fp").alias("fp")))
    keys = one.select("cls", F.col("ver_id").alias("key"), "ver_id")
    m = fp.best_matches(one, one, keys, 2).filter("doc_cls <> ver_cls")  # the best one may be the document itself
    best = fp.rank_versions(m, one.select("cls", "ver_id"), 1)
    mine = one.select(F.col("cls").alias("doc_cls"), F.col("ver_id").alias("doc_id"))
    p = best.join(mine, "doc_cls").select(F.least("doc_id", "ver_id").alias("doc_a"), F.greatest("doc_id", "ver_id").alias("doc_b"), "score")
    p = p.groupBy("doc_a", "doc_b").agg(F.max("score").alias("score"))
    return p.select(F.xxhash64("doc_a", "doc_b").alias("pair_id"), "doc_a", "doc_b", "score")


def compare_pairs(docs: DataFrame, pairs: DataFrame, o: CompareOptions) -> DataFrame:
    """Edit script of the changes of all pairs of documents."""
    blocks = plain_blocks(docs)
    return cp.compare_merged(align.with_pairs(blocks, pairs, "a"), align.with_pairs(blocks, pairs, "b"), o, edits_only=True)


def revision_changes(docs: DataFrame, o: CompareOptions = CompareOptions(formatting=False)) -> DataFrame:
    """Per pair of revisions: doc_a, doc_b, score and the number of changes of each kind.

    The pairs are read three times and small next to the corpus, so they are checkpointed.
    """
    pairs = checkpoint(revision_pairs(docs))
    stats = ch.change_stats(ch.list_changes(compare_pairs(docs, pairs, o)))
    kinds = ["del", "ins", "mod", "fmt", "move"]
    return pairs.join(stats, "pair_id", "left").select("doc_a", "doc_b", "score", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
