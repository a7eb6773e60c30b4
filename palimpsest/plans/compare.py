"""The whole comparison of all pairs as one chain of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import align, changes as ch, insight
from palimpsest.operators.tokens import prepare
from palimpsest.options import CompareOptions, RiskOptions


def compare_stretches(blocks_a: DataFrame, blocks_b: DataFrame, o: CompareOptions) -> DataFrame:
    return align.split_stretches(align.sections(prepare(blocks_a, o), prepare(blocks_b, o)))


def compare_rows(blocks_a: DataFrame, blocks_b: DataFrame, o: CompareOptions = CompareOptions(),
                 equal_rows: bool = True) -> DataFrame:
    """rows(pair_id, row, sec, kind, a, b, move_row, move_to, merged, block_desc) of all pairs.

    One shuffle in all, by pair_id. Without ``equal_rows`` the scripts of unchanged rows are left empty,
    which is all that changes and risks need. Write the table when both rows and changes are wanted.
    """
    rows = align.pair_rows(compare_stretches(blocks_a, blocks_b, o), o)
    if o.detect_moves:
        rows = align.find_moves(rows)
    else:
        null = F.lit(None).cast("int")
        rows = rows.withColumn("move_row", null).withColumn("move_to", null)
    return ch.settle_rows(ch.block_notes(ch.merge_tokens(rows, o, equal_rows), o))


def compare_merged(blocks_a: DataFrame, blocks_b: DataFrame, o: CompareOptions = CompareOptions(),
                   all_rows: bool = False, edits_only: bool = False) -> DataFrame:
    return ch.flat_merged(compare_rows(blocks_a, blocks_b, o, equal_rows=all_rows), all_rows, edits_only, o.formatting)


def compare_changes(blocks_a: DataFrame, blocks_b: DataFrame,
                    o: CompareOptions = CompareOptions()) -> DataFrame:
    """changes(pair_id, cid, sec, kind, row, row2, at, before, after, desc) of all pairs."""
    return ch.list_changes(compare_merged(blocks_a, blocks_b, o, edits_only=True))


def compare_in_context(blocks_a: DataFrame, blocks_b: DataFrame, o: CompareOptions = CompareOptions()) -> DataFrame:
    """All changes with their clause and the text around them."""
    rows = insight.with_clauses(ch.context_entries(compare_rows(blocks_a, blocks_b, o, equal_rows=False)))
    return ch.changes_in_context(ch.flat_merged(rows, formats=o.formatting))


def compare_risks(blocks_a: DataFrame, blocks_b: DataFrame, o: CompareOptions = CompareOptions(),
                  r: RiskOptions = RiskOptions()) -> DataFrame:
    """risks(pair_id, cid, risk, kw, rank) of all pairs."""
    return insight.detect_risks(compare_in_context(blocks_a, blocks_b, o), r)
