"""Document structure: numbering, styles, runs, running parts, footnotes and accepted revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import checkpoint, until_settled


def number_paragraphs(paras: DataFrame, lists: DataFrame, levels: int = 9) -> DataFrame:
    """Adds ``value`` and ``marker`` to paras(doc_id, pos, num_id, lvl).

    lists(num_id, abs_id, defs MAP<INT, STRUCT<fmt, text, start>>, overrides MAP<INT, INT>): lists that
    share abs_id count on; an override restarts its level once, on the first use by its num_id; deeper
    levels restart after a shallower item. Bullets are not counted.
    """
    # Definitions repeat in every row, so only what is counted by goes through the windows; the rest is looked up after.
    lists = lists.withColumn("_list", F.md5(F.to_json(F.struct("abs_id", "defs", "overrides"))))
    d = F.try_element_at("defs", F.col("lvl"))
    t = paras.join(lists, "num_id").select(
        *[paras[c] if c == "num_id" else c for c in paras.columns], "abs_id", "_list", d["fmt"].alias("_fmt"), d["start"].alias("_start"),
        F.try_element_at("overrides", F.col("lvl")).alias("_again")).filter(F.col("_fmt").isNotNull())
    counted = F.col("_fmt") != "bullet"
    by = ["doc_id", "abs_id"]
    run = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    groups = [F.count(F.when(counted & (F.col("lvl") < k), 1)).over(run).alias(f"_g{k}") for k in range(levels)]
    t = t.select("*", *groups)
    own = F.element_at(F.array(*[F.col(f"_g{k}") for k in range(levels)]), F.col("lvl") + 1)
    t = t.withColumn("_own", own)
    use = Window.partitionBy("doc_id", "num_id", "lvl").orderBy("pos")
    over = F.when(F.row_number().over(use) == 1, F.col("_again"))
    t = t.withColumn("_over", F.when(counted, over))
    level = Window.partitionBy(*by, "lvl", "_own", counted).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_isle", F.count("_over").over(level))
    isle = Window.partitionBy(*by, "lvl", "_own", "_isle", counted).orderBy("pos")
    first = F.first(F.coalesce("_over", "_start")).over(isle.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("value", F.when(counted, first + F.row_number().over(isle) - 1))
    shown = [F.last(F.when(F.col("lvl") == k, F.col("value")), ignorenulls=True).over(
        Window.partitionBy(*by, f"_g{k}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias(f"_v{k}") for k in range(levels)]
    one = lists.groupBy("num_id", "_list").agg(F.first("defs").alias("defs"))
    t = t.select("*", *shown).join(one, ["num_id", "_list"])
    marker = d["text"]
    for k in range(levels):
        dk = F.try_element_at("defs", F.lit(k))
        v = F.coalesce(F.when(F.col("lvl") >= k, F.col(f"_v{k}")), dk["start"], F.lit(1))
        marker = F.regexp_replace(marker, F.lit(f"%{k + 1}"), T.list_number(v, F.coalesce(dk["fmt"], F.lit("decimal"))))
    bullet = F.when(F.col("lvl") % 2 == 1, "◦").otherwise("•")
    marker = F.when(~counted, bullet).when(F.col("_fmt") == "none", "").otherwise(marker)
    return t.select(*paras.columns, "value", marker.alias("marker"))


# ---- styles -------------------------------------------------------------------------------------------

def heading_of(name: Column, outline: Column) -> Column:
    n = F.lower(name)
    k = F.coalesce(F.nullif(F.regexp_extract(n, r"^heading\s*(\d)", 1), F.lit("")), F.nullif(F.regexp_extract(n, r"^标题\s*(\d)", 1), F.lit("")))
    return (F.when(k.isNotNull(), F.least(F.lit(6), k.try_cast("int"))).when(n.isin("title", "标题"), 1).when(n == "subtitle", 2)
            .when(outline < 9, F.least(F.lit(6), outline + 1)))


def inherit_styles(styles: DataFrame, props: list[str], cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """styles(style, based_on, props…) with every property taken from the nearest style of its chain; spans
    of 1, 2, 4 … styles are combined by keyed joins until every chain has ended. In a circle a style takes
    what the other styles of the circle have."""
    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        nxt = second.select(F.col("style").alias("up"), F.col("up").alias("_up"), *[F.col(p).alias(f"_{p}") for p in props])
        return first.join(nxt, "up", "left").select(
            "style", F.col("_up").alias("up"), *[F.coalesce(p, f"_{p}").alias(p) for p in props])

    known = styles.select(F.col("style").alias("based_on"), F.lit(1).alias("_k"))
    one = styles.join(known, "based_on", "left").select("style", F.when(F.col("_k") == 1, F.col("based_on")).alias("up"), *props)
    return until_settled(one, lambda now: then(now, now), lambda now: now.filter("up is not null"), cut).drop("up")


# ---- runs ---------------------------------------------------------------------------------------------

def merge_runs(runs: DataFrame, style: list[str], by: list[str]) -> DataFrame:
    """Adjacent runs of one style become one; empty runs go. runs: by…, run, t, style…"""
    full = runs.filter(F.coalesce("t", F.lit("")) != "")
    w = Window.partitionBy(*by).orderBy("run")
    same = F.lit(True)
    for c in style:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    t = full.withColumn("_n", F.when(F.lag("run").over(w).isNotNull() & same, 0).otherwise(1))
    t = t.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    txt = F.array_join(F.array_sort(F.collect_list(F.struct("run", "t"))).getField("t"), "")
    return t.groupBy(*by, "_g", *style).agg(F.min("run").alias("run"), txt.alias("t")).drop("_g")


def trim_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """Blank runs at both ends go, the outer ends of the first and last run are trimmed."""
    w = Window.partitionBy(*by)
    full = F.when(T.trim_ws(F.col("t")) != "", F.col("run"))
    t = runs.withColumn("_a", F.min(full).over(w)).withColumn("_b", F.max(full).over(w)).filter("run between _a and _b")
    txt = F.col("t")
    txt = F.when(F.col("run") == F.col("_a"), F.regexp_replace(txt, rf"^[{T.WS}]+", "")).otherwise(txt)
    txt = F.when(F.col("run") == F.col("_b"), F.regexp_replace(txt, rf"[{T.WS}]+$", "")).otherwise(txt)
    return t.withColumn("t", txt).drop("_a", "_b")


# ---- parts and revisions ------------------------------------------------------------------------------

def dedupe_parts(blocks: DataFrame) -> DataFrame:
    """Blocks of running parts (doc_id, part, ord, kind, text): first of a kind and text, no page numbers."""
    t = blocks.withColumn("text", T.trim_ws(F.col("text")))
    t = t.filter(~((F.col("kind") != "tr") & T.is_page_number(F.col("text"))) & ~((F.col("kind") == "tr") & (F.col("text") == "")))
    w = Window.partitionBy("doc_id", "part", "kind", "text").orderBy("ord")
    return t.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def order_footnotes(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """notes(doc_id, id, text) numbered by first reference, unreferenced ones last; blank notes go.
    Adds ``n`` and ``shown`` ("[n] text")."""
    first = refs.groupBy("doc_id", "id").agg(F.min("pos").alias("at"))
    t = notes.filter(T.trim_ws(F.col("text")) != "").join(first, ["doc_id", "id"], "left")
    w = Window.partitionBy("doc_id").orderBy(F.col("at").asc_nulls_last(), "id")
    return t.withColumn("n", F.row_number().over(w)).withColumn(
        "shown", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.regexp_replace("text", rf"^[{T.WS}]+", ""))).drop("at")


def accept_marks(paras: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, pos, kind, text, mark_deleted, ends_section, has_content) with the deleted
    paragraph marks accepted: an empty one goes, one with content runs into the next paragraph, and one
    before a table or section end stays. Keeps the position of the paragraph that ends the run."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    para = F.col("kind") != "tr"
    act = F.when(para & F.col("mark_deleted") & ~F.col("ends_section") & F.coalesce(F.lead("kind").over(w) != "tr", F.lit(False)),
                 F.when(F.col("has_content"), "merge").otherwise("drop"))
    t = paras.withColumn("_act", act)
    ends = F.col("_act").isNull().cast("int")
    t = t.withColumn("_e", ends)
    t = t.withColumn("_g", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_e"))
    txt = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text"))).getField("text"), "")
    return t.groupBy("doc_id", "_g").agg(
        F.max("pos").alias("pos"), F.max_by("kind", "pos").alias("kind"), txt.alias("text")).drop("_g")


def count_revisions(marks: DataFrame) -> DataFrame:
    """Per document the number of earlier tracked revisions that hold content."""
    return marks.groupBy("doc_id").agg(F.count_if("has_content").alias("revisions"))
