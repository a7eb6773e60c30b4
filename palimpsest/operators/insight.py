"""What the changes mean: clause anchors, context, risks, folding, density and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import numbers as N, text as T
from palimpsest.operators.tokens import block_text
from palimpsest.options import RiskOptions


# ---- clauses ------------------------------------------------------------------------------------------

def row_clauses(rows: DataFrame) -> DataFrame:
    """Adds ``clause`` to rows(pair_id, row, sec, kind_b, text): the last clause title at or before a
    body row; the first heading that names the document is no clause. Other sections have none."""
    body = F.col("sec") == "body"
    full = body & (T.trim_ws(F.col("text")) != "")
    w = Window.partitionBy("pair_id").orderBy("row")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = rows.withColumn("_first", full & (F.sum(full.cast("int")).over(run) == 1))
    title = F.when(body & ~T.is_doc_title(F.col("text"), F.col("blk_kind"), F.col("_first")),
                   T.clause_title(F.col("text"), F.col("blk_kind")))
    t = t.withColumn("_t", title)
    return t.withColumn("clause", F.when(body, F.last("_t", ignorenulls=True).over(run))).drop("_t", "_first")


def with_clauses(rows: DataFrame) -> DataFrame:
    """Compared rows with their ``clause``: the block of side b names it, else that of side a."""
    blk = F.coalesce(F.try_element_at("b", F.lit(1)), F.try_element_at("a", F.lit(1)))
    return row_clauses(rows.withColumn("blk_kind", blk["kind"]).withColumn("text", block_text(blk["cells"]))).drop("blk_kind", "text")


def group_changes(changes: DataFrame, by: list[str], title: Column) -> DataFrame:
    """Adds ``grp``: changes of one title that follow each other form a group."""
    w = Window.partitionBy(*by).orderBy("cid")
    t = changes.withColumn("title", title)
    new = ~F.coalesce(F.lag("title").over(w) == F.col("title"), F.lit(False))
    t = t.withColumn("_n", new.cast("int"))
    return t.withColumn("grp", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


SEC_NAMES = {"header": "Header", "body": "Body", "footnote": "Footnotes", "footer": "Footer"}


def group_title(sec: Column, clause: Column) -> Column:
    named = F.coalesce(*[F.when(sec == k, v) for k, v in SEC_NAMES.items() if k != "body"])
    return F.coalesce(named, clause, F.lit("Opening"))


# ---- risks --------------------------------------------------------------------------------

def risk_candidates(changes: DataFrame) -> DataFrame:
    return changes.filter(~F.col("kind").isin("fmt", "move"))


def detect_risks(changes: DataFrame, o: RiskOptions = RiskOptions()) -> DataFrame:
    """risks(pair_id, cid, risk, kw, rank) of changes that carry clause and context columns.

    The steps are separate columns so that each text is scanned once.
    """
    c = risk_candidates(changes).withColumn("kw", N.keyword_hits(list(o.keywords), F.col("before"), F.col("after"), F.col("clause")))
    mod = F.col("kind") == "mod"
    ask = lambda col: F.when(mod, col)
    c = c.withColumn("_na", ask(N.number_at(F.col("a"), F.col("a_start"), F.col("a_end")))) \
        .withColumn("_nb", ask(N.number_at(F.col("b"), F.col("b_start"), F.col("b_end")))) \
        .withColumn("_da", ask(N.date_at(F.col("a"), F.col("a_start"), F.col("a_end")))) \
        .withColumn("_db", ask(N.date_at(F.col("b"), F.col("b_start"), F.col("b_end"))))
    plain = F.when(F.col("kind") == "ins", F.col("after")).when(F.col("kind") == "del", F.col("before"))
    c = c.withColumn("_amt", N.first_amount(plain) if o.money else F.lit(None))
    risk = N.modified_risk(F.col("_na"), F.col("_nb"), F.col("_da"), F.col("_db"), F.col("clause"), o.money, o.date)
    if o.money:
        risk = F.when(mod, risk).otherwise(N.new_amount_risk(F.col("_amt"), F.col("kind") == "del"))
    kw = N._risk("kw", "kw")
    found = F.filter(F.array(F.coalesce(risk, F.when(F.size("kw") > 0, kw))), lambda r: r.isNotNull())
    # Exploding instead of filtering keeps the optimizer from computing the risk a second time.
    c = c.select("pair_id", "cid", "kw", F.explode(found).alias("risk"))
    rank = F.when(F.col("risk.cat") == "money", 0).when(F.col("risk.cat").isin("date", "term"), 1).otherwise(2)
    return c.select("pair_id", "cid", "risk", "kw", rank.alias("rank"))


def risk_order(risks: DataFrame) -> DataFrame:
    """Adds ``place``: money, then date and term, then keywords, each in change order."""
    w = Window.partitionBy("pair_id").orderBy("rank", "cid")
    return risks.withColumn("place", F.row_number().over(w))


def shown_changes(changes: DataFrame, kind: str | None = None, risks: DataFrame | None = None) -> DataFrame:
    if risks is not None:
        return changes.join(risks.select("pair_id", "cid"), ["pair_id", "cid"], "left_semi")
    return changes.filter(F.col("kind") == kind) if kind else changes


# ---- overviews ----------------------------------------------------------------------------------------

def patterns(changes: DataFrame, by: list[str], top: int | None = None, least: int = 1, least_all: int = 0) -> DataFrame:
    """Repeated changes by frequency: all, or the ``top`` of those made ``least`` times or more in pairs with
    ``least_all`` changes or more."""
    n = F.sum("n").over(Window.partitionBy(*by))
    g = changes.groupBy(*by, "kind", "before", "after").agg(F.count("*").alias("n"), F.min("cid").alias("first"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "first")
    g = g.withColumn("_all", n).filter((F.col("_all") >= least_all) & (F.col("n") >= least)) \
        .withColumn("rank", F.row_number().over(w)).drop("_all")
    return g if top is None else g.filter(F.col("rank") <= top)


KIND_RANK = {"del": 5, "mod": 4, "ins": 3, "move": 2, "fmt": 1}


def density(changes: DataFrame, by: list[str], buckets: int = 120, dense: int = 0) -> DataFrame:
    """Per pair with more than ``dense`` changes: number of changes and leading kind of every bucket of the
    document, with an intensity of three steps. ``changes`` carry row and n_rows."""
    bucket = F.least(F.lit(buckets - 1), F.floor(F.col("row") / F.col("n_rows") * buckets))
    g = changes.withColumn("bucket", bucket).groupBy(*by, "bucket", "kind").agg(F.count("*").alias("k"))
    rank = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KIND_RANK.items()])
    b = g.groupBy(*by, "bucket").agg(F.sum("k").alias("n"), F.max_by("kind", F.struct(F.col("k"), rank.alias("r"))).alias("kind"))
    w = Window.partitionBy(*by)
    share = F.col("n") / F.max("n").over(w)
    return b.withColumn("_all", F.sum("n").over(w)).withColumn(
        "level", F.when(share > 0.66, 3).when(share > 0.33, 2).otherwise(1)).filter(F.col("_all") > dense).drop("_all")


def format_noise(changes: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Pairs in which format changes dominate: n and whether whole paragraphs changed font, size or both.

    ``changes`` carry sig and ``whole`` (the row is a format row with a single change).
    """
    f = F.col("kind") == "fmt"
    has = lambda s: F.count_if(f & F.col("whole") & F.contains("sig", F.lit(s)))
    g = changes.groupBy(*by).agg(F.count("*").alias("all"), F.count_if(f).alias("n"), has("font:").alias("font"), has("sz:").alias("size"))
    big = lambda c: F.col(c) >= F.col("n") * 0.6
    return g.filter((F.col("n") >= least) & (F.col("n") * 2 >= F.col("all"))).select(
        *by, "n", F.when(big("font") & big("size"), "both").when(big("font"), "font").when(big("size"), "size").otherwise("any").alias("kind"))


def fold_rows(rows: DataFrame, context: int, by: list[str]) -> DataFrame:
    """Adds ``keep`` (within ``context`` rows of a changed one) and ``fold`` (number of the hidden run)."""
    w = Window.partitionBy(*by).orderBy("row")
    near = F.max("changed").over(w.rowsBetween(-context, context))
    t = rows.withColumn("keep", near)
    start = ~F.col("keep") & F.coalesce(F.lag("keep").over(w), F.lit(True))
    t = t.withColumn("_s", start.cast("int"))
    return t.withColumn("fold", F.when(~F.col("keep"), F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def section_heads(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """heads(pair_id, sec, first_row, n, closed): sections with their change counts; a section other
    than the body without changes is closed."""
    present = rows.groupBy("pair_id", "sec").agg(F.min("row").alias("first_row"))
    n = changes.groupBy("pair_id", "sec").agg(F.count("*").alias("n"))
    return present.join(n, ["pair_id", "sec"], "left").select(
        "pair_id", "sec", "first_row", F.coalesce("n", F.lit(0)).alias("n"),
        ((F.col("sec") != "body") & F.col("n").isNull()).alias("closed"))


def document_stats(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Non-empty blocks, headings, table rows, list items, words, characters with and without space."""
    txt = block_text(F.col("cells"))
    is_ = lambda k: F.count_if(F.col("kind") == k)
    b = blocks.withColumn("_t", txt)
    return b.groupBy(*by).agg(
        F.count_if(T.trim_ws(F.col("_t")) != "").alias("paragraphs"), is_("h").alias("headings"), is_("tr").alias("table_rows"),
        is_("li").alias("list_items"), F.sum(T.count_words(F.col("_t"))).alias("words"),
        (F.sum(F.length("_t")) + F.count("*") - 1).alias("chars"), F.sum(T.count_chars_no_space(F.col("_t"))).alias("chars_no_space"))


def compare_properties(props: DataFrame, skip: list[str]) -> DataFrame:
    """props(pair_id, a MAP, b MAP) → one row per key of either map: a, b ('—' if missing), differs."""
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    t = props.select("pair_id", "a", "b", F.explode(keys).alias("key"))
    get = lambda m: F.coalesce(F.try_element_at(m, F.col("key")), F.lit("—"))
    t = t.select("pair_id", "key", get(F.col("a")).alias("a"), get(F.col("b")).alias("b"))
    return t.withColumn("differs", (F.col("a") != F.col("b")) & ~F.col("key").isin(skip) if skip else F.col("a") != F.col("b"))


def scope(pairs: DataFrame) -> DataFrame:
    """Statement of what was compared: compared, not_compared, conditions, alignment.

    ``pairs`` carry the flags of both documents and the options: header, footer, footnote (found on a
    side), comments, images, tracked, one_page_pdf, pdf_footnotes_unread, page_numbers_dropped,
    unread_runs, formatting, char_mode, ignore_ws, ignore_case, norm_punct, norm_quotes, detect_moves,
    pair_fallback, merge_off.
    """
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    when = lambda c, t: F.when(F.col(c), F.lit(t))
    pick = lambda c, yes, no: F.when(F.col(c), F.lit(yes)).otherwise(F.lit(no))
    return pairs.select(
        "pair_id",
        some(F.lit("body"), F.lit("tables"), F.lit("lists"), when("header", "headers"), when("footer", "footers"),
             when("footnote", "footnotes")).alias("compared"),
        some(F.when(F.col("comments") > 0, F.concat(F.lit("comments ("), F.col("comments").cast("string"), F.lit(")"))),
             when("images", "image content"), when("tracked", "tracked changes of the source"),
             when("one_page_pdf", "headers and footers of a one-page PDF"), when("pdf_footnotes_unread", "footnotes on the PDF side"),
             when("page_numbers_dropped", "page numbers"),
             F.when(F.col("unread_runs") > 0, F.concat(F.col("unread_runs").cast("string"), F.lit(" unreadable text runs"))),
             F.when(~F.col("formatting"), F.lit("formatting"))).alias("not_compared"),
        F.array(pick("char_mode", "by character", "by word"), pick("ignore_ws", "white space ignored", "white space counts"),
                pick("ignore_case", "case ignored", "case counts"), pick("norm_punct", "wide punctuation equal", "wide punctuation differs"),
                pick("norm_quotes", "quotes equal", "quotes differ"), pick("detect_moves", "moves detected", "moves not detected"),
                pick("formatting", "formatting detected", "formatting not detected")).alias("conditions"),
        F.when(F.col("pair_fallback"), "simplified: by position").when(F.col("merge_off"), "simplified: no split or merge")
        .otherwise("exact").alias("alignment"))
