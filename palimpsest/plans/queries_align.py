"""Queries: sources of text, tokens, alignment, segments and change numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import align, changes as ch, tokens as tk
from palimpsest.options import CompareOptions
from palimpsest.plans import compare as cp
from palimpsest.plans.catalog import Tables, dealt, query
from palimpsest.plans.inputs import (CTE, words_sql, WS_SQL, blocks, cte, lines, lines_b, q, script, with_)

O = CompareOptions(formatting=False)


def quotes_sql(x: str) -> str:
    return f"translate({x}, '‘’‚‛′“”„‟″', '" + "''" * 5 + '"' * 5 + "')"


def _ab(t: Tables) -> tuple[DataFrame, DataFrame]:
    return blocks(lines(t)), blocks(lines_b(t))


@query("src3_line_blocks", with_("lines", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM lines"))
def _(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "pos", "line")


@query("src4_document_text", """SELECT doc_id, replace(text, ' | ', chr(9)) AS plain FROM documents""")
def _(t: Tables) -> DataFrame:
    b = blocks(lines(t)).withColumn("x", tk.block_text(F.col("cells")))
    return b.groupBy(F.col("pair_id").alias("doc_id")).agg(F.array_join(F.array_sort(
        F.collect_list(F.struct("pos", "x"))).getField("x"), "\n").alias("plain"))


@query("str1_word_tokens", with_("lines", f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos,
    array_to_string({words_sql('line')}, chr(1)) AS toks, CAST(len({words_sql('line')}) AS INTEGER) AS n FROM lines"""))
def _(t: Tables) -> DataFrame:
    w = T.word_tokens(F.col("line"))
    return lines(t).select("doc_id", "pos", F.array_join(w, "\x01").alias("toks"), F.size(w).alias("n"))


@query("str2_char_tokens", with_("lines", f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos,
    array_to_string(regexp_extract_all(line, {q(T.CHAR_RE)}), chr(1)) AS toks FROM lines"""))
def _(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "pos", F.array_join(T.char_tokens(F.col("line")), "\x01").alias("toks"))


@query("str3_token_keys", f"""WITH w AS (SELECT item_id, unnest(w) AS tok, unnest(range(len(w))) AS ix FROM (
    SELECT item_id, {words_sql("replace(replace(text, '.', '。'), ',', '，') || ' “q” …'")} AS w FROM benchmark))
  SELECT item_id, CAST(ix AS INTEGER) AS ix, CASE WHEN regexp_matches(tok, {q('^' + WS_SQL + '+$')}) THEN ' '
    WHEN tok = '…' THEN '...' ELSE lower(translate(tok, '。，“”’‘', '.,""''''')) END AS key FROM w""")
def _(t: Tables) -> DataFrame:
    o = CompareOptions(ignore_case=True, norm_punct=True)
    s = F.concat(F.translate("text", ".,", "。，"), F.lit(" “q” …"))
    return t.benchmark.select("item_id", F.posexplode(T.word_tokens(s)).alias("ix", "tok")) \
        .select("item_id", "ix", T.norm_key(F.col("tok"), o).alias("key"))


CELLS_SQL = f"""SELECT doc_id, pos, list_reduce(list_transform(string_split(line, ' | '), lambda c: {words_sql('c')}),
    lambda x, y: list_concat(list_append(x, chr(1) || 'cell'), y)) AS w FROM lines WHERE contains(line, ' | ')"""


@query("str4_special_token_keys", with_("lines", f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos,
    array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, {q('^' + WS_SQL + '+$')}) THEN ' '
      ELSE {quotes_sql('x')} END), '~') AS keys FROM ({CELLS_SQL})"""))
def _(t: Tables) -> DataFrame:
    b = blocks(lines(t)).filter("kind = 'tr'")
    return b.select(F.col("pair_id").alias("doc_id"), "pos", F.array_join(tk.token_keys(F.col("cells"), O), "~").alias("keys"))


@query("prj1_nonempty_blocks", with_("lines", f"""SELECT doc_id, count(*) AS n FROM lines
    WHERE regexp_matches(replace(line, ' | ', ''), {q('[^' + T.WS + ']')}) GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    return blocks(lines(t)).filter(tk.has_content(F.col("cells"))).groupBy(F.col("pair_id").alias("doc_id")).agg(F.count("*").alias("n"))


BKEY_SQL = f"""CASE WHEN contains(line, ' | ') THEN 'T|' ELSE '' END || regexp_replace(
    {quotes_sql("replace(line, ' | ', chr(1) || 'cell')")}, {q(WS_SQL + '+')}, '', 'g')"""


@query("prj2_block_keys", with_("lines", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5({BKEY_SQL}) AS k FROM lines"))
def _(t: Tables) -> DataFrame:
    return blocks(lines(t)).select(F.col("pair_id").alias("doc_id"), "pos",
                                   F.md5(tk.block_key(F.col("cells"), F.col("kind"), O)).alias("k"))


# ---- alignment ------------------------------------------------------------------------------------

@query("jn1_matched_blocks")
def _(t: Tables) -> DataFrame:
    return align.matched_blocks(cp.compare_stretches(*_ab(t), O))


@query("jn2_gaps")
def _(t: Tables) -> DataFrame:
    return align.gap_sizes(cp.compare_stretches(*_ab(t), O))


@query("jn3_paired_rows")
def _(t: Tables) -> DataFrame:
    one_to_one = CompareOptions(formatting=False, merge_paras=False)
    return align.row_lists(align.pair_rows(cp.compare_stretches(*_ab(t), one_to_one), one_to_one))


@query("jn6_split_merge_rows")
def _(t: Tables) -> DataFrame:
    """Every second line of b is cut in two: rows of one block against several."""
    half = F.expr("locate('. ', line)")
    cut = F.when((F.col("pos") % 2 == 1) & (half > 0), F.array(
        F.expr("left(line, locate('. ', line))"), F.expr("substr(line, locate('. ', line) + 2)"))).otherwise(F.array("line"))
    w = Window.partitionBy("doc_id").orderBy("pos", "k")
    b = lines(t).select("doc_id", "pos", F.posexplode(cut).alias("k", "line")) \
        .select("doc_id", (F.row_number().over(w) - 1).alias("pos"), "line")
    rows = align.pair_rows(cp.compare_stretches(blocks(lines(t)), blocks(b), O), O)
    return align.row_lists(rows).filter((F.size("a_list") > 1) | (F.size("b_list") > 1))


def _word_rows(src: str) -> str:
    return f"""SELECT doc_id, pos, CASE WHEN regexp_matches(k, {q('^' + WS_SQL + '+$')}) THEN NULL ELSE k END AS key FROM (
    SELECT doc_id, pos, unnest(translate_keys) AS k FROM (SELECT doc_id, pos,
      list_transform({words_sql('line')}, lambda x: {quotes_sql('x')}) AS translate_keys FROM {src}))"""


cte("words_a", _word_rows("lines"), "lines")
cte("words_b", _word_rows("(SELECT doc_id, src AS pos, line FROM lines_b WHERE src IS NOT NULL)"), "lines_b")
cte("word_overlap", """SELECT doc_id, pos, coalesce(sum(least(x, y)), 0) AS common, coalesce(sum(x), 0) AS na, coalesce(sum(y), 0) AS nb FROM (
    SELECT doc_id, pos, key, sum(x) AS x, sum(y) AS y FROM (
      SELECT doc_id, pos, key, 1 AS x, 0 AS y FROM words_a WHERE key IS NOT NULL
      UNION ALL SELECT doc_id, pos, key, 0, 1 FROM words_b WHERE key IS NOT NULL) GROUP BY ALL) GROUP BY ALL""", "words_a", "words_b")


def _word_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    cut = lambda ln: ln.select("doc_id", "pos", F.explode(T.word_tokens(F.col("line"))).alias("w")) \
        .filter(~T.is_ws(F.col("w"))).select("doc_id", "pos", T.fold_quotes(F.col("w")).alias("key"))
    t = dealt(t)
    return cut(lines(t)), cut(lines_b(t).filter("src is not null").select("doc_id", F.col("src").alias("pos"), "line"))


@query("ag2_dice", with_("word_overlap", """SELECT doc_id, CAST(pos AS INTEGER) AS pos,
    round(CASE WHEN na + nb = 0 THEN 1.0 ELSE 2.0 * common / (na + nb) END, 6) AS dice FROM word_overlap"""))
def _(t: Tables) -> DataFrame:
    d = align.dice(*_word_tables(t), by=["doc_id", "pos"])
    return d.select("doc_id", "pos", F.round("dice", 6).alias("dice"))


@query("ag3_containment", with_("word_overlap", """SELECT doc_id, CAST(pos AS INTEGER) AS pos,
    round(CASE WHEN na = 0 THEN 0.0 ELSE common * 1.0 / na END, 6) AS containment FROM word_overlap"""))
def _(t: Tables) -> DataFrame:
    d = align.containment(*_word_tables(t), by=["doc_id", "pos"])
    return d.select("doc_id", "pos", F.round("containment", 6).alias("containment"))


@query("jn4_single_pairs")
def _(t: Tables) -> DataFrame:
    st = cp.compare_stretches(*_ab(t), O)
    one = ~F.col("eq") & (F.size("a") == 1) & (F.size("b") == 1)
    return align.row_lists(align.pair_rows(st.filter(one), O))


@query("jn5_positional_gaps")
def _(t: Tables) -> DataFrame:
    """The lines of fifty documents at a time against the same lines with their words turned round,
    in the mode that pairs large gaps by position."""
    src = lines(t).withColumn("vol", F.expr("doc_id div 50"))
    w = Window.partitionBy("vol").orderBy("doc_id", "pos")
    a = src.select(F.col("vol").alias("doc_id"), (F.row_number().over(w) - 1).alias("pos"), "line")
    b = tk.once(a.withColumnRenamed("line", "_line"), line=F.array_join(F.reverse(F.split("_line", F.lit(" "))), " ")).drop("_line")
    o = CompareOptions(formatting=False, by_position=True)
    rows = align.pair_rows(cp.compare_stretches(blocks(a), blocks(b), o), o)
    return rows.groupBy("pair_id", "kind").agg(F.count("*").alias("n"))


@query("jn7_removed_before_added")
def _(t: Tables) -> DataFrame:
    rows = align.row_lists(align.pair_rows(cp.compare_stretches(*_ab(t), O), O))
    return rows.filter(F.col("kind").isin("removed", "added")).select("pair_id", "row", "kind")


@query("jn8_token_scripts")
def _(t: Tables) -> DataFrame:
    rows = cp.compare_rows(*_ab(t), O, equal_rows=False).filter("kind = 'modified'")
    return rows.select("pair_id", "row", F.posexplode("merged").alias("ix", "m")).select(
        "pair_id", "row", "ix", "m.op", F.col("m.a.t").alias("a_text"), F.col("m.b.t").alias("b_text"), "m.ws_only")


@query("jn9_equal_rows", with_("lines", f"""SELECT doc_id AS pair_id, CAST(pos AS INTEGER) AS pos, 0 AS edits,
    CAST(len({words_sql('line')}) AS INTEGER) AS n FROM lines WHERE regexp_matches(line, {q('[^' + T.WS + ']')})"""))
def _(t: Tables) -> DataFrame:
    """Side b has every blank doubled: all rows are equal and nothing in them differs."""
    a = lines(t)
    b = tk.once(a.withColumnRenamed("line", "_line"), line=F.replace("_line", F.lit(" "), F.lit("  "))).drop("_line")
    rows = cp.compare_rows(blocks(a), blocks(b), O)
    return rows.select("pair_id", F.col("a")[0]["pos"].alias("pos"),
                       F.size(F.filter("merged", lambda m: (m["op"] != 0) & ~m["ws_only"])).alias("edits"),
                       F.size("merged").alias("n"))


cte("move_keys", f"""SELECT doc_id, pos, line, {BKEY_SQL} AS k FROM lines""", "lines")


@query("jn10_moves", with_("lines", f"""SELECT a.doc_id AS pair_id, 'move' AS kind, count(*) AS n FROM (
      SELECT doc_id FROM (SELECT doc_id, pos, {BKEY_SQL} AS k FROM lines) WHERE pos = 0 AND length(k) >= 6) a
    GROUP BY a.doc_id"""))
def _(t: Tables) -> DataFrame:
    """The first line of every document goes to the end; the other lines are made unique and two more are
    added, so that the one move is the whole difference."""
    more = lines(t).groupBy("doc_id").agg(F.max("pos").alias("end")).select(
        "doc_id", F.explode(F.array(F.col("end") + 1, F.col("end") + 2)).alias("pos")).withColumn("line", F.lit("end of the text"))
    all_lines = lines(t).select("doc_id", "pos", "line").unionByName(more)
    n = F.count("*").over(Window.partitionBy("doc_id"))
    tag = F.concat(F.lit("L"), F.col("pos").cast("string"), F.lit(" "), "line")
    a = all_lines.withColumn("n", n).withColumn("line", F.when(F.col("pos") > 0, tag).otherwise(F.col("line")))
    b = a.withColumn("pos", F.when(F.col("pos") == 0, F.col("n")).otherwise(F.col("pos")))
    rows = align.find_moves(align.pair_rows(cp.compare_stretches(blocks(a), blocks(b), O), O))
    return rows.filter("kind = 'moved-from'").groupBy("pair_id", F.lit("move").alias("kind")).agg(F.count("*").alias("n"))


@query("jn11_sections")
def _(t: Tables) -> DataFrame:
    """Lines spread over the four sections; numbering runs through them in their fixed order."""
    sec = F.element_at(F.array(*[F.lit(s) for s in ("header", "body", "footnote", "footer")]), (F.col("pos") % 4 + 1).cast("int"))
    put = lambda b: b.withColumn("sec", sec)
    rows = align.pair_rows(cp.compare_stretches(put(blocks(lines(t))), put(blocks(lines_b(t))), O), O)
    return align.row_lists(rows).select("pair_id", "row", "sec", "kind")


@query("set1_section_union", with_("lines", """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, pos) - 1 AS INTEGER) AS ord,
    sec, line FROM (SELECT doc_id, pos, line, (pos % 4) AS o, ['header','body','footnote','footer'][(pos % 4) + 1] AS sec FROM lines)"""))
def _(t: Tables) -> DataFrame:
    return compare_order({s: lines(t).filter(F.col("pos") % 4 == i) for i, s in enumerate(("header", "body", "footnote", "footer"))})


def compare_order(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of the sections of every document in the fixed order header, body, footnote, footer."""
    from palimpsest.schema import sec_ord
    out = None
    for sec, df in parts.items():
        df = df.withColumn("sec", F.lit(sec))
        out = df if out is None else out.unionByName(df)
    w = Window.partitionBy("doc_id").orderBy(sec_ord(F.col("sec")), "pos")
    return out.select("doc_id", (F.row_number().over(w) - 1).alias("ord"), "sec", "line")


@query("src5_compare_order", with_("lines", """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, pos) - 1 AS INTEGER) AS ord,
    sec, md5(line) AS m FROM (SELECT doc_id, pos, line, CASE WHEN pos = 0 THEN 0 ELSE 1 END AS o,
      CASE WHEN pos = 0 THEN 'header' ELSE 'body' END AS sec FROM lines)"""))
def _(t: Tables) -> DataFrame:
    ln = lines(t)
    return compare_order({"body": ln.filter("pos > 0"), "header": ln.filter("pos = 0")}).select(
        "doc_id", "ord", "sec", F.md5("line").alias("m"))


@query("ag4_degraded")
def _(t: Tables) -> DataFrame:
    o = CompareOptions(formatting=False, by_position=True)
    return align.degraded(align.gap_sizes(cp.compare_stretches(*_ab(t), o)), o)


@query("ag1_change_counts")
def _(t: Tables) -> DataFrame:
    return ch.change_stats(cp.compare_changes(*_ab(t), O))


@query("wn4_numbered_changes")
def _(t: Tables) -> DataFrame:
    c = cp.compare_changes(*_ab(t), O)
    return c.select("pair_id", "cid", "sec", "kind", "row", "row2", "before", "after")


@query("wn5_settled_rows")
def _(t: Tables) -> DataFrame:
    return align.row_lists(cp.compare_rows(*_ab(t), O, equal_rows=False)).select("pair_id", "row", "kind", "move_row")


@query("wn7_cleaned_scripts")
def _(t: Tables) -> DataFrame:
    """Character mode makes short equal islands frequent; what is left of them is counted per row."""
    o = CompareOptions(formatting=False, precision="char")
    rows = cp.compare_rows(*_ab(t), o, equal_rows=False).filter("kind = 'modified'")
    return rows.select("pair_id", "row", F.size("merged").alias("n"),
                       F.size(F.filter("merged", lambda m: m["op"] == 0)).alias("n_equal"))


# ---- segments of a known script -------------------------------------------------------------------

SEG_SQL = """seg AS (SELECT *, max(CASE WHEN m AND NOT coalesce(pm, false) THEN ix END) OVER w AS s FROM (
    SELECT *, lag(m) OVER (PARTITION BY pair_id, "row" ORDER BY ix) AS pm FROM (
      SELECT *, d OR (op = 0 AND ws AND coalesce(lag(d) OVER x, false) AND coalesce(lead(d) OVER x, false)) AS m
      FROM (SELECT *, op <> 0 AS d FROM script) WINDOW x AS (PARTITION BY pair_id, "row" ORDER BY ix)))
    WINDOW w AS (PARTITION BY pair_id, "row" ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("wn2_edit_segments", with_("script", "").rstrip() + ",\n" + SEG_SQL + """
  SELECT pair_id, CAST("row" AS INTEGER) AS "row", CAST(s AS INTEGER) AS seg,
    CASE WHEN bool_or(op = -1) AND bool_or(op = 1) THEN 'mod' WHEN bool_or(op = -1) THEN 'del' ELSE 'ins' END AS kind,
    coalesce(string_agg(at_, '' ORDER BY ix), '') AS before, coalesce(string_agg(bt_, '' ORDER BY ix), '') AS after
  FROM seg WHERE m GROUP BY pair_id, "row", s""")
def _(t: Tables) -> DataFrame:
    s = ch.edit_segments(script(dealt(t))).filter("seg is not null")
    d, i = F.bool_or(F.col("op") == -1), F.bool_or(F.col("op") == 1)
    return s.groupBy("pair_id", "row", "seg").agg(
        F.when(d & i, "mod").when(d, "del").otherwise("ins").alias("kind"),
        ch.side_text("a").alias("before"), ch.side_text("b").alias("after"))


FSEG_SQL = """fseg AS (SELECT *, max(CASE WHEN sig IS NOT NULL AND sig IS DISTINCT FROM psig THEN ix END) OVER (
      PARTITION BY pair_id, "row" ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (
    SELECT *, lag(sig) OVER (PARTITION BY pair_id, "row" ORDER BY ix) AS psig FROM (
      SELECT *, CASE WHEN fmt IS NULL AND op = 0 AND ws AND lag(fmt) OVER x = lead(fmt) OVER x THEN lag(fmt) OVER x ELSE fmt END AS sig
      FROM script WINDOW x AS (PARTITION BY pair_id, "row" ORDER BY ix))))"""


@query("wn3_format_segments", with_("script", "").rstrip() + ",\n" + FSEG_SQL + """
  SELECT pair_id, CAST("row" AS INTEGER) AS "row", CAST(s AS INTEGER) AS fseg, max(sig) AS sig, string_agg(bt_, '' ORDER BY ix) AS txt
  FROM fseg WHERE sig IS NOT NULL GROUP BY pair_id, "row", s""")
def _(t: Tables) -> DataFrame:
    s = ch.format_segments(script(t)).filter("fseg is not null")
    return s.groupBy("pair_id", "row", "fseg").agg(F.max("fmt").alias("sig"), ch.side_text("b").alias("txt"))
