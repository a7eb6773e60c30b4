"""Blocks and tokens: block keys, the empty-block filter and token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.options import CompareOptions
from palimpsest.schema import CELLS, STYLE, TOKEN, run


def plain_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain mode: every line of a text is one unstyled block; empty lines stay."""
    return (docs.select(F.col(doc_id), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
            .select(doc_id, F.lit("body").alias("sec"), "pos", F.lit("p").alias("kind"),
                    F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("align"),
                    F.array(F.array(run(F.col("line")))).cast(CELLS).alias("cells")))


def block_text(cells: Column) -> Column:
    """Cell texts joined by a tab."""
    return F.array_join(F.transform(
        cells, lambda rs: F.array_join(F.transform(rs, lambda r: F.coalesce(r["t"], F.lit(""))), "")), "\t")


def kind_id(kind: Column, level: Column) -> Column:
    return F.when(kind == "h", F.concat(F.lit("h"), F.coalesce(level, F.lit(1)).cast("string"))) \
        .otherwise(kind)


def _tok(t: Column, key: Column, ws: Column, sep: bool, psep: bool, cell: Column, st: Column) -> Column:
    return F.struct(
        t.alias("t"), F.xxhash64(key).alias("key"), ws.alias("ws"), F.lit(sep).alias("sep"),
        F.lit(psep).alias("psep"), cell.cast("int").alias("c"), F.lit(0).alias("blk"), st.cast(STYLE).alias("st"))


def _style(r: Column) -> Column:
    return F.struct(*[r[f].alias(f) for f in ("b", "i", "u", "s", "sz", "color", "hl", "font")])


def _parts(t: Column, o: CompareOptions) -> Column:
    return (T.char_tokens if o.precision == "char" else T.word_tokens)(F.coalesce(t, F.lit("")))


def compared_cells(cells: Column, kind: Column) -> Column:
    """A block that is no table row has one cell."""
    return F.when(kind == "tr", cells).otherwise(F.slice(cells, 1, 1))


def cell_tokens(cells: Column, o: CompareOptions) -> Column:
    """ARRAY of tokens over all cells; a marker token stands between two cells. Keys are 64-bit; styles
    are carried only when formatting is compared."""
    none = F.lit(None).cast(STYLE)

    def of_run(r: Column, ci: Column) -> Column:
        st = _style(r) if o.formatting else none
        img = F.array(_tok(F.coalesce(r["t"], F.lit("")), F.concat(F.lit(T.IMG_KEY), r["img"]), F.lit(False), False, False, ci, st))
        def word(key) -> Column:
            return F.transform(_parts(r["t"], o), lambda t: F.when(
                T.is_ws_token(t), _tok(t, T.blank_key(t, o), F.lit(True), False, False, ci, st)).otherwise(
                _tok(t, key(t), F.lit(False), False, False, ci, st)))

        # A text without anything to fold has its tokens as keys; that is asked once and not of every token.
        words = F.when(T.is_folded(r["t"], o), word(lambda t: t)).otherwise(word(lambda t: T.word_key(t, o)))
        return F.when(r["img"].isNotNull(), img).otherwise(words)

    def of_cell(rs: Column, ci: Column) -> Column:
        cut_mark = F.array(_tok(F.lit(""), F.lit(T.CELL_KEY), F.lit(False), True, False, ci, none))
        body = F.flatten(F.transform(rs, lambda r: of_run(r, ci)))
        return F.when(ci > 0, F.concat(cut_mark, body)).otherwise(body)

    # Every lambda copies what it returns: the usual block of one run goes through one only.
    one = F.get(F.get(cells, F.lit(0)), F.lit(0))
    plain = (F.size(cells) == 1) & (F.size(F.get(cells, F.lit(0))) == 1)
    return F.when(plain, of_run(one, F.lit(0))).otherwise(F.flatten(F.transform(cells, of_cell)))


def token_keys(cells: Column, o: CompareOptions) -> Column:
    """The key texts of the tokens of ``cell_tokens``."""
    def of_run(r: Column) -> Column:
        return F.when(r["img"].isNotNull(), F.array(F.concat(F.lit(T.IMG_KEY), r["img"]))).otherwise(
            F.transform(_parts(r["t"], o), lambda t: T.norm_key(t, o)))

    def of_cell(rs: Column, ci: Column) -> Column:
        body = F.flatten(F.transform(rs, of_run))
        return F.when(ci > 0, F.concat(F.array(F.lit(T.CELL_KEY)), body)).otherwise(body)

    return F.flatten(F.transform(cells, of_cell))


def block_key(cells: Column, kind: Column, o: CompareOptions) -> Column:
    """The form under which whole blocks are compared: the token keys in a row, white space left out if
    it is ignored. Only folding of punctuation looks at single tokens; otherwise no token is built."""
    if o.norm_punct or not o.ignore_ws:
        keys = token_keys(cells, o)
        if o.ignore_ws:
            keys = F.filter(keys, lambda k: k != " ")
        body = F.array_join(keys, "")
    else:
        def of_run(r: Column) -> Column:
            return F.when(r["img"].isNotNull(), F.concat(F.lit(T.IMG_KEY), r["img"])).otherwise(
                T.visible(F.coalesce(r["t"], F.lit("")), o))

        body = F.array_join(F.transform(cells, lambda rs: F.array_join(F.transform(rs, of_run), "")), T.CELL_KEY)
    return F.concat(F.when(kind == "tr", F.lit("T|")).otherwise(""), body)


def has_content(cells: Column) -> Column:
    return F.exists(cells, lambda rs: F.exists(rs, lambda r: r["img"].isNotNull() | F.coalesce(
        r["t"].rlike(rf"[^{T.WS}]"), F.lit(False))))


def prepare(blocks: DataFrame, o: CompareOptions) -> DataFrame:
    """Adds ``bkey`` (64-bit block key) and ``key_len`` (its visible length); no token is built yet.

    Empty blocks are dropped here, before any shuffle, unless the options keep them.
    """
    out = once(blocks, _cells=compared_cells(F.col("cells"), F.col("kind"))).drop("cells").withColumnRenamed("_cells", "cells")
    if not o.keep_empty:
        out = out.filter(has_content(F.col("cells")))
    visible = F.length(T.strip_ws(F.col("_key")))
    if o.ignore_ws and not o.norm_punct:  # no white space is left in the key, but for that of an image's name
        visible = F.when(F.contains("_key", F.lit(T.IMG_KEY)), visible).otherwise(F.length("_key"))
    return (out.withColumn("_key", block_key(F.col("cells"), F.col("kind"), o))
            .withColumn("bkey", F.xxhash64("_key"))
            .withColumn("key_len", visible)
            .drop("_key"))


def word_hashes(cells: Column, o: CompareOptions) -> Column:
    """64-bit keys of the tokens that count for similarity."""
    def of_run(r: Column) -> Column:
        t = F.coalesce(r["t"], F.lit(""))
        found = F.regexp_extract_all(t, F.lit(T.SOLID_CHAR_RE), F.lit(0)) if o.precision == "char" else T.solid_words(t)
        words = F.when(T.is_folded(r["t"], o), F.transform(found, lambda t: F.xxhash64(t))).otherwise(
            F.transform(found, lambda t: F.xxhash64(T.word_key(t, o))))
        return F.when(r["img"].isNotNull(), F.array(F.xxhash64(F.concat(F.lit(T.IMG_KEY), r["img"])))).otherwise(words)

    return F.flatten(F.transform(cells, lambda rs: F.flatten(F.transform(rs, of_run))))


def row_tokens(blocks: Column, o: CompareOptions) -> Column:
    """Tokens of the blocks of a row as one sequence; a virtual blank stands between two blocks."""
    none = F.lit(None).cast(STYLE)

    def part(x: Column, k: Column) -> Column:
        gap = F.array(F.struct(
            F.lit("").alias("t"), F.xxhash64(F.lit(" ")).alias("key"), F.lit(True).alias("ws"),
            F.lit(False).alias("sep"), F.lit(True).alias("psep"), F.lit(0).alias("c"),
            k.cast("int").alias("blk"), none.alias("st")))
        own = F.transform(cell_tokens(x["cells"], o), lambda t: F.struct(
            t["t"].alias("t"), t["key"].alias("key"), t["ws"].alias("ws"), t["sep"].alias("sep"),
            t["psep"].alias("psep"), t["c"].alias("c"), k.cast("int").alias("blk"), t["st"].alias("st")))
        return F.when(k > 0, F.concat(gap, own)).otherwise(own)

    empty = F.array().cast(f"array<{TOKEN}>")
    return (F.when(F.size(blocks) == 0, empty)
            .when(F.size(blocks) == 1, cell_tokens(F.try_element_at(blocks, F.lit(1))["cells"], o))
            .otherwise(F.flatten(F.transform(blocks, part))))


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed exactly once: a one-row explode, through which the optimizer neither
    copies an expression into its consumers nor pushes a filter on it."""
    packed = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_once")).select("*", "_once.*").drop("_once")
