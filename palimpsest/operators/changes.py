"""Aligned rows to merged tokens, change segments, numbered changes and final row kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import kernels as K
from palimpsest.operators.tokens import kind_id, once, row_tokens
from palimpsest.options import CompareOptions
from palimpsest.schema import TOKEN

PR = ["pair_id", "row"]
DESC = "struct<k:string,a:string,b:string,n:int,sig:string>"


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _same(a: Column, b: Column, default) -> Column:
    return F.coalesce(a, F.lit(default)) == F.coalesce(b, F.lit(default))


def same_style(a: Column, b: Column) -> Column:
    """Field-wise equality; a missing field equals its default."""
    out = F.lit(True)
    for f in ("b", "i", "u", "s"):
        out = out & (_flag(a[f]) == _flag(b[f]))
    out = out & _same(a["sz"], b["sz"], 0.0)
    for f in ("color", "hl", "font"):
        out = out & _same(a[f], b[f], "")
    return out


def _num(c: Column) -> Column:
    """A number as JavaScript prints it: no trailing .0."""
    s = c.cast("string")
    return F.coalesce(F.regexp_replace(s, r"\.0$", ""), F.lit(""))


def style_diff_sig(a: Column, b: Column) -> Column:
    """Signature of the style differences, e.g. ``b+;sz:10>12``; empty when there are none."""
    none = F.lit(None).cast("string")
    parts = [F.when(_flag(a[f]) != _flag(b[f]),
                    F.when(_flag(b[f]), f + "+").otherwise(f + "-")).otherwise(none)
             for f in ("b", "i", "u", "s")]
    txt = lambda c: F.coalesce(c, F.lit(""))
    parts.append(F.when(~_same(a["sz"], b["sz"], 0.0),
                        F.concat(F.lit("sz:"), _num(a["sz"]), F.lit(">"), _num(b["sz"]))))
    parts.append(F.when(~_same(a["color"], b["color"], ""),
                        F.concat(F.lit("color:"), txt(a["color"]), F.lit(">"), txt(b["color"]))))
    parts.append(F.when(~_same(a["hl"], b["hl"], ""),
                        F.when(txt(b["hl"]) != "", F.concat(F.lit("hl+"), b["hl"])).otherwise("hl-")))
    parts.append(F.when(~_same(a["font"], b["font"], ""),
                        F.concat(F.lit("font:"), txt(a["font"]), F.lit(">"), txt(b["font"]))))
    return F.concat_ws(";", *parts)


# ---- merged tokens --------------------------------------------------------------------------------

def merge_tokens(rows: DataFrame, o: CompareOptions, equal_rows: bool = True) -> DataFrame:
    """Adds ``merged`` to rows: ARRAY<STRUCT<op, a, b, ws_only, fmt>>, the edit script of the row.

    Tokens are built here, for the rows that need them: without ``equal_rows`` (and without formatting)
    unchanged rows get an empty script. Rows whose keys are equal token by token are zipped in the JVM; the
    alignment kernel sees only the others, as 8-byte keys.
    """
    def toks(c: str) -> Column:
        built = row_tokens(F.col(c), o)
        if equal_rows or o.formatting:
            return built
        return F.when(F.col("kind") != "equal", built).otherwise(F.array().cast(f"array<{TOKEN}>"))

    t = once(rows, at=toks("a"), bt=toks("b"))
    keys = lambda c: F.transform(c, lambda x: x["key"])
    zipped = (F.size("at") == F.size("bt")) & (keys("at") == keys("bt"))
    one_sided = (F.size("at") == 0) | (F.size("bt") == 0)
    info = lambda c: F.transform(c, lambda x: (
        F.length(x["t"]) * 4 + x["ws"].cast("int") + 2 * x["sep"].cast("int")).cast("int"))
    t = t.withColumn("way", F.when(zipped, 0).when(one_sided, 1).otherwise(2))
    ask = lambda c: F.when(F.col("way") == 2, c)
    t = t.withColumn("sc", K.token_script(
        ask(keys("at")), ask(keys("bt")), ask(info("at")), ask(info("bt"))))
    kind, null = F.col("kind"), F.lit(None).cast(TOKEN)
    entry = lambda op, a, b: _merged_token(op, a, b, kind, o)
    merged = (F.when(F.col("way") == 0, F.zip_with("at", "bt", lambda a, b: entry(F.lit(0), a, b)))
              .when(F.col("way") == 1, F.concat(F.transform("at", lambda a: entry(F.lit(-1), a, null)),
                                                F.transform("bt", lambda b: entry(F.lit(1), null, b))))
              .otherwise(F.transform("sc", lambda m: entry(
                  m["op"], F.try_element_at("at", m["a"] + 1), F.try_element_at("bt", m["b"] + 1)))))
    return once(t, merged=merged).drop("at", "bt", "sc", "way")


def _merged_token(op: Column, a: Column, b: Column, kind: Column, o: CompareOptions) -> Column:
    """One edit-script entry with its white-space flag and format signature."""
    paired = kind.isin("modified", "equal")
    edit = (op != 0) & paired
    virtual = _flag(a["psep"]) | _flag(b["psep"])
    blank = (_flag(a["ws"]) | _flag(b["ws"])) if o.ignore_ws else F.lit(False)
    # In an equal row every remaining difference is white space: it counts as equal.
    neutral = edit & (kind == "equal")
    fmt = F.lit(None).cast("string")
    if o.formatting:
        sig = style_diff_sig(a["st"], b["st"])
        fmt = F.when((op == 0) & paired & ~a["sep"] & ~a["ws"] & ~same_style(a["st"], b["st"]), sig)
    return F.struct(
        F.when(neutral, 0).otherwise(op).alias("op"), a.alias("a"), b.alias("b"),
        (neutral | (edit & (virtual | blank))).alias("ws_only"), fmt.alias("fmt"))


def block_notes(rows: DataFrame, o: CompareOptions) -> DataFrame:
    """Adds ``block_desc``: split / merge of paired rows, kind / align change of equal rows."""
    if not o.formatting:
        return rows.withColumn("block_desc", F.lit(None).cast(DESC))
    none = F.lit(None)
    desc = lambda k, x, y: F.struct(
        F.lit(k).alias("k"), x.cast("string").alias("a"), y.cast("string").alias("b"),
        none.cast("int").alias("n"), none.cast("string").alias("sig")).cast(DESC)
    na, nb = F.size("a"), F.size("b")
    a, b = F.try_element_at("a", F.lit(1)), F.try_element_at("b", F.lit(1))
    left = F.lit("left")
    equal = F.col("kind") == "equal"
    kind_differs = (a["kind"] != b["kind"]) | ((a["kind"] == "h") & ~a["level"].eqNullSafe(b["level"]))
    align_differs = (F.coalesce(a["align"], left) != F.coalesce(b["align"], left)) & (a["kind"] != "tr")
    return rows.withColumn("block_desc", (
        F.when((F.col("kind") == "modified") & (na > 1), desc("merge", na, nb))
        .when((F.col("kind") == "modified") & (nb > 1), desc("split", na, nb))
        .when(equal & kind_differs, desc("kind", kind_id(a["kind"], a["level"]), kind_id(b["kind"], b["level"])))
        .when(equal & align_differs, desc("align", F.coalesce(a["align"], left), F.coalesce(b["align"], left)))))


def settle_rows(rows: DataFrame) -> DataFrame:
    """Final row kinds: rows without a change are equal, equal rows with a note or a format run and
    paired rows with nothing but a note are ``format``."""
    edits = F.exists("merged", lambda m: (m["op"] != 0) & ~m["ws_only"])
    fmts = F.exists("merged", lambda m: m["fmt"].isNotNull())
    note = F.col("block_desc").isNotNull()
    return rows.withColumn("kind", (
        F.when(~F.col("kind").isin("modified", "equal"), F.col("kind"))
        .when(~edits & ~fmts & ~note, "equal")
        .when(F.col("kind") == "equal", "format")
        .when(~edits & ~fmts & note, "format")
        .otherwise(F.col("kind"))))


# ---- segments -------------------------------------------------------------------------------------

def _near(c: Column, w: Window, step: int) -> Column:
    """The value of the entry just before (-1) or after (1), null if it is not in the table."""
    move = F.lag if step < 0 else F.lead
    return F.when(move("ix").over(w) == F.col("ix") + step, move(c).over(w))


def _runs(t: DataFrame, w: Window, same_run: Column, member: Column, name: str) -> DataFrame:
    """Adds ``name``: the first ix of the run of members an entry belongs to, else null."""
    t = t.withColumn("_s", F.when(member & ~F.coalesce(same_run, F.lit(False)), F.col("ix")))
    first = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn(name, F.when(member, first)).drop("_s")


def edit_segments(merged: DataFrame) -> DataFrame:
    """Adds ``seg``: the first ix of the run of differing tokens a token belongs to, else null.

    One equal white-space token between two differing tokens belongs to their run. Tokens in no run may be
    missing from the table.
    """
    w = Window.partitionBy(*PR).orderBy("ix")
    blank = _flag(F.col("a.ws")) | _flag(F.col("b.ws"))
    t = merged.withColumn("_d", (F.col("op") != 0) & ~F.col("ws_only"))
    between = _flag(_near("_d", w, -1)) & _flag(_near("_d", w, 1))
    t = t.withColumn("_m", F.col("_d") | ((F.col("op") == 0) & blank & between))
    return _runs(t, w, _near("_m", w, -1), F.col("_m"), "seg").drop("_d", "_m")


def format_segments(merged: DataFrame) -> DataFrame:
    """Adds ``fseg``: first ix of the run of equal tokens that share one format signature.

    A white-space token joins the run before it if the token after it carries the same signature.
    """
    w = Window.partitionBy(*PR).orderBy("ix")
    blank = (F.col("op") == 0) & _flag(F.col("a.ws")) & F.col("fmt").isNull()
    before, after = _near("fmt", w, -1), _near("fmt", w, 1)
    t = merged.withColumn("_sig", F.when(blank & (before == after), before).otherwise(F.col("fmt")))
    return _runs(t, w, _near("_sig", w, -1) == F.col("_sig"), F.col("_sig").isNotNull(), "fseg").drop("_sig")


WHOLE = ("removed", "added", "moved-from", "moved-to")


def _entries(rows: DataFrame, edits_only: bool, empty: bool = True) -> Column:
    """The entries of the edit script of a row, its block note first. Without ``empty`` a row without tokens has none."""
    entries = F.transform("merged", lambda m, i: F.struct(
        i.cast("int").alias("ix"), m["op"].alias("op"), m["a"].alias("a"), m["b"].alias("b"),
        m["ws_only"].alias("ws_only"), m["fmt"].alias("fmt")))
    if edits_only:
        whole = F.col("kind").isin(*WHOLE)
        live = lambda m: ((m["op"] != 0) & ~m["ws_only"]) | m["fmt"].isNotNull()
        near = lambda i: F.coalesce(live(F.try_element_at("merged", i)), F.lit(False))
        # Entry ix is element ix + 1; element 0 does not exist.
        bridge = lambda m: (m["op"] == 0) & (_flag(m["a"]["ws"]) | _flag(m["b"]["ws"])) & (m["ix"] > 0) & \
            near(F.greatest(m["ix"], F.lit(1))) & near(m["ix"] + 2)
        entries = F.filter(entries, lambda m: live(m) | bridge(m))
        # A row that is one change as a whole needs its text only: one entry instead of all tokens.
        null = F.lit(None).cast(TOKEN)
        text = lambda side: F.when(F.size(side) > 0, F.struct(
            row_text(side).alias("t"), F.lit(0).alias("key"), F.lit(False).alias("ws"), F.lit(False).alias("sep"), F.lit(False).alias("psep"),
            F.lit(0).alias("c"), F.lit(0).alias("blk"), F.lit(None).alias("st")).cast(TOKEN)).otherwise(null)
        single = F.array(F.struct(
            F.lit(0).alias("ix"), F.when(F.size("a") > 0, -1).otherwise(1).alias("op"), text("a").alias("a"), text("b").alias("b"),
            F.lit(False).alias("ws_only"), F.lit(None).cast("string").alias("fmt")))
        entries = F.when(whole if empty else whole & (F.size("merged") > 0), single).otherwise(entries)
    elem = rows.schema["merged"].dataType.elementType
    a_type, b_type = elem["a"].dataType, elem["b"].dataType
    mark = F.array(F.struct(
        F.lit(-1).alias("ix"), F.lit(0).alias("op"), F.lit(None).cast(a_type).alias("a"),
        F.lit(None).cast(b_type).alias("b"), F.lit(True).alias("ws_only"), F.lit(None).cast("string").alias("fmt")))
    return F.when(F.col("block_desc").isNotNull(), F.concat(mark, entries)).otherwise(entries)


def context_entries(rows: DataFrame) -> DataFrame:
    """Rows with ``entries`` in place of ``merged``: what can belong to a change, each with ``a_len`` and ``b_len``, the
    length of the row's text on each side from the entry before to this one, the first with the whole text of the row
    as ``a_row`` and ``b_row``. So no other token goes through a shuffle, a sort or a window."""
    whole = F.col("kind").isin(*WHOLE)
    t = once(rows, kept=F.when(F.col("kind") != "equal", _entries(rows, edits_only=True, empty=False)))

    def in_row(m: Column, i: Column) -> Column:
        past = F.when(i > 0, F.get("kept", i - 1)["ix"]).otherwise(-1)
        since = F.slice("merged", past + 2, F.when(whole, F.size("merged")).otherwise(m["ix"] - past))
        length = lambda s: F.aggregate(since, F.lit(0), lambda n, x: n + F.length(shown_text(x[s])))
        first = lambda c: F.when(i == 0, c)
        return F.struct(*[m[c].alias(c) for c in ("ix", "op", "a", "b", "ws_only", "fmt")], length("a").alias("a_len"), length("b").alias("b_len"),
                        first(row_text("a")).alias("a_row"), first(row_text("b")).alias("b_row"))
    return once(t, entries=F.transform("kept", in_row)).drop("kept", "merged")


def flat_merged(rows: DataFrame, all_rows: bool = False, edits_only: bool = False,
                formats: bool = True) -> DataFrame:
    """merged(pair_id, row, ix, op, a, b, ws_only, fmt, at, cid, …): one line per edit-script entry
    of the changed rows, each with its change.

    ``at`` is where its change starts in the row; a block note is an entry of its own at -1. ``cid``
    numbers the changes of a pair in row order; the target of a move shares its source's number.
    ``edits_only`` drops tokens that can belong to no change before anything is exploded or sorted;
    without ``formats`` no format run is looked for. Rows may carry ready ``context_entries``.

    Spark forgets behind the alignment kernel how rows lie; they are dealt by pair once, as rows, so that no step
    behind shuffles their tokens. Context entries come with clauses, for which the rows were dealt by pair already.
    """
    src = rows if all_rows else rows.filter((F.col("kind") != "equal"))
    entries = F.col("entries") if "entries" in rows.columns else _entries(rows, edits_only)
    extra = ["clause"] if "clause" in rows.columns else []
    own = [*PR, "sec", "rkind", "move_row", "move_to", "block_desc", *extra]
    src = src.withColumn("rkind", F.col("kind")).select(*own, entries.alias("_m"))
    if "entries" not in rows.columns:
        src = src.repartition("pair_id")
    t = src.select(*own, F.explode("_m").alias("m")).select(*own, "m.*")
    t = edit_segments(t)
    t = format_segments(t) if formats else t.withColumn("fseg", F.lit(None).cast("int"))
    whole = F.col("rkind").isin(*WHOLE)
    fseg = F.when(F.col("fmt").isNotNull() | _flag(F.col("a.ws")), F.col("fseg"))
    t = t.withColumn("at", F.when(F.col("ix") == -1, -1).when(whole, 0).otherwise(F.coalesce("seg", fseg)))
    t = t.withColumn("crow", F.when(F.col("rkind") == "moved-to", F.col("move_row")).otherwise(F.col("row")))
    ranked = Window.partitionBy("pair_id", F.col("at").isNull()).orderBy("crow", "at")
    return t.withColumn("cid", F.when(F.col("at").isNotNull(), F.dense_rank().over(ranked)))


def shown_text(token: Column) -> Column:
    """What a token adds to the text of its row: cell breaks print as a bar, missing and virtual tokens not at all."""
    return F.when(token.isNull() | _flag(token["psep"]), "").when(_flag(token["sep"]), " | ").otherwise(F.coalesce(token["t"], F.lit("")))


def side_text(side: str, keep: Column | None = None) -> Column:
    """Aggregate: the text of one side of a group of merged tokens; cell breaks print as a bar."""
    piece = F.when(_flag(F.col(f"{side}.sep")), F.lit(" | ")).otherwise(F.coalesce(F.col(f"{side}.t"), F.lit("")))
    if keep is not None:
        piece = F.when(keep, piece).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("row").alias("r"), F.col("ix").alias("o"), piece.alias("t"))))
    return F.array_join(ordered.getField("t"), "")


def row_text(side: str) -> Column:
    """The text of one side of a row from its ``merged`` array."""
    return F.array_join(F.transform("merged", lambda m: F.when(_flag(m[side]["sep"]), F.lit(" | ")).otherwise(
        F.coalesce(m[side]["t"], F.lit("")))), "")


def _kind(note: Column, rkind: Column, edit: Column, d: Column, i: Column) -> Column:
    return (F.when(note, "fmt").when(rkind == "removed", "del").when(rkind == "added", "ins")
            .when(rkind == "moved-from", "move")
            .when(edit & d & i, "mod").when(edit & d, "del").when(edit, "ins").otherwise("fmt"))


def _desc(kind: Column, note: Column, block_desc: Column, move_to: Column, sig: Column) -> Column:
    null = lambda t: F.lit(None).cast(t)
    made = lambda k, n, sg: F.struct(
        F.lit(k).alias("k"), null("string").alias("a"), null("string").alias("b"), n.cast("int").alias("n"),
        sg.cast("string").alias("sig")).cast(DESC)
    return (F.when(note, block_desc).when(kind == "move", made("move", move_to, null("string")))
            .when(kind == "fmt", made("fmt", null("int"), sig)))


def list_changes(flat: DataFrame) -> DataFrame:
    """changes(pair_id, cid, sec, kind, row, row2, at, before, after, desc) of ``flat_merged``."""
    g = flat.filter(F.col("at").isNotNull() & (F.col("rkind") != "moved-to")).groupBy("pair_id", "cid").agg(
        *[F.first(c).alias(c) for c in ("sec", "row", "rkind", "at", "move_row", "move_to", "block_desc")],
        F.max("fmt").alias("sig"), F.bool_or(F.col("seg").isNotNull()).alias("edit"),
        F.bool_or(F.col("op") == -1).alias("d"), F.bool_or(F.col("op") == 1).alias("i"),
        side_text("a").alias("ta"), side_text("b").alias("tb"))
    return _change_columns(g)


def _change_columns(g: DataFrame, *more: str) -> DataFrame:
    note = F.col("at") == -1
    w = F.col("rkind").isin("removed", "added", "moved-from")
    kind = _kind(note, F.col("rkind"), F.col("edit") & ~w, F.col("d"), F.col("i"))
    before = F.when(kind == "fmt", F.col("tb")).when(kind == "ins", F.when(w, F.col("ta")).otherwise("")) \
        .otherwise(F.col("ta"))
    after = F.when(kind.isin("mod", "ins"), F.col("tb")).otherwise("")
    return g.select(
        "pair_id", "cid", "sec", kind.alias("kind"), "row", F.when(kind == "move", F.col("move_row")).alias("row2"), "at",
        before.alias("before"), after.alias("after"),
        _desc(kind, note, F.col("block_desc"), F.col("move_to"), F.col("sig")).alias("desc"), *more)


def changes_in_context(flat: DataFrame) -> DataFrame:
    """``list_changes`` of ``flat_merged`` over ``context_entries``, plus the row's text on each side and the span of the
    change in it: a, a_start, a_end, b, b_start, b_end; a clause column is passed on. One grouping by row, no join."""
    w = Window.partitionBy(*PR).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*PR, "at")
    t = flat
    for s in ("a", "b"):
        tok = F.col(s)
        mine = tok.isNotNull() & ~_flag(tok["psep"]) & (F.col("ix") >= 0) & (F.col("op") != 0)
        t = t.withColumn(f"_{s}", shown_text(tok)).withColumn(f"_{s}e", F.sum(f"{s}_len").over(w))
        t = t.withColumn(f"{s}_start", F.coalesce(F.min(F.when(mine, F.col(f"_{s}e") - F.length(f"_{s}"))).over(own), F.lit(0)))
        t = t.withColumn(f"{s}_end", F.coalesce(F.max(F.when(mine, F.col(f"_{s}e"))).over(own), F.lit(0)))
    t = t.withColumn("sig", F.max("fmt").over(own)).withColumn("d", F.max(F.col("op") == -1).over(own)) \
        .withColumn("i", F.max(F.col("op") == 1).over(own)).withColumn("edit", F.col("seg").isNotNull())
    keep = ["cid", "sec", "rkind", "at", "move_row", "move_to", "block_desc", "sig", "d", "i", "edit",
            "a_start", "a_end", "b_start", "b_end"] + [c for c in ("clause",) if c in flat.columns]
    head = F.col("at").isNotNull() & (F.col("ix") == F.col("at")) & (F.col("rkind") != "moved-to")
    piece = F.struct("ix", "at", F.col("_a").alias("a"), F.col("_b").alias("b"))
    g = t.groupBy(*PR).agg(F.array_sort(F.collect_list(piece)).alias("L"),
                           F.collect_list(F.when(head, F.struct(*keep))).alias("H"),
                           *[F.first(f"{s}_row", ignorenulls=True).alias(s) for s in ("a", "b")])
    txt = lambda lst, s: F.array_join(F.transform(lst, lambda x: x[s]), "")
    parts = F.transform("H", lambda h: F.struct(
        h.alias("h"), txt(F.filter("L", lambda x: x["at"] == h["at"]), "a").alias("ta"),
        txt(F.filter("L", lambda x: x["at"] == h["at"]), "b").alias("tb")))
    g = g.select(*PR, "a", "b", F.explode(parts).alias("p")).select(*PR, "a", "b", "p.h.*", "p.ta", "p.tb")
    more = ["a", "a_start", "a_end", "b", "b_start", "b_end"] + [c for c in ("clause",) if c in flat.columns]
    return _change_columns(g, *more)


def note_texts(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Fills ``before`` of block notes with the first 80 characters of the row's old text."""
    txt = rows.filter(F.col("block_desc").isNotNull()).select(
        *PR, F.lit(-1).alias("at"), F.substring(row_text("a"), 1, 80).alias("_t"))
    return changes.join(txt, [*PR, "at"], "left").withColumn("before", F.coalesce("_t", "before")) \
        .drop("_t").select(*changes.columns)


def change_stats(changes: DataFrame) -> DataFrame:
    """One row per pair with the number of changes of each kind."""
    kinds = ["del", "ins", "mod", "fmt", "move"]
    return changes.groupBy("pair_id").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in kinds])
