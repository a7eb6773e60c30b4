"""Logical inputs derived from the given tables, in Spark and as SQL text for the check.

Every pair below describes the same table; the edit rule of ``blocks_b`` is known, so the outcome of
an operator can be stated in SQL without running an alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.plans.catalog import Tables
from palimpsest.schema import CELLS, run


def q(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.WORD_RE)})"



WS_SQL = f"[{T.WS}]"

CTE: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name], NEEDS[name] = sql, needs


def with_(names: str, body: str) -> str:
    """The body preceded by the named derived tables and what they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in NEEDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body


# ---- lines ----------------------------------------------------------------------------------------

def lines(t: Tables) -> DataFrame:
    """lines(doc_id, pos, line, h)."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")) \
        .withColumn("h", F.col("doc_id") * 7 + F.col("pos"))


cte("lines", """SELECT doc_id, pos, line, doc_id * 7 + pos AS h FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)""")


def lines_b(t: Tables) -> DataFrame:
    """The edited lines: doc_id, pos (0-based in b), line, src (position in a, null if inserted)."""
    h, n = F.col("h"), F.length("line")
    line = (F.when(h % 5 == 1, F.concat("line", F.lit(" rev "), (h % 10).cast("string")))
            .when((h % 5 == 2) & (n > 20), F.expr("left(line, length(line) - 5)")).otherwise(F.col("line")))
    at = F.when((F.col("doc_id") % 9 == 0) & (F.col("pos") == 0), 1000000000).otherwise(F.col("pos"))
    own = F.when(h % 11 != 3, F.struct(at.alias("k1"), F.lit(0).alias("k2"), line.alias("line"),
                                       F.col("pos").alias("src")))
    new = F.when(h % 13 == 4, F.struct(
        F.col("pos").alias("k1"), F.lit(1).alias("k2"),
        F.concat(F.lit("Inserted line "), F.col("doc_id").cast("string"), F.lit("-"), F.col("pos").cast("string"))
        .alias("line"), F.lit(None).cast("int").alias("src")))
    w = Window.partitionBy("doc_id").orderBy("k1", "k2")
    return lines(t).select("doc_id", F.explode(F.filter(F.array(own, new), lambda x: x.isNotNull())).alias("x")) \
        .select("doc_id", "x.*") \
        .select("doc_id", (F.row_number().over(w) - 1).alias("pos"), "line", "src")


cte("lines_b", """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2) - 1 AS pos, line, src FROM (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 AND pos = 0 THEN 1000000000 ELSE pos END AS k1, 0 AS k2,
         CASE WHEN h % 5 = 1 THEN line || ' rev ' || (h % 10)
              WHEN h % 5 = 2 AND length(line) > 20 THEN left(line, length(line) - 5) ELSE line END AS line, pos AS src
  FROM lines WHERE h % 11 <> 3
  UNION ALL
  SELECT doc_id, pos, 1, 'Inserted line ' || doc_id || '-' || pos, NULL FROM lines WHERE h % 13 = 4)""", "lines")


def blocks(ln: DataFrame) -> DataFrame:
    """Lines as blocks: a line with bars is a table row, its parts are the cells."""
    tr = F.contains("line", F.lit(" | "))
    cells = F.when(tr, F.transform(F.split("line", r" \| ", -1), lambda c: F.array(run(c)))) \
        .otherwise(F.array(F.array(run(F.col("line")))))
    return ln.select(F.col("doc_id").alias("pair_id"), F.lit("body").alias("sec"), "pos",
                     F.when(tr, "tr").otherwise("p").alias("kind"), F.lit(None).cast("int").alias("level"),
                     F.lit(None).cast("string").alias("align"), cells.cast(CELLS).alias("cells"))


# ---- a ready edit script --------------------------------------------------------------------------

def script(t: Tables, of: DataFrame | None = None) -> DataFrame:
    """script(pair_id, row, ix, op, a, b, ws_only, fmt): tokens of the documents with a known rule of
    which are deleted, inserted or reformatted. ``of``: the lines they are wanted of, all if not given."""
    toks = (lines(t) if of is None else of).select(
        F.col("doc_id").alias("pair_id"), F.col("pos").alias("row"),
        # whether a token is blank is asked here, once: below it would be asked again in every condition that uses it
        F.posexplode(F.transform(T.word_tokens(F.col("line")), lambda w: F.struct(w.alias("tok"), T.is_ws(w).alias("ws")))).alias("ix", "_w")) \
        .select("pair_id", "row", "ix", "_w.*")
    g = F.col("pair_id") * 7 + F.col("row") * 3 + F.col("ix")
    ws = F.col("ws")
    op = F.when(ws, 0).when(F.floor(g / 4) % 5 == 1, F.when(g % 3 != 0, -1).otherwise(1)).otherwise(0)
    fmt = F.when((F.col("op") == 0) & ~F.col("ws"), F.when(F.floor(g / 5) % 7 == 2, "b+").when(g % 11 == 5, "sz:10>12"))
    none = F.lit(None).cast("string")
    tok = lambda keep: F.when(keep, F.struct(
        F.col("tok").alias("t"), F.col("ws").alias("ws"), F.lit(False).alias("sep"), F.lit(False).alias("psep"),
        F.lit(0).alias("c"), F.lit(0).alias("blk")))
    return toks.withColumn("op", op).select(
        "pair_id", "row", "ix", "op", tok(F.col("op") <= 0).alias("a"), tok(F.col("op") >= 0).alias("b"),
        F.lit(False).alias("ws_only"), fmt.alias("fmt"))


cte("script", f"""SELECT pair_id, "row", ix, op, tok, ws,
    CASE WHEN op <= 0 THEN tok END AS at_, CASE WHEN op >= 0 THEN tok END AS bt_,
    CASE WHEN op = 0 AND NOT ws THEN CASE WHEN (g // 5) % 7 = 2 THEN 'b+' WHEN g % 11 = 5 THEN 'sz:10>12' END END AS fmt
  FROM (SELECT *, CASE WHEN ws THEN 0 WHEN (g // 4) % 5 = 1 THEN CASE WHEN g % 3 <> 0 THEN -1 ELSE 1 END ELSE 0 END AS op
    FROM (SELECT *, pair_id * 7 + "row" * 3 + ix AS g, regexp_matches(tok, {q('^' + WS_SQL + '+$')}) AS ws
      FROM (SELECT doc_id AS pair_id, pos AS "row", unnest(w) AS tok, unnest(range(len(w))) AS ix
        FROM (SELECT *, {words_sql('line')} AS w FROM lines))))""", "lines")


def iso(ts: Column) -> Column:
    """Time stamps are compared as text, to the microsecond."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def iso_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"
