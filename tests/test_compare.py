"""Literal cases and invariants of the comparison."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import align, changes as ch, redline as rl
from palimpsest.operators.tokens import plain_blocks
from palimpsest.options import CompareOptions
from palimpsest.plans import compare as cp
from palimpsest.schema import CELLS, run

PLAIN = CompareOptions(formatting=False)


def pairs(spark, cases):
    make = lambda i: plain_blocks(spark.createDataFrame(
        [(k, "\n".join(c[i])) for k, c in enumerate(cases)], "doc_id long, text string")).withColumnRenamed("doc_id", "pair_id")
    return make(0), make(1)


CASES = [
    (["same text here", "and there"], ["same text here", "and there"]),
    (["alpha beta gamma"], ["alpha beta gamma", "a new closing line"]),
    (["alpha beta gamma", "goes away now"], ["alpha beta gamma"]),
    (["the fee is 1,200 dollars"], ["the fee is 1,500 dollars"]),
    (["one moved block", "first of two", "second of two"], ["first of two", "second of two", "one moved block"]),
    (["short", "first of two", "second of two"], ["first of two", "second of two", "short"]),
    (["Company’s plan"], ["Company's plan"]),
    (["spaced  out text"], ["spaced out text"]),
]


def test_literal_cases(spark):
    a, b = pairs(spark, CASES)
    got = {}
    for r in cp.compare_changes(a, b, PLAIN).orderBy("pair_id", "cid").collect():
        got.setdefault(r.pair_id, []).append((r.kind, r.before, r.after))
    assert got == {
        1: [("ins", "", "a new closing line")],
        2: [("del", "goes away now", "")],
        3: [("mod", "200", "500")],
        4: [("move", "one moved block", "")],
        5: [("del", "short", ""), ("ins", "", "short")],
    }


def test_numbers_and_context_agree(spark):
    a, b = pairs(spark, CASES)
    plain = cp.compare_changes(a, b, PLAIN).select("pair_id", "cid", "kind", "row", "before", "after")
    full = cp.compare_in_context(a, b, PLAIN).select(*plain.columns)
    assert sorted(plain.collect()) == sorted(full.collect())


def random_cases(seed, n):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("lorem ipsum dolor sit amet fee 12 USD clause party shall".split())
    out = []
    for _ in range(n):
        a = [" ".join(word() for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 9))]
        b = []
        for line in a:
            k = rnd.random()
            if k < 0.15:
                continue
            b.append(" ".join(word() if rnd.random() < 0.3 else w for w in line.split()) if k < 0.5 else line)
            if k > 0.85:
                b.append(" ".join(word() for _ in range(4)))
        rnd.random() < 0.3 and rnd.shuffle(b)
        out.append((a, b or ["rest"]))
    return out


@pytest.mark.parametrize("precision", ["word", "char"])
def test_round_trip(spark, precision):
    """Accepting everything gives b, rejecting everything gives a."""
    cases = random_cases(5, 40)
    a, b = pairs(spark, cases)
    o = CompareOptions(formatting=False, precision=precision)
    flat = cp.compare_merged(a, b, o, all_rows=True)
    none = spark.createDataFrame([], "pair_id long, cid int, v string")
    squash = lambda ls: "".join("".join(ls).split())
    for pending, side in (("a", 1), ("r", 0)):
        lines = {}
        rows = rl.result_text(flat, none, pending).collect()
        for r in rows:
            lines.setdefault(r.pair_id, []).append(r.line)
        for k, c in enumerate(cases):
            # Moved blocks change places, so the lines are compared as a multiset of characters and lines.
            want = sorted(squash([x]) for x in c[side])
            got = sorted(squash([y]) for x in lines.get(k, []) for y in x.split("\n"))
            assert got == want, (k, pending)


def test_every_block_is_used_once(spark):
    cases = random_cases(6, 30)
    a, b = pairs(spark, cases)
    rows = align.row_lists(cp.compare_rows(a, b, PLAIN)).collect()
    for k, c in enumerate(cases):
        mine = sorted((r for r in rows if r.pair_id == k), key=lambda r: r.row)
        assert [r.row for r in mine] == list(range(len(mine)))
        assert sorted(p for r in mine for p in r.a_list) == list(range(len(c[0])))
        assert sorted(p for r in mine for p in r.b_list) == list(range(len(c[1])))


def test_change_numbers_are_dense(spark):
    a, b = pairs(spark, random_cases(7, 30))
    c = cp.compare_changes(a, b, PLAIN).groupBy("pair_id").agg(F.max("cid").alias("m"), F.count_distinct("cid").alias("n"), F.count("*").alias("k"))
    assert c.filter("m <> n or n <> k").count() == 0


def styled(spark, rows):
    df = spark.createDataFrame(rows, "pair_id long, sec string, pos int, kind string, level int, align string, t string, b boolean, sz double")
    return df.select("pair_id", "sec", "pos", "kind", "level", "align", F.array(F.array(run(F.col("t"), b=F.col("b"), sz=F.col("sz")))).cast(CELLS).alias("cells"))


def test_formatting(spark):
    a = styled(spark, [(1, "body", 0, "p", None, None, "plain words", None, 10.0), (1, "body", 1, "h", 1, None, "A title", None, None),
                       (1, "header", 2, "p", None, None, "running head", None, None)])
    b = styled(spark, [(1, "body", 0, "p", None, None, "plain words", True, 12.0), (1, "body", 1, "h", 2, None, "A title", None, None),
                       (1, "header", 2, "p", None, None, "running foot", None, None)])
    got = [(r.sec, r.kind, r.before, r.desc.k if r.desc else None, r.desc.sig if r.desc else None, r.desc.a if r.desc else None)
           for r in cp.compare_changes(a, b).orderBy("cid").collect()]
    assert got[0][:2] == ("header", "mod")
    assert got[1] == ("body", "fmt", "plain words", "fmt", "b+;sz:10>12", None)
    assert got[2][3:] == ("kind", None, "h1")
    rows = {(r.sec, r.kind) for r in cp.compare_rows(a, b).collect()}
    assert rows == {("header", "modified"), ("body", "format")}
    assert cp.compare_changes(a, b, PLAIN).count() == 1


def test_context_explodes_only_what_changed(spark):
    """Tokens that belong to no change are summed up in the rows, not exploded; the spans stay those of the whole text."""
    same = " ".join(f"w{i}" for i in range(200))
    a, b = pairs(spark, [([f"{same} 30 days, {same} end"], [f"{same} 45 days, {same} close"]), (["left alone", "goes"], ["left alone"])])
    rows = ch.context_entries(cp.compare_rows(a, b, PLAIN, equal_rows=False))
    assert "merged" not in rows.columns
    flat = ch.flat_merged(rows.withColumn("clause", F.lit(None).cast("string")), formats=False)
    assert flat.count() == 5  # two replaced words of two tokens each, one removed row
    got = {(r.pair_id, r.before): r for r in ch.changes_in_context(flat).collect()}
    assert {k: r.after for k, r in got.items()} == {(0, "30"): "45", (0, "end"): "close", (1, "goes"): ""}
    for (_, before), r in got.items():
        assert r.a[r.a_start:r.a_end] == before and r.b[r.b_start:r.b_end] == r.after
    assert got[0, "end"].a == f"{same} 30 days, {same} end" and got[1, "goes"].b == ""


def test_numbers_are_searched_around_the_span_only(spark):
    from palimpsest.functions import numbers as N
    text = "in 2 rows 1,234,567.5 万 of 2026-03-01, 十二 or 3 万" + " x9" * 50
    spans = spark.createDataFrame([(text, s, e) for s in range(len(text)) for e in {s, min(s + 1, len(text)), min(s + 4, len(text))}], "t string, s int, e int")
    inside = lambda p: F.filter(N.hits(F.col("t"), p), lambda h: (h["e"] > F.col("s")) & (h["s"] < F.greatest(F.col("e"), F.col("s") + 1)))
    near = lambda p: N._overlapping(F.col("t"), p, F.col("s"), F.col("e"))
    for p in (N.NUM_RE, *N.DATE_RES):
        assert spans.filter(~(near(p) == inside(p))).count() == 0
        assert spans.filter(F.size(inside(p)) > 0).count() or "年" in p
    plan = spans.select(N.number_at(F.col("t"), F.col("s"), F.col("e")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all(t#" not in plan
