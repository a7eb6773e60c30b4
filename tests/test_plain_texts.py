"""Quick paths: texts of ASCII only, texts with nothing to fold, and derived lines that are worked out once."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import tokens as tk
from palimpsest.options import CompareOptions
from palimpsest.plans import registry
from palimpsest.plans.catalog import Tables

OPTIONS = [CompareOptions(formatting=False), CompareOptions(formatting=False, ignore_case=True), CompareOptions(formatting=False, ignore_ws=False),
           CompareOptions(formatting=False, norm_quotes=False, precision="char"), CompareOptions(formatting=False, norm_punct=True)]


def texts():
    rng = random.Random(5)
    plain = [chr(c) for c in range(128)] + list("abAB01_' '\t ") * 6
    wide = plain + list("é 　日，’‘“”″Σς﻿ ") * 4
    return [None, "", "it's", "rock'n'roll '", "don’t"] + ["".join(rng.choice(x) for _ in range(rng.randint(1, 40))) for x in (plain, wide) for _ in range(300)]


@pytest.mark.parametrize("o", OPTIONS)
def test_keys_as_of_single_tokens(spark, o):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, t string").withColumn("x", F.coalesce("t", F.lit("")))
    found = lambda plain: F.regexp_extract_all("x", F.lit(plain), F.lit(0))
    cells = F.array(F.array(F.struct("t", F.lit(None).cast("string").alias("img"))))
    solid, parts = (T.SOLID_CHAR_RE, T.CHAR_RE) if o.precision == "char" else (T.SOLID_WORD_RE, T.WORD_RE)
    got = tk.cell_tokens(cells, o)
    folded = T.fold_quotes(F.col("x")) if o.norm_quotes else F.col("x")
    bad = rows.select("t", *[(a != b).alias(n) for n, a, b in [
        ("parts", F.transform(got, lambda t: t["t"]), found(parts)),
        ("keys", F.transform(got, lambda t: t["key"]), F.transform(found(parts), lambda t: F.xxhash64(T.norm_key(t, o)))),
        ("ws", F.transform(got, lambda t: t["ws"]), F.transform(found(parts), T.is_ws_token)),
        ("hashes", tk.word_hashes(cells, o), F.transform(found(solid), lambda t: F.xxhash64(T.word_key(t, o)))),
        ("visible", T.visible(F.col("x"), o), T.strip_ws(F.lower(folded) if o.ignore_case else folded))]])
    assert bad.where("parts or keys or ws or hashes or visible").collect() == []


@pytest.mark.parametrize("name, word", [("jn5_positional_gaps", "reverse("), ("jn9_equal_rows", "replace(")])
def test_derived_line_is_worked_out_once(spark, name, word):
    plan = registry.QUERIES[name](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.replace("regexp_replace(", "").count(word) == 1
