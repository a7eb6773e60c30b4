"""Secret scans: patterns, and a battery of randomness tests over the whole corpus (columns only).

Base spans come from three fixed patterns. The battery adds tokens that look random: for each token of letters and
digits its encoding is inferred from the characters it uses, and three tests are made on its symbols: chi-squared
uniformity over the alphabet, runs above and below the middle, serial correlation. Their p-values are combined
(Fisher). A false-discovery rule over all tokens, with weights by length because long tokens are the better tested,
says which tokens are *not* random; the rest, if they hold enough bits, are added as ``random``.

Positions come from the lengths between and in the matches, added up in an ordered window per text. Texts leave the
scan only as lengths and short tokens.

Defined cases: a null text is empty; repeated rows get the same result each; a random token that overlaps a base span
adds nothing; no spans give an empty list and the digest of the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import saved, text_of

# The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
BITS, RATE, BINS, PER_DECADE = 90.0, 0.05, 600, 20
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# name, what its tokens look like, alphabet: the first that fits is taken
ENCODINGS = (("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"), ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
             ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER), ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
             ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"), ("base64url", "", UPPER + LOWER + DIGITS + "-_"))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array of (gap before the match, its length, the wanted group)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    return F.transform(F.sequence(F.lit(1), F.size(whole)), lambda i: F.struct(
        F.length(F.element_at(gaps, i)).alias("gap"), F.length(F.element_at(whole, i)).alias("len"), F.element_at(wanted, i).alias("value")))


def _positions(hits: DataFrame, kind: str) -> DataFrame:
    """(doc_id, mark, kind, start, stop, value) of all matches of one kind."""
    w = W.partitionBy("doc_id", "mark").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = hits.where(F.size(kind) > 0).select("doc_id", "mark", F.posexplode(kind).alias("at", "m"))
    stop = F.sum(F.col("m.gap") + F.col("m.len")).over(w)
    return rows.withColumn("stop", stop).select("doc_id", "mark", F.lit(KINDS.index(kind)).alias("kind"),
                                                (F.col("stop") - F.col("m.len")).alias("start"), "stop", F.col("m.value").alias("value"))


def _tails(df: DataFrame, out: str, z: Column, both: bool) -> DataFrame:
    """+ out: the upper tail of the normal distribution at z, or both tails (a rational approximation).

    Each step is a column, so that no step is written out more than once in a plan.
    """
    df = df.withColumn("_z", z).withColumn("_x", F.abs("_z") / F.lit(2 ** 0.5)).withColumn("_t", 1 / (1 + 0.3275911 * F.col("_x")))
    # The coefficients of the approximation.
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        df = df.withColumn("_q", poly)
        poly = F.col("_q") * F.col("_t") + c
    df = df.withColumn("_h", 0.5 * F.col("_t") * poly * F.exp(-F.col("_x") * F.col("_x")))
    value = 2 * F.col("_h") if both else F.when(F.col("_z") >= 0, F.col("_h")).otherwise(1 - F.col("_h"))
    return df.withColumn(out, F.greatest(value, F.lit(1e-15))).drop("_z", "_x", "_t", "_q", "_h")


def battery(tokens: DataFrame) -> DataFrame:
    """Tokens (value) → + encoding, n, bits, p: the combined p-value of "its symbols are random"."""
    token = F.col("value")
    name, alphabet = F.lit(None), F.lit(None)
    for label, shape, letters in reversed(ENCODINGS):
        here = token.rlike(shape) if shape else F.lit(True)
        name, alphabet = F.when(here, label).otherwise(name), F.when(here, letters).otherwise(alphabet)
    folded = F.when(F.col("encoding").isin("hex", "base36"), F.lower(token)).when(
        F.col("encoding") == "base64url", F.translate(token, "+/", "-_")).otherwise(token)
    v = (tokens.withColumn("encoding", name).withColumn("abc", alphabet).withColumn("folded", folded)
         .withColumn("s", F.expr("transform(sequence(1, length(folded)), i -> locate(substr(folded, i, 1), abc) - 1)"))
         .withColumn("n", F.size("s").cast("double")).withColumn("k", F.length("abc").cast("double"))
         .withColumn("bits", F.col("n") * F.log2("k"))
         .withColumn("sq", F.expr("aggregate(transform(sequence(1, length(abc)), i -> length(folded) - length(replace(folded, substr(abc, i, 1), ''))), 0D, (a, c) -> a + CAST(c AS DOUBLE) * c)"))
         .withColumn("hi", F.expr("transform(s, x -> CASE WHEN 2 * x >= k THEN 1 ELSE 0 END)"))
         .withColumn("n1", F.expr("CAST(aggregate(hi, 0, (a, x) -> a + x) AS DOUBLE)"))
         .withColumn("runs", F.expr("1D + size(filter(sequence(1, size(hi) - 1), i -> hi[i] <> hi[i - 1]))"))
         .withColumn("mean", F.expr("aggregate(s, 0D, (a, x) -> a + x) / n"))
         .withColumn("var", F.expr("aggregate(s, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
         .withColumn("cov", F.expr("aggregate(sequence(1, size(s) - 1), 0D, (a, i) -> a + (s[i] - mean) * (s[i - 1] - mean))")))
    n, k, n1, hope, spread = (F.col(c) for c in ("n", "k", "n1", "hope", "spread"))
    v = v.withColumn("hope", 2 * n1 * (n - n1) / n + 1).withColumn("spread", (hope - 1) * (hope - 2) / (n - 1))
    v = _tails(v, "p1", (k / n * F.col("sq") - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), both=False)
    v = _tails(v, "p2", F.when(spread > 0, (F.col("runs") - hope) / F.sqrt(spread)).otherwise(8.0), both=True)
    v = _tails(v, "p3", F.when(F.col("var") > 0, (F.col("cov") / F.col("var") + 1 / n) * F.sqrt(n)).otherwise(8.0), both=True)
    v = v.withColumn("x", -(F.log("p1") + F.log("p2") + F.log("p3")))
    return v.withColumn("p", F.expr("exp(-x) * (1 + x + x * x / 2)")).drop(
        "abc", "folded", "s", "k", "sq", "hi", "n1", "runs", "mean", "var", "cov", "hope", "spread", "p1", "p2", "p3", "x")


def random_tokens(tokens: DataFrame, rate: float = RATE, bits: float = BITS) -> DataFrame:
    """Tokens that the battery takes for random, after false-discovery control over all tokens.

    Weighted step-up rule: p over (length / mean length), counted in bins of its logarithm; the largest bin edge at
    which edge x tokens / (tokens below it) is within ``rate`` is the bound, and tokens below it are not random.
    """
    tested = saved(battery(tokens.where(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))))
    mean = F.coalesce(F.lit((tested.agg(F.avg("n")).first() or [None])[0]), F.lit(1.0))
    weighed = tested.withColumn("bin", F.least(F.floor(-F.log10(F.greatest(F.col("p") * mean / F.col("n"), F.lit(1e-30))) * PER_DECADE), F.lit(BINS)).cast("int"))
    order = W.orderBy(F.desc("bin"))
    table = weighed.groupBy("bin").count().withColumn("below", F.sum("count").over(order)).withColumn("all", F.sum("count").over(W.partitionBy()))
    edge = F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE)
    low = table.where(edge * F.col("all") <= rate * F.col("below")).agg(F.min("bin")).first()
    bound = low[0] if low and low[0] is not None else BINS + 1
    return weighed.where((F.col("bin") < bound) & (F.col("bits") >= bits))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) → (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    text = docs.select("doc_id", text_of().alias("_t"), F.xxhash64(text_of()).alias("mark"))
    t = F.col("_t")
    some = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
    none = F.array().cast("array<struct<gap:int,len:int,value:string>>")
    any_of = None
    for pattern in some.values():
        any_of = t.rlike(pattern) if any_of is None else any_of | t.rlike(pattern)
    hits = saved(text.where(any_of).select("doc_id", "mark", *[
        F.when(t.rlike(p), _matches(t, p, 2 if kind == "assign" else 0)).otherwise(none).alias(kind) for kind, p in some.items()])
        .dropDuplicates(["doc_id", "mark"]))
    base = (_positions(hits, "assign").where(F.length("value") >= 12)
            .union(_positions(hits, "access")).union(_positions(hits, "hex")))
    tokens = _positions(hits, "random")
    spans = base.select("doc_id", "mark", "start", "kind", "stop").union(random_tokens(tokens).select("doc_id", "mark", "start", "kind", "stop"))
    lists = spans.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"))
    own = F.filter("all", lambda s: s["kind"] < 3)
    lists = lists.withColumn("base", own).withColumn("all", F.filter("all", lambda s: (s["kind"] < 3) | ~F.exists(
        "base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))
    said = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","), F.lit(""))
    count = lambda kind: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    lists = lists.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "base", "all")
    rows = text.select("doc_id", "mark")
    return (rows.join(lists, rows["doc_id"].eqNullSafe(lists["_d"]) & (rows["mark"] == lists["_m"]), "left")
            .withColumn("base", F.coalesce("base", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")))
            .select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("all")).alias("spans")))
