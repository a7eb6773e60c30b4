"""Grouping of spelling variants by asymmetric q-chunks (columns and joins only).

Two words are near if one inserted, deleted or replaced code point turns one into the other. The shorter word (of
equally long ones the smaller) is cut into two disjoint chunks, its halves; the other contributes its positional
grams of those sizes. One edit leaves one of the two chunks whole, and moves it by at most one place: the first chunk
by none, the second by the difference of the lengths. So only grams at those places can meet a chunk, and words are
joined on (length of the shorter one, which chunk, its text); what meets is verified by the edit distance.

A chunk that very many words share would bring all of them together. There the words still differ by one edit in
the rest alone, so the rest is cut into two chunks in the same way, and so on until a key is rare or the
shorter word's rest is a single place, where the letters bound what can meet. No pair is lost, and no key is a group
of unlimited size.

A pair can meet on several chunks and is taken once. Each word takes the most frequent of its
near words as its form if that is frequent enough, and its root by doubled steps along the forms.

Defined cases: a null text has no words; a null doc_id is written as an empty string; repeated rows count each time;
an empty table, or one with no word frequent enough, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, saved

RUN, SHORTEST, LEAST, TIMES, CROWD = r"A-Za-z\x{C0}-\x{FF}", 7, 2, 10, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, dropout: int = 31) -> DataFrame:
    """Words (word, n): runs of letters, lower-cased in A-Z, one code point deleted where a checksum says so."""
    # a run of fewer letters gives no word that is long enough
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{RUN}]{{{shortest},}}"), F.lit(0))
    seen = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_i"), F.explode(runs).alias("_r"))
    h = F.crc32(F.concat_ws(":", "_i", "_r").cast("binary"))
    at = (h % F.char_length("_r")).cast("int")
    word = F.when(h % dropout == 0, F.overlay("_r", F.lit(""), at + 1, F.lit(1))).otherwise(F.col("_r"))
    return (seen.select(word.alias("word")).where(F.char_length("word") >= shortest)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def _keyed(words: DataFrame) -> DataFrame:
    """Words → rows (word, n, m, chunk, key, rest, longer): what may meet on a chunk of a word of length m.

    ``rest`` is the word without the chunk; ``longer`` says that the word is one place longer than m. Both words of
    a pair of equal length come with chunks that are their own grams, so one row serves as either side.
    """
    size = F.char_length("word")

    def cut(m: Column, longer: bool):
        half = F.floor(m / 2).cast("int")
        first = F.struct(F.lit(0).alias("chunk"), F.substring("word", 1, half).alias("key"), F.substring("word", half + 1, size).alias("rest"))
        # the second chunk of a shorter word starts at half + 1, or one place further on in this word
        start = half + (2 if longer else 1)
        second = F.struct(F.lit(1).alias("chunk"), F.substring("word", start, size).alias("key"), F.substring("word", F.lit(1), start - 1).alias("rest"))
        return [F.struct(m.alias("m"), F.lit(longer).alias("longer"), side["chunk"].alias("chunk"), side["key"].alias("key"), side["rest"].alias("rest")) for side in (first, second)]
    return words.select("word", "n", F.explode(F.array(*cut(size, False), *cut(size - 1, True))).alias("_k")).select("word", "n", "_k.*")


def _deeper(rows: DataFrame) -> DataFrame:
    """Rows whose key is crowded → rows keyed by a chunk of the rest besides."""
    size = F.char_length("rest")
    short = F.when(F.col("longer"), size - 1).otherwise(size)  # the rest of the shorter word
    half = F.floor(short / 2).cast("int")
    start = half + F.when(F.col("longer"), 2).otherwise(1)
    path = F.concat("key", F.lit("|"), F.col("chunk").cast("string"))
    parts = F.array(
        F.struct(F.concat(path, F.lit("<"), F.substring("rest", F.lit(1), half)).alias("key"), F.substring("rest", half + 1, size).alias("rest")),
        F.struct(F.concat(path, F.lit(">"), F.substring("rest", start, size)).alias("key"), F.substring("rest", F.lit(1), start - 1).alias("rest")))
    return rows.select("word", "n", "m", "longer", "chunk", F.explode(parts).alias("_p")).select("word", "n", "m", "longer", "chunk", "_p.key", "_p.rest")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Words (word, n) → (a, n_a, b, n_b), every unordered pair at distance one, once for each key it meets on."""
    found = None
    rows = _keyed(words)
    while True:
        # crowded keys go on to smaller rests
        left = F.char_length("rest") - F.col("longer").cast("int")
        counts = rows.groupBy("m", "chunk", "key").agg(F.count("*").alias("here"), F.max(left).alias("left"))
        crowded = saved(counts.where(F.col("here") > crowd).where("left > 1").select("m", "chunk", "key"))
        last = crowded.isEmpty()
        near = _joined(rows if last else rows.join(crowded, ["m", "chunk", "key"], "left_anti"))
        found = near if found is None else found.union(near)
        if last:
            return found
        rows = saved(_deeper(rows.join(crowded, ["m", "chunk", "key"], "left_semi")))


def _joined(rows: DataFrame) -> DataFrame:
    a = rows.where("not longer").select("m", "chunk", "key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.select("m", "chunk", "key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    return (a.join(b, ["m", "chunk", "key"]).where("longer or a < b").where(F.levenshtein("a", "b", 1) == 1)
            .select("a", "n_a", "b", "n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) → (word, root) for the words that have a form; forms grow strictly, so there is no circle."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(step, "root", "left_semi").isEmpty():
            return now
        now = checkpoint(now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))


def variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """Words (word, n) → (word, n, n_near, form, form_n, root), one row each."""
    words = saved(words)
    pairs = saved(near_pairs(words, crowd).distinct())
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(
        pairs.select(F.col("b"), F.col("a"), F.col("n_a")))
    # of the most frequent near words the smallest
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("_best"))
    known = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("_best.m") >= F.col("n") * times, F.struct(F.col("_best.near").alias("form"), (-F.col("_best.m")).alias("form_n"))).alias("_f")))
    last = roots(known.where("_f is not null").select("word", "_f.form"))
    return known.join(last, "word", "left").select(
        "word", "n", "n_near", F.col("_f.form").alias("form"), F.col("_f.form_n").alias("form_n"), F.coalesce("root", "word").alias("root"))
