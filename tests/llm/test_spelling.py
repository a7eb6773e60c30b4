"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from palimpsest.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, m int, form string, root string, key string, chunk int"


def edited(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1:]])


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdeéÿÀ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "abababab"]
    words = [w for b in base for w in [b] * rng.choice([2, 40]) + [edited(rng, b, letters) for _ in range(4)] * 2]
    words += [edited(rng, w, letters) for w in words[::7]] * 2
    rng.shuffle(words)
    return [None, "", " 12 ", *(" ".join(words[i:i + 25]) for i in range(0, len(words), 25)), "Abc".join(words[:40]), "x" * 5000 + " " + "y" * 6]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    links = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, n, len(links[w]), form[w] or "", words.get(form[w], 0), root(w)) for w, n in words.items())


@pytest.mark.parametrize("crowd", [200, 3, 0])  # few rests are cut again, many, all down to single places
def test_all_pairs(spark, crowd):
    rows = list(enumerate(texts(5))) + [(None, "aaaaaaaa aaaaaaab"), (3, "abababab")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "f", "r", "k", 0) for r in rows], SCHEMA).repartition(3)
    got = spelling.variants(spelling.vocabulary(docs), crowd=crowd).collect()
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got) == brute(rows)


def test_chains_and_ties(spark):
    words = [("abcdefgh", 100_000), ("abcdefgx", 9_000), ("abcdefyx", 800), ("abcdezyx", 70), ("abcwezyx", 7), ("bbcdefgh", 100_000), ("acdefgh", 5)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {got[w].root for w, _ in words if w != "bbcdefgh"} == {"abcdefgh"}
    assert got["abcdefgh"].form is None and got["abcdefgh"].n_near == 3 and got["bbcdefgh"].root == "bbcdefgh"
    assert got["acdefgh"].form == "abcdefgh" and got["abcwezyx"].form_n == 70


def test_empty(spark):
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], SCHEMA))).count() == 0


def test_crowded_keys_stay_small(spark):
    # a thousand words share their first half, none of them near another: nothing may compare them all
    rng = random.Random(2)
    words = {"aaaaaa" + "".join(rng.choice("bcdefghij") for _ in range(6)) for _ in range(1000)}
    rows = spelling._keyed(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    crowded = rows.groupBy("m", "chunk", "key").count().where("count > 200").select("m", "chunk", "key")
    deeper = spelling._deeper(rows.join(crowded, ["m", "chunk", "key"], "left_semi"))
    assert deeper.groupBy("m", "chunk", "key").count().agg({"count": "max"}).first()[0] < 200
