"""Token alignment against a brute-force version with sets of bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers

from palimpsest.llm import crosstoken, queries

SCHEMA = "doc_id long, text string, key string, a int, b string, n int, pair long, groups string, rest int, words string"
TK = tokenizers.Tokenizer.from_file(crosstoken.A)
TK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=crosstoken.B)


def piece_bytes(i):
    p = SP.id_to_piece(i)
    return bytes([int(p[3:-1], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode()


LETTERS = crosstoken.byte_letters()


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        size = len(of(i))
        out.append((i, at, at + size))
        at += size
    return out


def brute(texts):
    docs, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = spans(TK.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(LETTERS[c] for c in TK.id_to_token(i)))
        b = spans(SP.encode(text or ""), piece_bytes)
        good = text and b"".join(bytes(LETTERS[c] for c in TK.id_to_token(i)) for i, *_ in a) == want and b"".join(piece_bytes(i) for i, *_ in b) == want
        a, b = (a, b) if good else ([], [])
        links = [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
        counts.update(links)
        docs.append((a, b, links))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for a, b, links in docs:
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        text, start = [], 0
        for c in cuts:
            text.append("|".join(",".join(str(t[0]) for t in side if start < t[2] <= c) for side in (a, b)))
            start = c
        out.append((len(a), len(b), len(cuts), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), ";".join(text)))
    return out


def texts():
    rng = random.Random(4)
    letters = "etaoinsh rd lu  ABC éèçñß 019.,-'\n\t日本🙂Ж"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    return [None, "", " ", "a", "<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "  two  blanks  ", "\0x", "aࡰb 1\U0001E4F05", *some, *some[:5], "the other " * 300,
            "unbelievable transformations " * 3]


@pytest.mark.parametrize("memo", [0, 30, 1 << 20])  # all pairs joined, some, none
def test_whole_results(spark, memo):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (3, "a")]
    docs = spark.createDataFrame([(*r, "k", 1, "b", 2, 3, "g", 4, "w") for r in rows], SCHEMA).repartition(3)
    tokens = crosstoken.encode_both(docs)
    got = crosstoken.align_documents(tokens, crosstoken.pair_counts(tokens), memo=memo).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]))]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_small_steps(spark, monkeypatch):
    rows = list(enumerate(texts()))
    monkeypatch.setattr(crosstoken, "STEP", 7)  # many parts of one batch
    tokens = crosstoken.encode_both(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = crosstoken.align_documents(tokens, crosstoken.pair_counts(tokens)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows])))


def test_query_and_empty(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op11_crosstoken"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(10**6).collect()
    docs = [r for r in docs if len(r.text or "") < 3000]
    assert len(got) >= len(docs) > 100
    for r in docs:
        links = brute([r.text])[0]  # counts are the corpus's, the rest is the text's own
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links) == links[:4]
        assert g.groups_sha256 == (hashlib.sha256(links[-1].encode()).hexdigest() if links[-1] else "")
    tokens = crosstoken.encode_both(spark.createDataFrame([], SCHEMA))
    assert crosstoken.align_documents(tokens, crosstoken.pair_counts(tokens)).count() == 0
