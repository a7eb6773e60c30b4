"""Queries of the operators over whole tables, and their SQL equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bytebpe, crosstoken, exact, html, mix, nearvec, pieces, quality, secrets, shard, simhash, spelling, warc
from palimpsest.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_mix")
def op1(spark, folder):
    m = mix.mix(table(spark, folder, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


@query("op3_shard")
def op3(spark, folder):
    return shard.shard_documents(table(spark, folder, "documents"))


@query("op7_exact", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)""")
def op7(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))


@query("op9_simhash")
def op9(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op4_secrets")
def op4(spark, folder):
    return secrets.find_secrets(table(spark, folder, "documents"))


@query("op8_quality")
def op8(spark, folder):
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * j AS BIGINT)) & 31)::INTEGER, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM q""")
def op10(spark, folder):
    return warc.archive_pages(table(spark, folder, "pages"))


@query("op2_nearvec")
def op2(spark, folder):
    return nearvec.link(table(spark, folder, "embeddings"))


@query("op6_pieces")
def op6(spark, folder):
    return pieces.encode_samples(table(spark, folder, "documents"))


@query("op5_html")
def op5(spark, folder):
    return html.extract(table(spark, folder, "pages"))


@query("op13_bytebpe")
def op13(spark, folder):
    encoded = bytebpe.encode_documents(table(spark, folder, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bytebpe.little_endian(F.col("ids"), 1 << 16), 256).alias("ids_sha256"),
                          F.sha2(bytebpe.decode_ids(F.col("ids")), 256).alias("decoded_sha256"))


_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) not in "'\\")[:64]
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100))


@query("op12_spelling", rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
keyed AS (SELECT r, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs),
hashed AS (SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM keyed, crc),
counted AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, count(*) AS n FROM hashed GROUP BY 1),
words AS (SELECT word, n, translate(word, '{_ACCENTED}', '{_SIGNS}') AS w FROM counted WHERE length(word) >= 7 AND n >= 2),
shorter AS (SELECT word, n, w, unnest(list_append(list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1)), w)) AS d FROM words),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM shorter a JOIN shorter b USING (d) WHERE a.word <> b.word AND levenshtein(a.w, b.w) = 1),
best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * words.n THEN other END AS form, CASE WHEN m >= 10 * words.n THEN m END AS form_n
          FROM words LEFT JOIN best ON best.word = words.word AND k = 1),
chain AS (SELECT word, word AS root, form AS step FROM forms
          UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON forms.word = chain.step)
SELECT forms.word, n, n_near, form, form_n, root FROM forms JOIN chain ON chain.word = forms.word WHERE step IS NULL""")
def op12(spark, folder):
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents")))


@query("op11_crosstoken")
def op11(spark, folder):
    tokens = crosstoken.encode_both(table(spark, folder, "documents"))
    rows = crosstoken.align_documents(tokens, crosstoken.pair_counts(tokens), groups_as=crosstoken.digest)
    return rows.withColumnRenamed("groups", "groups_sha256")
