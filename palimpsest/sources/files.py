"""Files to texts and lines: encodings, line ends, format routing, nested block tables."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.schema import CELLS

TEXT_EXT = ("txt", "md", "text", "log", "csv")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """files(path, name, ext, size, mtime, sha, content) of all files below a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", T.base_name(F.col("path")).alias("name"), T.extension(F.col("path")).alias("ext"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha"), "content")


def route(files: DataFrame) -> DataFrame:
    """Adds ``reader`` (docx, pdf, txt) or the ``reason`` a file is not read."""
    ext = F.col("ext")
    reader = F.when(ext.isin("docx", "pdf"), ext).when(ext.isin(*TEXT_EXT), "txt")
    reason = F.when(ext == "doc", "old .doc format: save it as .docx").otherwise(F.concat(F.lit("unsupported format ."), ext))
    return files.withColumn("reader", reader).withColumn("reason", F.when(reader.isNull(), reason))


def _legacy(data: bytes | None) -> dict | None:
    if data is None:
        return None
    for codec, name in (("gb18030", "GB18030 (GBK)"), ("big5", "Big5")):
        try:
            return {"text": data.decode(codec), "encoding": name}
        except UnicodeDecodeError:
            pass
    # Bytes that Windows-1252 leaves undefined stand for control characters.
    text = "".join(bytes([c]).decode("cp1252", "replace") if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(c) for c in data)
    return {"text": text, "encoding": "Windows-1252"}


def _legacy_batch(content: pa.Array) -> pa.Array:
    got = [_legacy(x) for x in content.to_pylist()]
    return pa.array(got, type=pa.struct([("text", pa.string()), ("encoding", pa.string())]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decode_text(files: DataFrame) -> DataFrame:
    """Adds ``text`` and ``encoding``: byte-order marks, then strict UTF-8, GB18030, Big5, Windows-1252.

    Only content that is neither marked nor valid UTF-8 leaves the JVM; other rows send a null.
    """
    head = F.hex(F.substring("content", 1, 3))
    body = lambda n: F.expr(f"substring(content, {n})")
    bom8, le, be = head == "EFBBBF", head.startswith("FFFE"), head.startswith("FEFF")
    marked = bom8 | le | be
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    legacy = F.arrow_udf(_legacy_batch, "struct<text:string,encoding:string>").asNondeterministic()
    t = files.withColumn("_old", legacy(F.when(~marked & ~valid, F.col("content"))))
    text = (F.when(bom8, body(4).cast("string")).when(le, F.decode(body(3), "UTF-16LE")).when(be, F.decode(body(3), "UTF-16BE"))
            .when(valid, F.col("content").cast("string")).otherwise(F.col("_old.text")))
    name = (F.when(bom8, "UTF-8 (BOM)").when(le, "UTF-16 LE").when(be, "UTF-16 BE").when(valid, "UTF-8").otherwise(F.col("_old.encoding")))
    return t.withColumn("text", text).withColumn("encoding", name).drop("_old")


def line_ends(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r\n")), "CRLF").when(F.contains(text, F.lit("\r")), "CR").otherwise("LF")


def text_lines(text: Column) -> Column:
    """Lines of a text with any line ends; one empty last line is dropped."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    drop = (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    return F.when(drop, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_blocks(texts: DataFrame, ids: list[str]) -> DataFrame:
    """blocks(ids…, pos, line) of decoded texts."""
    return texts.select(*ids, F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))


def text_facts(texts: DataFrame, ids: list[str]) -> DataFrame:
    """Per text: eol, lines, final_newline."""
    return texts.select(*ids, line_ends(F.col("text")).alias("eol"), F.size(text_lines(F.col("text"))).alias("lines"),
                        F.col("text").endswith("\n").alias("final_newline"))


BLOCKS = (f"doc_id bigint, sec string, pos int, kind string, level int, list string, marker string, align string, page int, cells {CELLS}")


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Nested block tables written by a format decoder."""
    return spark.read.schema(BLOCKS).format(fmt).load(path)
