"""WARC archives: writing with revisits, normalising monolithic gzip files, reading back by offset.

``write_archives`` streams records into whole-file gzip archives. ``normalise`` inflates each archive once, in
blocks, writes every record as a gzip member of its own and a sidecar index (one JSON line per record: offset and
length of the member). ``read_archives`` opens members by the sidecar and checks each stored payload's digest.

Files go to the shared folder through a file system opened by URI; names carry the task attempt, and only files of
attempts that ended are listed in the written manifest, so a task that runs twice leaves unlisted files only.

Defined cases: a null html is an empty payload; equal payloads of ``least`` bytes or more are stored once, under the
smallest page_id (rows that repeat that page_id are responses too); a null page_id is never the smallest unless the
group has no other, and then all are responses; line breaks in a url are escaped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import saved, shared_folder, text_of

ROLL, LEVEL, BLOCK = 64 << 20, 4, 1 << 20
MANIFEST = "path string, records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str):
    from pyarrow import fs
    if "://" not in uri:  # a plain path, or Spark's short form file:/path
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(of))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit that names the page whose response holds the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_urn(page_id, url)}", "WARC-Date: 1970-01-01T00:00:00Z",
            "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
            f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}",
            f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated bytes; keeps one record at most."""
    held = bytearray()
    need = None
    for block in blocks:
        held += block
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                length = next(int(x[15:]) for x in bytes(held[:at]).split(b"\r\n") if x[:15].lower() == b"content-length:")
                need = at + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("an archive ends within a record")


def inflate(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, in blocks of bounded size."""
    state = zlib.decompressobj(31)
    while raw := stream.read(block):
        while raw:
            if state.eof:
                state = zlib.decompressobj(31)
            yield state.decompress(raw, block)
            raw = state.unconsumed_tail or state.unused_data
    if not state.eof:
        raise ValueError("an archive is cut short")


def _writer(folder: str, roll: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        task, files, out, size = TaskContext.get(), 0, None, 0
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz"
                    raw, size, records = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    out = gzip.GzipFile("", "wb", LEVEL, raw, mtime=0)
                piece = record(*(None if pd.isna(x) else int(x) if k != 1 else x for k, x in ((0, page_id), (1, url))),
                               html.encode(), None if pd.isna(refers_to) else int(refers_to))
                out.write(piece)
                size, records = size + len(piece), records + 1
                if size >= roll:
                    out.close(), raw.close()
                    out, files = None, files + 1
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [records]})
        if out is not None:
            out.close(), raw.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [records]})
    return write


def write_archives(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL) -> DataFrame:
    """Pages (page_id, url, html) → manifest (path, records) of the whole-file gzip archives written.

    The smallest page_id of each payload is found on digests alone; the texts move once, to meet it.
    """
    text = text_of("html")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    keyed = keyed.withColumn("key", F.sha2("html", 256))
    rows = keyed.where(F.octet_length("html") >= least).select("page_id", "key")
    # written, so that both sides of the join are dealt out anew and AQE can split a frequent payload
    firsts = saved(rows.groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    again = (rows.join(firsts, "key").where(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
             .select(F.col("page_id").alias("_page"), F.col("key").alias("_key"), F.col("first_id").alias("refers_to")).distinct())
    met = keyed.join(again, keyed["page_id"].eqNullSafe(again["_page"]) & (keyed["key"] == again["_key"]), "left")
    return saved(met.select("page_id", "url", "html", "refers_to").mapInPandas(_writer(folder, roll), MANIFEST))


def _spread(files: DataFrame) -> DataFrame:
    """One task per file, as far as there are tasks: the listing is tiny, the work behind each row is not."""
    return files.repartition(max(1, min(100_000, files.count())))


def _normaliser(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    attempt = TaskContext.get().taskAttemptId()
    for batch in batches:
        for path in batch["path"]:
            fs, at = _open(path)
            made, n, offset = path.removesuffix(".warc.gz") + f"-{attempt}", 0, 0
            to = at.removesuffix(".warc.gz") + f"-{attempt}"
            with fs.open_input_stream(at, compression=None) as raw, fs.open_output_stream(f"{to}.members.warc.gz", compression=None) as out, \
                    fs.open_output_stream(f"{to}.index.jsonl") as index:
                for one in split_records(inflate(raw)):
                    member = gzip.compress(one, LEVEL, mtime=0)
                    out.write(member)
                    index.write((json.dumps({"offset": offset, "length": len(member)}) + "\n").encode())
                    offset, n = offset + len(member), n + 1
            yield pd.DataFrame({"path": [f"{made}.members.warc.gz"], "records": [n]})


def normalise(archives: DataFrame) -> DataFrame:
    """Whole-file gzip archives (path) → manifest (path, records) of archives with a member per record, and sidecars."""
    return saved(_spread(archives.select("path")).mapInPandas(_normaliser, MANIFEST))


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lambda s: int(s) if s else None
    for batch in batches:
        for path in batch["path"]:
            fs, at = _open(path)
            with fs.open_input_stream(at.removesuffix(".members.warc.gz") + ".index.jsonl") as index:
                entries = [json.loads(x) for x in index.read().splitlines()]
            with fs.open_input_file(at) as raw:
                for k in range(0, len(entries), 2000):
                    found = []
                    for e in entries[k: k + 2000]:
                        raw.seek(e["offset"])
                        fields, body = parse(gzip.decompress(raw.read(e["length"])))
                        kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest(body.partition(b"\r\n\r\n")[2]) != sha:
                            raise ValueError(f"a payload of {path} differs from its digest")
                        found.append((number(fields["X-Page-Id"]), int(fields["X-Payload-Length"]), sha, kind, number(fields.get("X-Refers-To-Page-Id"))))
                    out = pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(archives: DataFrame) -> DataFrame:
    """Normalised archives (path) → one row per record."""
    return _spread(archives.select("path")).mapInPandas(_reader, READ)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes, normalises and reads back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(normalise(write_archives(pages, folder, least)))
