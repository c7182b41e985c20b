"""WARC archives: a deduplicating writer and a reader that salvages damaged files.

Writer: of the records with equal payloads of `min_bytes` or more, the one with the largest
page_id is a response and the others are revisits of it; smaller payloads are always responses.
Each record is its own gzip member; a task closes a file at `roll_bytes` and starts the next, so
no file is larger than one record beyond that. Names depend on the task's partition alone and a
file appears under its name only when complete, so a repeated task replaces its own files.

Reader: each file is read through Spark (binaryFile). A member that does not inflate, or a record
whose header, length or payload digest does not hold, is quarantined: the reader searches for the
next gzip member that begins with a version line (or, in plain files, the next version line), goes
on there and reports the gap in bytes. round_trip() reads metadata only, writes the gaps of its own
archives to a log beside them, and fails if a record is missing rather than leave a page out.

A null html is the empty payload; null urls are written as empty, control characters and spaces in
them percent-encoded. Rows with a null page_id are always responses. Repeated page_ids with equal
payloads are all responses if they hold the largest id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.shared import cut, shared_dir

ROLL_BYTES, LEVEL = 8 << 20, 3
VERSION = b"WARC/1.1\r\n"
PLAN = "page_id bigint, url string, html string, digest string, target bigint"
FILES = "path string, records bigint, bytes bigint"
RECORDS = "file string, offset bigint, length bigint, kind string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, reason string"


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest (base32 SHA-1) and target: the page_id of which a revisit is a copy.

    The largest page_id of each digest is found by partial aggregation on (digest, id) only; pages
    are then joined on digest, where adaptive execution may split a digest that very many pages have.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    sizes = p.select("page_id", "digest", F.octet_length("html").alias("size"))
    winners = sizes.groupBy("digest").agg(F.max("page_id").alias("target"), F.max("size").alias("size"), F.count("*").alias("n"))
    copied = winners.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("digest", "target")
    out = p.join(copied, "digest", "left")
    return out.select("page_id", "url", "html", "digest", F.when(F.col("target") > F.col("page_id"), F.col("target")).alias("target"))


def record(page_id: int | None, url: str | None, payload: bytes, target: int | None, digest: str) -> bytes:
    """One uncompressed record, with an HTTP block if it is a response."""
    head = [
        b"WARC-Type: " + (b"response" if target is None else b"revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(), f"WARC-Payload-Length: {len(payload)}".encode(),
        b"Content-Type: application/http; msgtype=response"
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if target is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{target}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}".encode())
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, compress: bool, roll: int) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        held, size, files, count = [], 0, 0, 0

        def flush() -> pd.DataFrame:
            nonlocal held, size, files, count
            name = f"{root}/part-{ctx.partitionId():06d}-{files:05d}.warc" + ".gz" * compress
            part = f"{root}/_{ctx.taskAttemptId()}-{files}.tmp"
            with store.open_output_stream(part) as f:
                f.write(b"".join(held))
            store.move(part, name)
            row = pd.DataFrame({"path": [name], "records": [count], "bytes": [size]})
            held, size, files, count = [], 0, files + 1, 0
            return row

        for batch in batches:
            for page_id, url, html, sha, target in zip(batch.page_id, batch.url, batch.html, batch.digest, batch.target, strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                raw = record(
                    None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None, html.encode(),
                    None if pd.isna(target) else int(target), digest
                )
                held.append(gzip.compress(raw, LEVEL, mtime=0) if compress else raw)
                size, count = size + len(held[-1]), count + 1
                if size >= roll:
                    yield flush()
        if held:
            yield flush()

    return run


def write(planned: DataFrame, folder: str, compress: bool = True, roll: int = ROLL_BYTES) -> tuple[int, int]:
    """Write the records of plan() below folder; returns the number of files and records."""
    import pyarrow.fs as fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    # a fixed order in each partition gives a repeated task the same files
    done = planned.sortWithinPartitions("page_id", "digest", "url").mapInPandas(_writer(folder, compress, roll), FILES).agg(
        F.count("*"), F.coalesce(F.sum("records"), F.lit(0))
    ).first()
    return done[0], done[1]


_HEADER = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int] | str:
    """The record that starts at `at` and the place after it, or what is wrong with it."""
    if not raw.startswith(b"WARC/1.", at):
        return "no version line"
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        return "header does not end"
    head = {k.lower(): v for k, v in _HEADER.findall(raw[at:stop].replace(b"\r\n", b"\n"))}
    length = head.get(b"content-length", b"")
    if not length.isdigit():
        return "no content length"
    begin, end = stop + 4, stop + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        return "block does not end where its length says"
    block = raw[begin:end]
    blank = block.find(b"\r\n\r\n")
    page, refers = (re.search(rb"urn:page:(\d+)", head.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to"))
    out = {
        "kind": head.get(b"warc-type", b"").decode("latin-1"), "page_id": int(page[1]) if page else None, "url": head.get(b"warc-target-uri", b"").decode("latin-1"),
        "refers_to": int(refers[1]) if refers else None, "payload_bytes": int(
            head.get(b"warc-payload-length", b"-1")
        ), "payload_digest": head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:"), "payload": None,
    }
    if out["kind"] == "response":
        out["payload"] = block[blank + 4 :] if blank >= 0 else block
        if len(out["payload"]) != out["payload_bytes"]:
            return "payload length differs"
        if base64.b32encode(hashlib.sha1(out["payload"]).digest()).decode() != out["payload_digest"]:
            return "payload digest differs"
    return out, end + 4


def member(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """What the gzip member at `at` holds, and its length, 0 if the data end within it."""
    inflate, parts, fed = zlib.decompressobj(31), [], at
    view = memoryview(data)
    while not inflate.eof and fed < len(data):
        piece = view[fed : fed + step]
        parts.append(inflate.decompress(piece))
        fed += len(piece)
    return b"".join(parts), fed - at - len(inflate.unused_data) if inflate.eof else 0


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in file order, and a row of kind 'gap' for each quarantined byte range."""
    gz = data[:2] == b"\x1f\x8b" or data.find(b"\x1f\x8b\x08") >= 0 and not data.startswith(b"WARC/")
    at, bad, why = 0, None, ""

    def gap(end: int) -> dict:
        return {"offset": bad, "length": end - bad, "kind": "gap", "reason": why}

    while at < len(data):
        found, size, problem = None, 0, ""
        if gz:
            try:
                raw, size = member(data, at)
                problem = "" if size else "member is cut off"
            except zlib.error as e:
                problem = str(e)
            if not problem:
                found = parse_record(raw)
                if not isinstance(found, str) and found[1] != len(raw):
                    found = "bytes after the record"
        else:
            found = parse_record(data, at)
            size = 0 if isinstance(found, str) else found[1] - at
        if isinstance(found, tuple):
            if bad is not None:
                yield gap(at)
                bad = None
            yield found[0] | {"offset": at, "length": size}
            at += size
            continue
        if bad is None:
            bad, why = at, problem or found
        at = next_start(data, at + 1, gz)
    if bad is not None:
        yield gap(len(data))


def next_start(data: bytes, at: int, gz: bool) -> int:
    """Where the next member that inflates to a version line, or the next version line, begins."""
    while True:
        at = data.find(b"\x1f\x8b\x08" if gz else b"WARC/1.", at)
        if at < 0:
            return len(data)
        if not gz:
            return at
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 4096], 16).startswith(b"WARC/1."):
                return at
        except zlib.error:
            pass
        at += 1


SCHEMA = pa.schema(
    [(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))]
)


def _reader(keep_payload: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for r in salvage(content.as_buffer().to_pybytes()):
                    rows.append({n: path.as_py() if n == "file" else r.get(n) if keep_payload or n != "payload" else None for n in SCHEMA.names})
                    size += r["length"]
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


def read(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below folder; Spark sends files in batches of bounded bytes, a file whole."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_reader(keep_payload), RECORDS)


def log_gaps(records: DataFrame, path: str) -> int:
    """Write the quarantined byte ranges of read() as JSON lines; returns how many there are."""
    gaps = records.where("kind = 'gap'").select("file", "offset", "length", "reason")
    gaps.write.mode("overwrite").json(path)
    return gaps.count()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, records = write(plan(pages, min_bytes), folder)
    if not files:
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    found = cut(read(spark, folder, keep_payload=False).drop("payload", "url"), "warc-records")
    gaps, kept = log_gaps(found, f"{folder}-gaps"), found.where("kind in ('response', 'revisit')")
    if gaps or kept.count() != records:
        raise RuntimeError(f"{records} records were written to {folder}; {gaps} byte ranges of it do not read, see {folder}-gaps")
    return kept.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
