"""Deterministic sharded WARC archives: written, committed by a manifest, and read back.

Pages are sorted by page_id over ranges; a task writes its range as gzip members, one a record, and rolls to the next
file by compressed size. A file is written under a temporary name and renamed when complete; names and bytes depend on
the rows alone, so a task that runs again replaces a file by itself. The manifest is written by Spark's own commit, so
it lists what the tasks that won have written, and readers open only files in it. Headers and digests are made anew
from the payload.

Of records with equal payloads that with the largest page_id is the response and the others revisit it; equality is
found on digest, length and a second hash before the payloads move. The folder can be any that pyarrow's file systems
and Spark both reach.

Defined results: a null html is an empty payload; a null url writes no target; rows with a null page_id and repeated
rows of the largest page_id are responses of their own; other columns, whatever their names, are ignored; no pages give an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, store, tasks_for, tune

MANIFEST_DDL = "name string, records long, bytes long, sha256 string"
RECORD_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
ID = "urn:waymeet:page:"
#: Tasks that read archives, at most; a task reads its files one after another.
READERS = 100_000
#: Folder of files that are not complete.
TEMPORARY = "_tmp"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str) -> str:
    """A url that fits a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed; a revisit (refers_to given) leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(4, f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, prefix: str, roll_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        made: list[tuple] = []
        held: list[bytes] = []
        size = 0

        def roll() -> None:
            nonlocal held, size
            if not held:
                return
            data = b"".join(held)
            name = f"{prefix}-{at.partitionId():05d}-{len(made):05d}.warc.gz"
            temporary = f"{root}/{TEMPORARY}/{name}-{at.taskAttemptId()}"
            with fs.open_output_stream(temporary, compression=None) as f:
                f.write(data)
            fs.move(temporary, f"{root}/{name}")
            made.append((name, len(held), len(data), hashlib.sha256(data).hexdigest()))
            held, size = [], 0

        now, known = None, {}
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("page_id", "is_page", "check", "url", "html", "refers_to"))
            for page_id, is_page, check, url, html, refers_to in zip(*cols, strict=True):
                if page_id != now:
                    now, known = page_id, {}
                if not is_page:
                    known[check] = refers_to
                    continue
                held.append(gzip.compress(record(page_id, url, html, known.get(check), date), level, mtime=0))
                size += len(held[-1])
                if size >= roll_bytes:
                    roll()
        roll()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["name", "records", "bytes", "sha256"])

    return run


def write(pages: DataFrame, folder: str, *, prefix: str = "pages", min_revisit_bytes: int = 0, shards: int | None = None, shard_bytes: int = 16 << 20, roll_bytes: int = 16 << 20, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) under folder; returns the committed manifest.

    shards: ranges of page_id, each written by one task; by default one for every shard_bytes of payload (tasks_for). roll_bytes:
    compressed size at which a task goes on to its next file.
    """
    spark = pages.sparkSession
    tune(spark)
    has = set(pages.columns)
    col = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    rows = pages.select(col("page_id", "long"), col("url", "string"), F.coalesce(col("html", "binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("check", F.xxhash64("html"))
    same = ["digest", "n_bytes", "check"]
    digests = store(rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n_bytes"), "check"), "digests")
    groups = digests.filter(F.col("n_bytes") >= min_revisit_bytes).groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    groups = bounded(store(groups.select(*(F.col(c).alias(f"g_{c}") for c in same), "refers_to"), "payloads"), 80)
    on = [F.col(c) == F.col(f"g_{c}") for c in same]
    revisits = digests.join(groups, on[0] & on[1] & on[2]).filter("page_id < refers_to")
    revisits = store(revisits.select("page_id", "check", "refers_to"), "revisits")

    told = revisits.select("page_id", F.lit(False).alias("is_page"), "check", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "refers_to")
    full = rows.select("page_id", F.lit(True).alias("is_page"), "check", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    if shards is None:
        size = digests.agg(F.sum(F.col("n_bytes") + 500)).first()[0] or 0
        shards = tasks_for(size, shard_bytes)
    # rows of one page_id, or of none, may go to several tasks, but those of one payload stay with what is told of it
    dealt = full.unionByName(told).repartitionByRange(shards, "page_id", "check").sortWithinPartitions("page_id", "is_page", "url", "check")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/{TEMPORARY}", recursive=True)
    dealt.mapInArrow(_write(folder, prefix, roll_bytes, level, date), MANIFEST_DDL).write.parquet(f"{folder}/_manifest")
    fs.delete_dir(f"{root}/{TEMPORARY}")  # with what tasks that were lost, or lost the race, have left
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/_manifest")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one after another."""
    inflate, out = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            out.append(inflate.decompress(chunk))
            if not inflate.eof:
                break
            yield b"".join(out)
            chunk = inflate.unused_data
            inflate, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the last record of an archive is cut off")


def parse(raw: bytes) -> dict:
    """A record as its fields; raises ValueError if it does not agree with its digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda name: (lambda s: int(s) if s else None)(fields.get(name, "").strip("<>").removeprefix(ID))
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


def read(spark: SparkSession, folder: str, *, with_payload: bool = True) -> DataFrame:
    """A row per record of the files in the manifest."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for raw in members(iter(lambda f=f: f.read(1 << 20), b"")):
                        rows.append(parse(raw))
                        if not with_payload:
                            rows[-1]["payload"] = None
                        size += len(raw) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = manifest(spark, folder)
    files = listed.select("name").repartition(max(1, min(listed.count(), READERS)))
    return files.mapInArrow(run, RECORD_DDL)
