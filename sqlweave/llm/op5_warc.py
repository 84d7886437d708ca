"""Operator 5, deterministic sharded WARC writer and reader.

Records are sorted by (URL, page id) over range shards of about equal bytes.
The bounds come from a hash-chosen sample of keys with a stated bound, so the
same rows give the same files on any cluster. One shuffle brings the payloads to
their shard; a task streams its sorted rows, so it holds one record at a time.
A file is rolled when its compressed size passes a limit. Files are written under
a temporary name and moved into place when complete; a task that runs again
replaces its files with equal ones. The manifest is written after all tasks,
and the reader opens only files that it lists and checks their digests.

Of records with equal payloads of at least 1000 bytes, the one with the
largest page id is the response and the others are revisits without payload.
Revisit marks travel as extra rows sorted just before their record, so the
payloads are shuffled once and a payload with many copies needs no group.

Nulls: a null html is an empty payload, a null URL gives no target field, a row
without page id is never what others refer to. Rows repeated with the
largest page id are all responses. Empty tables write a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load
from sqlweave.session import scratch_path, ship_package, write_table

LEAST_REVISIT = 1000  # bytes of the smallest payload that is revisited
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20  # compressed
SAMPLE = 20_000  # keys that set the shards' bounds
DATE = "2024-01-01T00:00:00Z"


def filesystem(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _record_id(page, digest: str) -> str:
    h = hashlib.sha1(f"{page}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page, url, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One WARC record with fresh headers and digests, as a gzip member."""
    sha = hashlib.sha1(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page, sha.hexdigest())}", f"WARC-Date: {date}"]
    if page is not None:
        head.append(f"Page-Id: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(
            f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to, sha.hexdigest())}",
                 f"Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: {_b32(sha.digest())}",
             f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def shard_bounds(rows: DataFrame, shard_bytes: int, sample: int) -> list[str]:
    """First keys of all shards but the first, from a sample of at most about ``sample`` rows."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.col("payload_bytes") + 512)).first()
    if not n:
        return []
    every = max(1, -(-n // sample))
    picks = sorted((r[0], r[1]) for r in rows.filter(
        F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", F.col("payload_bytes") + 512).collect())
    shards = max(1, min(len(picks), round(size / shard_bytes)))
    share, seen, out = sum(b for _, b in picks) / shards, 0, []
    for key, b in picks:
        if seen >= share * (len(out) + 1) and (not out or key > out[-1]):
            out.append(key)
        seen += b
    return out


class _Files:
    """Writes a shard's records into files of bounded compressed size."""

    def __init__(self, folder: str, shard: int, attempt: str, roll: int):
        self.fs, self.root = filesystem(folder)
        self.shard, self.attempt, self.roll, self.n, self.out, self.done = shard, attempt, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"records-{self.shard:06d}-{self.n:04d}.warc.gz"
            self.part = f"{self.root}/_parts/{self.attempt}-{self.name}"
            self.out, self.size, self.rows, self.sha = self.fs.open_output_stream(self.part, compression=None), 0, 0, hashlib.sha1()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.rows += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            goal = f"{self.root}/{self.name}"
            try:
                self.fs.move(self.part, goal)
            except OSError:  # some stores don't replace
                self.fs.delete_file(goal)
                self.fs.move(self.part, goal)
            self.done.append((self.name, self.shard, self.rows, self.size, self.sha.hexdigest()))
            self.out, self.n = None, self.n + 1


def write_warc(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, sample: int = SAMPLE) -> DataFrame:
    """Write every row as a record under ``folder`` and return the manifest (also saved there)."""
    spark = pages.sparkSession
    ship_package(spark)
    body = F.coalesce(F.col(html), F.lit(""))
    pages = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), body.alias("html"))
    key = F.concat_ws("\u0001", F.coalesce("url", F.lit("")), F.coalesce(F.lpad(F.col("page").cast("string"), 20, "0"), F.lit("")))
    narrow = write_table(pages.select("page", "url", key.alias("key"), F.octet_length("html").cast("long").alias("payload_bytes"),
                                      F.sha1(F.col("html").cast("binary")).alias("digest")), "pages")
    cuts = spark.sparkContext.broadcast(shard_bounds(narrow, shard_bytes, sample))

    @F.pandas_udf("int")
    def shard_of(keys):
        return keys.map(lambda k: bisect_right(cuts.value, k))

    holders = write_table(narrow.filter(F.col("payload_bytes") >= LEAST_REVISIT)
                          .groupBy("digest").agg(F.max("page").alias("holder"), F.count(F.lit(1)).alias("n"))
                          .filter("n > 1 and holder is not null").drop("n"), "holders")
    marks = (narrow.filter(F.col("payload_bytes") >= LEAST_REVISIT).join(holders, "digest")
             .filter(~F.col("page").eqNullSafe(F.col("holder")))
             .select("key", "page", "url", F.lit(None).cast("string").alias("html"), "holder", "digest"))
    rows = pages.select(key.alias("key"), "page", "url", "html", F.lit(None).cast("long").alias("holder"),
                        F.sha1(F.col("html").cast("binary")).alias("digest"))
    both = rows.unionByName(marks).withColumn("shard", shard_of("key"))
    both = (both.repartitionById(max(1, len(cuts.value) + 1), "shard")  # one shard a task
            .sortWithinPartitions("shard", "key", F.col("html").isNotNull(), "digest"))

    def write(batches):
        import uuid
        attempt, files, at, marks = uuid.uuid4().hex, None, None, {}
        fs, root = filesystem(folder)
        fs.create_dir(f"{root}/_parts", recursive=True)
        made = []
        for b in batches:
            for shard, key, page, url, html, holder, digest in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    at, marks = key, {}
                if html is None:
                    marks[digest] = holder
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        made += files.done
                    files = _Files(folder, shard, attempt, roll_bytes)
                files.add(record(page, url, html.encode(), marks.get(digest)))
        if files is not None:
            files.close()
            made += files.done
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(
            (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "shard", "records", "bytes", "sha1"])

    manifest = both.select("shard", "key", "page", "url", "html", "holder", "digest").mapInArrow(
        write, "file string, shard int, records long, bytes long, sha1 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def members(stream, size: int = 1 << 18):
    """Decompressed gzip members of a stream, one after another."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(parts)
                data, z, parts = z.unused_data, zlib.decompressobj(31), []
    if parts:
        raise ValueError("a record is cut off")


def parse(data: bytes) -> dict:
    """Fields of one record; its digests are checked against its bytes."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = block[:int(field["Content-Length"])]
    if _b32(hashlib.sha1(block).digest()) != field["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(field["WARC-Payload-Digest"][5:])
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda k: int(field[k]) if k in field else None
    return {"page_id": number("Page-Id"), "payload_bytes": size, "payload_digest": digest.hex(),
            "record_type": kind, "refers_to": number("Refers-To-Page-Id"), "url": field.get("WARC-Target-URI"),
            "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of all files in the manifest; with ``payloads`` also the responses' bytes."""
    ship_package(spark)
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        fs, root = filesystem(folder)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in members(f):
                        rows.append(parse(data))
                        size += len(data)
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(
        run, schema + ", payload binary" * payloads)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC files, read the files back, one row per record."""
    folder = scratch_path(spark, "warc")
    write_warc(load(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url")


QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT d, max(page_id) AS holder FROM p WHERE octet_length(b) >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h USING (d)
"""}
