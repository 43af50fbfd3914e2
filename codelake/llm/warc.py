"""WARC archives: a deterministic sharded writer with a manifest commit, and a reader that checks digests."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .shared import cut, partitions, table_fs

LEAST = 100
"""Payload bytes from which on an equal payload is stored once and revisited."""
ROLL_BYTES = 1 << 30
"""Compressed bytes after which a shard goes on in its next file."""
SHARD_BYTES = 256 << 20
"""Payload bytes of a shard at most, about: what one task reads and sorts. A shuffle partition is one shard at least."""
DATE = "1970-01-01T00:00:00Z"
"""Date of every record: the pages carry none, and equal input must give equal files."""
CHUNK = 1 << 20

MANIFEST = "shard int, seq int, temp string, name string, records long, bytes long, sha256 string"
RECORD = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _uri(url: str | None, key: int | None) -> str:
    """The target URI; what a header cannot hold is percent-encoded, and a page without one is named by its key."""
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:x-page:{'' if key is None else key}"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha256:{_sha(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _page(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    uri = _uri(url, key)
    headers = [("WARC-Record-ID", _urn(key, uri, digest)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Key", "" if key is None else str(key))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], http + payload)
    target = _uri(refers_url, refers_to)
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to, target, digest)), ("WARC-Refers-To-Target-URI", target), ("X-Refers-To-Key", str(refers_to)), ("Content-Type", "application/http; msgtype=response")]
    return _record("revisit", headers + more, http)


def planned(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(key, url, digest, size, refers_to, refers_url, shard) of each page, without the payloads.

    Equal payloads of LEAST bytes or more refer to the page of the smallest key among them; a null key refers to another
    page but none refers to it. Shards are equal parts of the payloads' bytes (and 512 for each record) in the order of
    keys and digests, from prefix sums: what a task reads, be its pages responses or revisits. There is one for each
    ``SHARD_BYTES``, and for each shuffle partition at least, so they depend on the pages and that number alone.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    slim = cut(pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "warc-pages")
    long = F.col("size") >= LEAST
    first = slim.filter(long & F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("first"), F.min_by("url", "key").alias("first_url"), F.count(F.lit(1)).alias("copies"))
    any_null = slim.filter(long & F.col("key").isNull()).select("digest").distinct().withColumn("null_too", F.lit(True))
    first = cut(first.join(any_null, "digest", "left").filter("copies > 1 or null_too").select("digest", "first", "first_url"), "warc-first")
    linked = slim.join(first, "digest", "left")
    again = F.col("first").isNotNull() & long & ~F.col("key").eqNullSafe(F.col("first"))
    rows = linked.select("key", "url", "digest", "size", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"), (F.col("size") + 512).alias("cost"))
    run = prefix_sums(rows, [F.col("key"), F.col("digest"), F.col("url")], "cost")
    total = slim.agg(F.coalesce(F.sum(F.col("size") + 512), F.lit(1)).alias("total")).withColumn("shards", F.greatest(F.lit(partitions(spark)), F.ceil(F.col("total") / SHARD_BYTES)))
    shard = F.expr("floor(sum_before / total * shards)").cast("int")
    return cut(run.crossJoin(F.broadcast(total)).withColumn("shard", shard).drop("row_before", "sum_before", "total", "shards", "cost"), "warc-plan")  # one row


def _shard_of(starts: list[tuple[int | None, str]]):
    """A pandas UDF of (whether the key is null, key or 0, digest): how many of the sorted ``starts`` are at or before it. Null keys come first."""
    nulls = [d for k, d in starts if k is None]
    at = np.array([k for k, _ in starts if k is not None], np.int64)
    digests = [d for k, d in starts if k is not None]

    def place(null: pd.Series, key: pd.Series, digest: pd.Series) -> pd.Series:
        none, keys = null.to_numpy(), key.to_numpy()
        low, high = np.searchsorted(at, keys, "left"), np.searchsorted(at, keys, "right")
        out = len(nulls) + low
        for i in np.flatnonzero((low < high) & ~none):  # keys at which shards start: their digests decide
            out[i] += bisect_right(digests[low[i] : high[i]], digest.iat[i])
        for i in np.flatnonzero(none):
            out[i] = bisect_right(nulls, digest.iat[i])
        return pd.Series(out.astype(np.int32))

    return F.pandas_udf(place, "int")


def write_warc(pages: DataFrame, out: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record for each page below ``out`` and return the manifest (``MANIFEST``).

    The payloads are dealt once, by the first key and digest of the shards, a shard to a task, and meet what is planned for
    them in sorted order. Records are sorted by key, then digest, within contiguous shards, nulls first; only pages equal in
    both are never parted. Each shard's files roll at ``roll_bytes`` compressed. A task writes under names of its own attempt and reports them in a manifest that Spark commits for the attempt that wins;
    then the files get their names, and what other attempts left is removed. A null payload is empty; a null key has an
    empty key header; no pages give no files.
    """
    spark = pages.sparkSession
    plan = planned(pages, key_col, url_col, payload_col)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    firsts = plan.groupBy("shard").agg(F.min(F.struct("key", "digest")).alias("start")).orderBy("shard").collect()[1:]  # one of each shard
    shard = _shard_of([(r.start.key, r.start.digest) for r in firsts])
    order = ["shard", "key", "digest", "url", "tag"]
    facts = plan.dropDuplicates(["key", "digest", "url"]).select("key", "digest", "url", F.lit(0).alias("tag"), "refers_to", "refers_url", F.lit(None).cast("binary").alias("payload"))
    html = pages.select(F.col(key_col).cast("long").alias("key"), F.sha2(payload, 256).alias("digest"), F.col(url_col).alias("url"), F.lit(1).alias("tag"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), payload.alias("payload"))
    rows = facts.union(html).withColumn("shard", shard(F.col("key").isNull(), F.coalesce("key", F.lit(0)), "digest")).select(*order, "refers_to", "refers_url", "payload")
    rows = rows.repartitionById(max(partitions(spark), len(firsts) + 1), F.col("shard")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = table_fs(out)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done: list[dict] = []
        shard, seq, sink, digest, size, records, temp, refers_to, refers_url = None, 0, None, None, 0, 0, "", None, None

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append({"shard": shard, "seq": seq, "temp": temp, "name": f"{shard:06d}-{seq:05d}.warc.gz", "records": records, "bytes": size, "sha256": digest.hexdigest()})
            sink = None

        def put(data: bytes) -> None:
            nonlocal size
            sink.write(data)
            digest.update(data)
            size += len(data)

        for batch in batches:
            for i in range(len(batch)):
                s, key, sha, url, tag = (batch.column(c)[i].as_py() for c in range(5))
                if not tag:  # what is known of the page that the next rows are
                    refers_to, refers_url = (batch.column(c)[i].as_py() for c in (5, 6))
                    continue
                if sink is None or s != shard or size >= roll_bytes:
                    close()
                    seq, shard = (seq + 1 if s == shard else 0), s
                    temp = f"{shard:06d}-{seq:05d}.{attempt}.tmp"
                    sink, digest, size, records = store.open_output_stream(f"{root}/{temp}", compression=None), hashlib.sha256(), 0, 0
                    put(_record("warcinfo", [("WARC-Record-ID", _urn("info", shard, seq)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                put(_page(key, url, batch.column(7)[i].as_py(), sha, refers_to, refers_url))
                records += 1
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = cut(rows.mapInArrow(run, MANIFEST), "warc-written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = table_fs(out)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{temp}").type != pafs.FileType.NotFound:  # else an earlier attempt renamed it
                    store.move(f"{root}/{temp}", f"{root}/{name}")
            yield batch

    final = cut(manifest.mapInArrow(rename, MANIFEST), "warc-manifest")
    _sweep(spark, out)
    return final


def _sweep(spark: SparkSession, out: str) -> None:
    """Remove what attempts that did not win left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path):
        for f in store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/*.tmp")) or []:
            store.delete(f.getPath(), False)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError where its length or digest is not what it says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{_sha(block)}":
        raise ValueError("a damaged WARC record")
    return headers, block


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a stream of gzip members, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while chunk := stream.read(CHUNK):
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = b""
            if unpack.eof:
                yield parse(b"".join(parts))
                chunk, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def read_warc(manifest: DataFrame, out: str, payloads: bool = True) -> DataFrame:
    """(key, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each response and revisit record.

    Length and digest of a response are those of the payload read; a revisit's are in its headers, its payload is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = table_fs(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and _sha(payload) != digest:
                            raise ValueError("a payload unlike its digest")
                        size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                        number = lambda k: int(headers[k]) if headers.get(k) else None  # noqa: B023, E731
                        rows.append({"key": number("X-Key"), "url": headers["WARC-Target-URI"], "record_type": kind, "payload_bytes": len(payload) if kind == "response" else size, "payload_digest": digest, "refers_to": number("X-Refers-To-Key"), "payload": payload if payloads and kind == "response" else None})
                        held += len(payload) if payloads else 64
                        if held > 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    names = manifest.select("name").repartition(partitions(manifest.sparkSession), "name")
    return names.mapInArrow(run, RECORD)


SCHEMA = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
