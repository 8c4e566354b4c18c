"""Deterministic sharded WARC writer, and its reader.

Records are dealt out by ranges of (page_id, digest) of about equal bytes, sorted
in each range, and written as gzip members; a file is closed once its compressed size
reaches the limit. Headers and digests are made anew from the payload and name
no time or machine, so equal input gives equal files. A task writes under a
temporary name with its own suffix; the manifest of what finished tasks wrote
is saved first, and the names in it are then moved into place, which may be
repeated. What failed attempts left is removed with the temporary folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesledger.llm.common import freeze, shared_dir, small_batches

DATE = "2024-01-01T00:00:00Z"
#: Payloads under this size are always written in full.
REVISIT_BYTES = 100
ROLL_BYTES = 128 << 20
#: A range's bytes, least and most, and the ranges looked for between them.
RANGE_BYTES, RANGES = (4 << 20, 256 << 20), 64
#: Ranges at most, as their first keys go to every task (some 100 bytes each).
MOST_RANGES = 1 << 16
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
FILE = "file string, temporary string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _block(kind: str, headers: dict[str, str], body: bytes) -> bytes:
    head = {"WARC-Type": kind, **headers, "WARC-Block-Digest": "sha256:" + hashlib.sha256(body).hexdigest(), "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; ``first``: the page whose record a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE, "WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response", "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if first is None:
        return _block("response", headers, http + payload)
    return _block("revisit", headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page-Id": str(first)}, http)


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without name or time
    return pack.compress(data) + pack.flush()


def range_target(total: int) -> int:
    """Bytes of a range: from the input's bytes alone, so that equal input gives
    equal files on any cluster; at most ``MOST_RANGES`` ranges come of it."""
    least, most = RANGE_BYTES
    return max(min(most, max(least, total // RANGES)), -(-total // MOST_RANGES))


def range_cuts(rows: DataFrame, target: int) -> list[tuple[bool, int, str]]:
    """Keys (page_id not null, page_id or 0, digest) at which ranges begin, in
    order; ``rows`` has page_id, digest and bytes.

    A range holds the records that begin in one stretch of ``target`` bytes of the
    sorted input, so it is longer than that by one record at most, where keys
    do not repeat. Bytes before a record are summed over sorted partitions of
    about equal rows and over one row per partition.
    """
    key = [F.col("page_id").isNotNull().alias("has_id"), F.coalesce("page_id", F.lit(0).cast("long")).alias("id"), "digest"]
    keyed = rows.select(*key, "bytes")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = freeze(keyed.repartitionByRange(n, "has_id", "id", "digest").withColumn("at", F.spark_partition_id()))
    per_part = dealt.groupBy("at").agg(F.sum("bytes").alias("n"))
    offsets = per_part.select("at", F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("at").orderBy("has_id", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.withColumn("before", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(F.broadcast(offsets), "at")  # a row per partition
    starts = before.groupBy(F.expr(f"(before + offset) div {target}").alias("range")).agg(F.min(F.struct("has_id", "id", "digest")).alias("first"))
    return sorted({tuple(r["first"]) for r in starts.select("first").collect()})[1:]


def _writer(out: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out)
        store.create_dir(f"{base}/_temporary", recursive=True)
        done: list[tuple] = []
        now = None
        part = size = count = 0
        sink = hasher = None
        names = ("", "")

        def close():
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append((*names, count, size, hasher.hexdigest()))
                sink = None

        def emit(data: bytes):
            nonlocal size
            packed = _gzip(data)
            sink.write(packed)
            hasher.update(packed)
            size += len(packed)

        marker: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["page_id"], row["digest"])
                if row["payload"] is None:  # sorted before the page that it speaks of
                    marker = {key: row["first"]}
                    continue
                if row["part"] != now:
                    close()
                    now, part = row["part"], 0
                if sink is not None and size >= roll:
                    close()
                if sink is None:
                    name = f"part-{now:06d}-{part:05d}.warc.gz"
                    names, part, size, count = (name, f"_temporary/{name}.{uuid.uuid4().hex}"), part + 1, 0, 0
                    sink, hasher = store.open_output_stream(f"{base}/{names[1]}", compression=None), hashlib.sha256()
                    emit(_block("warcinfo", {"WARC-Record-ID": record_id(None, name), "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                payload = bytes(row["payload"])
                digest = hashlib.sha256(payload).hexdigest()
                first = marker.get(key)
                emit(response(row["page_id"], row["url"], payload, digest, first))
                count += 1
        close()
        columns = zip(*done, strict=True) if done else ([],) * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["file", "temporary", "records", "bytes", "sha256"])

    return run


def _mover(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out)
        for batch in batches:
            for file, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if store.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{base}/{temporary}", f"{base}/{file}")
            yield batch

    return run


def write_archives(pages: DataFrame, out: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``out``
    and return the manifest (file, records, bytes, sha256), also saved there
    as ``_manifest``.

    A null html is an empty payload, a null url ``urn:page:<page_id>``. Of
    records with equal payloads of ``revisit_bytes`` or more the least page_id
    is a response, the others revisit it; rows that repeat that page_id and
    payload are responses too. Null page_ids never stand for others. Rows with null
    or equal page_ids are dealt out by their payload's digest; those that also
    have equal payloads stay in one range. Other columns are ignored; an empty
    table writes no file.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    narrow = freeze(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")))
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    cuts = range_cuts(narrow, range_target(total))
    equal = freeze(narrow.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n"))
    revisits = narrow.where(F.col("bytes") >= revisit_bytes).join(equal, "digest").where("page_id is null or page_id <> first").select("page_id", "digest", "first").distinct()

    @F.pandas_udf("int")
    def part(ids: pd.Series, digests: pd.Series) -> pd.Series:
        keys = ((not null, 0 if null else int(i), d) for null, i, d in zip(ids.isna(), ids, digests, strict=True))
        return pd.Series([bisect_right(cuts, k) for k in keys], dtype="int32")

    columns = ["page_id", "url", "payload", "digest", "first"]
    both = rows.withColumn("first", F.lit(None).cast("long")).select(*columns).unionByName(revisits.withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")}).select(*columns))
    dealt = both.withColumn("part", part(F.col("page_id").cast("string"), "digest"))
    order = ["part", "page_id", "digest", F.col("payload").isNotNull(), "url"]
    written = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(*order).mapInArrow(_writer(out, roll_bytes), FILE)
    manifest = freeze(written)
    moved = manifest.mapInArrow(_mover(out), FILE).select("file", "records", "bytes", "sha256")
    moved.write.parquet(f"{out}/_manifest")
    store, base = fs.FileSystem.from_uri(out)
    if store.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{base}/_temporary")
    return spark.read.parquet(f"{out}/_manifest")


def records(stream) -> Iterator[bytes]:
    """The gzip members of an open file, one at a time."""
    held, unpack = b"", zlib.decompressobj(31)
    out: list[bytes] = []
    while data := held or stream.read(1 << 20):
        out.append(unpack.decompress(data))
        held = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            out, unpack = [], zlib.decompressobj(31)
    if out:
        raise ValueError("the last record of the archive is cut short")


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload; the digests are verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    if "sha256:" + hashlib.sha256(body).hexdigest() != headers["WARC-Block-Digest"] or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
    http, _, payload = body.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != headers["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {headers.get('WARC-Record-ID')} is damaged")
    return headers, http, payload


LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")


def _reader(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def packed(rows):
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                found: list[tuple] = []
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for record in records(stream):
                        headers, http, _ = parse(record)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        own, first = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id")
                        found.append((int(own) if own else None, int(LENGTH.search(http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"], int(first) if first else None))
                        if len(found) >= 10_000:
                            yield packed(found)
                            found = []
                yield packed(found)

    return run


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """One row per record of the archives that the manifest under ``out``
    names: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.parquet(f"{out}/_manifest").select("file")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.repartition(max(1, files.count())).mapInArrow(_reader(out), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new folder of the shared ones and read it back."""
    out = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, out)
    return read_archives(pages.sparkSession, out)
