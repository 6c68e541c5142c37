"""WARC writer and reader: sorted shards, rolled by compressed size, published by a manifest."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import column, commit_files, open_fs, scratch, shuffle_partitions, slices

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temp string, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, its headers and digests made anew; a revisit has no payload bytes."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {header_safe(url)}"] if url is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_safe(url: str) -> str:
    """A URL that cannot end a header line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def info_record(name: str, date: str) -> bytes:
    block = b"software: gristmill\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nWARC-Block-Digest: sha1:{base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gz(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp, so equal records give equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _writer(out_dir: str, roll_bytes: int, level: int, date: str):
    def run(batches):
        fs, root = open_fs(out_dir)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs.create_dir(f"{root}/_temporary", recursive=True)
        done, seq, out, mark = [], 0, None, (None, None, None)

        def close():
            nonlocal out, seq
            out.close()
            done.append((shard, seq, temp, name, n, size, sha.hexdigest()))
            seq, out = seq + 1, None

        for batch in slices(batches, ("payload",)):
            for page_id, digest, url, payload, refers_to, revisit in zip(*(column(batch, c).to_pylist() for c in ("page_id", "digest", "url", "payload", "refers_to", "revisit")), strict=True):
                if revisit:
                    mark = (page_id, digest, refers_to)
                    continue
                revisit, refers_to = mark[:2] == (page_id, digest), mark[2]
                if out is None:
                    name = f"part-{shard:05d}-{seq:05d}.warc.gz"
                    temp = f"{name}.{attempt}.tmp"
                    out, n, size, sha = fs.open_output_stream(f"{root}/_temporary/{temp}", compression=None), 0, 0, hashlib.sha256()
                    first = gz(info_record(name, date), level)
                    out.write(first)
                    sha.update(first)
                    size += len(first)
                data = gz(record(page_id, url, payload, refers_to, revisit, date), level)
                out.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        if done:
            cols = [pa.array(list(c)) for c in zip(*done, strict=True)]
            cols[0], cols[1] = cols[0].cast(pa.int32()), cols[1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "seq", "temp", "file", "records", "bytes", "sha256"])

    return run


def write_warc(
    pages: DataFrame,
    out_dir: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    roll_bytes: int = 1 << 30,
    level: int = 4,
    date: str = "1970-01-01T00:00:00Z",
    partitions: int | None = None,
    salts: int = 8,
) -> str:
    """Write one WARC record per row into sorted, size-rolled shards under `out_dir`.

    Rows are range-partitioned and sorted by id, then payload digest and URL, so the bytes of every
    file follow from the rows, `partitions` and `roll_bytes`. Of rows with equal payloads of at
    least `min_revisit_bytes` the one with the largest id is the response and the others revisit
    it; several rows that share that largest id are all responses. Shorter payloads are responses.
    The digest groups are counted with partial aggregates and joined, without payloads, over
    `salts` copies of the few repeated digests, so a payload that a third of the rows have does not
    meet in one task. The join's outcome is sorted in just before the rows that it marks, so the
    payloads are shuffled once.

    Null html is an empty payload, a null URL leaves out the target header, a null id leaves out
    the id header and is a response only where no row with an id has its payload. An empty table
    gives a manifest without files. Only the three named columns are read. Each task writes to a
    temporary name of its own; the files of the attempt that Spark accepted are renamed and listed
    in MANIFEST.jsonl, which appears last.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    keys = rows.select("page_id", "digest", F.length("payload").alias("size")).where(F.col("size") >= min_revisit_bytes)
    groups = (
        keys.groupBy("digest", "size")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1 and last is not null")
        .select("digest", "size", "last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    marks = salted.join(groups, ["digest", "size", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("last"))).select("page_id", "digest", F.col("last").alias("refers_to"))
    none = {"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary"), "revisit": F.lit(True)}
    both = rows.withColumns({"refers_to": F.lit(None).cast("long"), "revisit": F.lit(False)}).unionByName(marks.withColumns(none))
    ordered = both.repartitionByRange(partitions or shuffle_partitions(spark), "page_id", "digest").sortWithinPartitions("page_id", "digest", F.desc("revisit"), "url")
    listed = ordered.mapInArrow(_writer(out_dir, roll_bytes, level, date), MANIFEST)
    entries = [r.asDict() for r in listed.collect()]  # one row per file of roll_bytes
    commit_files(spark, out_dir, sorted(entries, key=lambda e: (e["shard"], e["seq"])))
    return out_dir


def members(stream, chunk: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    d, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(d.decompress(data))
            data = d.unused_data
            if d.eof:
                yield b"".join(parts)
                d, parts = zlib.decompressobj(31), []
    if any(parts):
        raise OSError("truncated archive")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise OSError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise OSError(f"block digest of {fields['WARC-Record-ID']} differs")
    return fields, block


def _reader(out_dir: str, with_payload: bool):
    def run(batches):
        fs, root = open_fs(out_dir)
        for batch in batches:
            for name, expected in zip(column(batch, "file").to_pylist(), column(batch, "records").to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.decode().rpartition("Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                            raise OSError(f"payload digest of {fields['WARC-Record-ID']} differs")
                        number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
                        rows.append((number["X-Page-Id"], fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"], number["X-Refers-To-Page-Id"]) + ((payload,) if with_payload else ()))
                        seen, held = seen + 1, held + len(payload) * with_payload
                        if len(rows) >= 4096 or held > 4 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                if seen != expected:
                    raise OSError(f"{name} has {seen} records, its manifest entry {expected}")
                if rows:
                    yield _batch(rows, with_payload)

    return run


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, out_dir: str, with_payload: bool = False) -> DataFrame:
    """The records of all files in the manifest, in any order; digests and counts are verified.

    Files are streamed member by member, one task per file or few files. A revisit has a null
    payload in effect: zero bytes, with the length and digest of the payload it refers to.
    """
    listed = spark.read.schema("file string, records long, bytes long").json(f"{out_dir}/MANIFEST.jsonl")
    spread = listed.repartition(shuffle_partitions(spark), "file")
    return spread.mapInArrow(_reader(out_dir, with_payload), RECORDS + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to a new archive in the shared folder and read it back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, scratch(spark, "warc"), **options))
