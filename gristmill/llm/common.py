"""What the training-data operators share: scratch tables, files, text batches, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a local one where it is unset and Spark is local."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return _local_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used by one call only."""
    return f"{shared_dir(spark)}/gristmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once no result that reads them is needed any more."""
    drop_path(spark, f"{shared_dir(spark)}/gristmill/{spark.sparkContext.applicationId}")


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables nothing reads any more."""
    for path in paths:
        fs, make = hadoop_fs(spark, path)
        fs.delete(make(path), True)


def commit_files(spark: SparkSession, out_dir: str, entries: list[dict]) -> None:
    """Give the files that the finished tasks named their final names, then publish the manifest.

    Every entry has `temp` and `file`. A file without a manifest entry was left by a lost or
    repeated task attempt and goes away with the temporary folder. The manifest appears last, by
    a rename, so that a reader sees either no dataset or a whole one.
    """
    fs, make = hadoop_fs(spark, out_dir)
    for e in entries:
        if not fs.rename(make(f"{out_dir}/_temporary/{e['temp']}"), make(f"{out_dir}/{e['file']}")):
            raise OSError(f"cannot commit {e['temp']} as {e['file']} in {out_dir}")
    own, root = open_fs(out_dir)
    own.create_dir(root, recursive=True)
    body = "".join(json.dumps({k: v for k, v in e.items() if k != "temp"}, sort_keys=True) + "\n" for e in entries)
    with own.open_output_stream(f"{root}/.MANIFEST.jsonl.tmp") as out:
        out.write(body.encode())
    own.move(f"{root}/.MANIFEST.jsonl.tmp", f"{root}/MANIFEST.jsonl")
    fs.delete(make(f"{out_dir}/_temporary"), True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; any scheme that Arrow knows."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """While jobs run inside, Arrow batches of at most `rows` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ------------------------------------------------------------------ text batches


def slices(batches, text_cols: tuple[str, ...], max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each slice take at most max_bytes; one row at least.

    At the end the memory that the task has freed goes back to the system: the worker lives on.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for c in text_cols:
            n = pc.binary_length(batch.column(batch.schema.get_field_index(c)))
            size += pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library and Arrow can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and len + 1 offsets; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()
    col = pc.fill_null(col.cast(kind), b"")
    _, offsets, data = col.buffers()
    width = np.int64 if kind == pa.large_binary() else np.int32
    off = np.frombuffer(offsets, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def texts(col: pa.Array) -> list[str]:
    return ["" if t is None else t for t in col.to_pylist()]


# ------------------------------------------------------------------------ hashes


def byte_table(seed: int) -> np.ndarray:
    """256 fixed odd 64-bit numbers from a splitmix sequence."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(z) | np.uint64(1)


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    z = (z ^ (z >> np.uint64(30))) * MIX_A
    z = (z ^ (z >> np.uint64(27))) * MIX_B
    return z ^ (z >> np.uint64(31))


def _unshift(z: np.ndarray, by: int) -> np.ndarray:
    out = z
    for _ in range(64 // by + 1):
        out = z ^ (out >> np.uint64(by))
    return out


def unmix(z: np.ndarray) -> np.ndarray:
    """What mix made z of."""
    with np.errstate(over="ignore"):
        z = _unshift(z, 31) * np.uint64(pow(int(MIX_B), -1, 1 << 64))
        z = _unshift(z, 27) * np.uint64(pow(int(MIX_A), -1, 1 << 64))
    return _unshift(z, 30)


def window_hash(values: np.ndarray, k: int, factor: int = 6364136223846793005) -> np.ndarray:
    """Polynomial hashes, mod 2**64, of all runs of k values, by doubling; len - k + 1 of them."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    out, have, cur, span, left = None, 0, values.astype(np.uint64), 1, k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, have = cur, span
                else:
                    m = len(values) - (have + span) + 1
                    out = out[:m] * np.uint64(pow(factor, span, 1 << 64)) + cur[have : have + m]
                    have += span
            left >>= 1
            if left:
                m = len(cur) - span
                cur = cur[:m] * np.uint64(pow(factor, span, 1 << 64)) + cur[span : span + m]
                span *= 2
    return mix(out[: len(values) - k + 1])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, [^\\x20\\x09-\\x0D]+ or between the bytes of `space`, and each text's first."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~space[raw]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    cuts = off[(off > 0) & (off < len(raw))]
    start[cuts] = ink[cuts]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    end[cuts - 1] = ink[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def range_hash(raw: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[s:e] for each pair, equal for equal bytes at any place."""
    if not len(s):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(raw)
        up = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[raw] * up[:n], out=total[1:])
        return mix((total[e] - total[s]) * _inverse_powers(n + 1)[s] + (e - s).astype(np.uint64))


_cache: dict[str, np.ndarray] = {}


def _grown(name: str, factor: int, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            out = np.full(size, np.uint64(factor))
            out[0] = 1
            _cache[name] = have = np.cumprod(out)
    return have


def _powers(n: int) -> np.ndarray:
    return _grown("up", 6364136223846793005, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("down", pow(6364136223846793005, -1, 1 << 64), n)
