"""Token-id files: concatenated ids, with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import column, commit_files, open_fs, scratch, shuffle_partitions, slices
from gristmill.llm.tokens import KEEPS_SPACE, encoder

MAGIC = b"GMEF1\n"
SAMPLE = 256  # a select sample for every so many ones
MANIFEST = "shard int, seq int, temp string, temp_index string, file string, index string, docs long, tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(range / n) bits each, with select.

    Low bits are stored as they are, high bits as a unary bit vector whose i-th one stands at
    high(i) + i. `samples` has the place of every SAMPLE-th one.
    """

    def __init__(self, n: int, base: int, bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.base, self.bits, self.low, self.high, self.samples = n, base, bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"", np.zeros(0, np.uint32))
        base = int(values[0])
        rel = (values.astype(np.int64) - base).astype(np.uint64)
        bits = max(0, (int(rel[-1]) // n).bit_length() - 1) if int(rel[-1]) >= n else 0
        ones = (rel >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1, np.uint8)
        flags[ones] = 1
        parts = []
        for at in range(0, n, 8192):  # 8192 * bits is a whole number of bytes
            rows = rel[at : at + 8192, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
            parts.append(np.packbits(rows.astype(np.uint8).ravel(), bitorder="little").tobytes())
        return cls(n, base, bits, b"".join(parts), np.packbits(flags, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The place of the i-th one among the high bits."""
        at = int(self.samples[i // SAMPLE])
        need = i % SAMPLE
        if not need:
            return at
        byte = at // 8
        chunk = np.frombuffer(self.high, np.uint8)
        need += int(ONES[chunk[byte] & ((1 << at % 8) - 1)])
        while True:
            part = np.cumsum(ONES[chunk[byte : byte + 64]], dtype=np.int64)
            k = int(np.searchsorted(part, need, side="right"))
            if k < len(part):
                need -= int(part[k - 1]) if k else 0
                ones = np.flatnonzero(np.unpackbits(chunk[byte + k : byte + k + 1], bitorder="little"))
                return (byte + k) * 8 + int(ones[need])
            need -= int(part[-1])
            byte += 64

    def get(self, i: int) -> int:
        low = 0
        if self.bits:
            at = i * self.bits
            word = int.from_bytes(self.low[at // 8 : (at + self.bits + 7) // 8], "little")
            low = word >> at % 8 & (1 << self.bits) - 1
        return self.base + ((self.select(i) - i) << self.bits | low)

    def range(self, i: int, j: int) -> np.ndarray:
        """Elements i to j - 1, from where select finds the i-th one on; nothing else is decoded."""
        if j <= i:
            return np.zeros(0, np.int64)
        first, last = self.select(i), self.select(j - 1)
        flags = np.unpackbits(np.frombuffer(self.high, np.uint8, last // 8 - first // 8 + 1, first // 8), bitorder="little")
        ones = np.flatnonzero(flags[first % 8 : last - first // 8 * 8 + 1]) + first
        high = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            at, end = i * self.bits, j * self.bits
            rows = np.unpackbits(np.frombuffer(self.low, np.uint8, (end + 7) // 8 - at // 8, at // 8), bitorder="little")[at % 8 :][: end - at].reshape(j - i, self.bits)
            high |= (rows.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return high.astype(np.int64) + self.base

    def dump(self) -> bytes:
        head = struct.pack("<qqqqqq", self.n, self.base, self.bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, base, bits, a, b, c = struct.unpack_from("<qqqqqq", data, at)
        at += 48
        return cls(n, base, bits, data[at : at + a], data[at + a : at + a + b], np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c


def dump_index(lengths: list[int], ids: list[int | None], width: int) -> bytes:
    """Boundaries of the documents and their ids, which ascend after the null ones."""
    bounds = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])
    known = np.asarray([i for i in ids if i is not None], np.int64)
    head = json.dumps({"docs": len(ids), "null_ids": len(ids) - len(known), "id_bytes": width, "tokens": int(bounds[-1])}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + EliasFano.build(bounds).dump() + EliasFano.build(known).dump()


def load_index(data: bytes) -> tuple[dict, EliasFano, EliasFano]:
    if data[: len(MAGIC)] != MAGIC:
        raise OSError("not a token index")
    (n,) = struct.unpack_from("<I", data, len(MAGIC))
    at = len(MAGIC) + 4 + n
    head = json.loads(data[at - n : at])
    bounds, at = EliasFano.load(data, at)
    return head, bounds, EliasFano.load(data, at)[0]


def _writer(path: str, out_dir: str, end_id: int, width: int, roll_tokens: int):
    kind = "<u2" if width == 2 else "<u4"

    def run(batches):
        fs, root = open_fs(out_dir)
        enc, shard, attempt = encoder(path, KEEPS_SPACE), TaskContext.get().partitionId(), uuid.uuid4().hex
        fs.create_dir(f"{root}/_temporary", recursive=True)
        done, seq, out, end = [], 0, None, np.asarray([end_id], kind).tobytes()

        def close():
            nonlocal out, seq
            out.close()
            with fs.open_output_stream(f"{root}/_temporary/{name}.idx.{attempt}", compression=None) as f:
                f.write(dump_index(lengths, docs, width))
            done.append((shard, seq, f"{name}.ids.{attempt}", f"{name}.idx.{attempt}", f"{name}.ids", f"{name}.idx", len(docs), sum(lengths)))
            seq, out = seq + 1, None

        for batch in slices(batches, ("text",), 16 << 20):
            for doc, x in zip(column(batch, "doc_id").to_pylist(), enc.encode(column(batch, "text")), strict=True):
                if out is None:
                    name = f"part-{shard:05d}-{seq:05d}"
                    out, docs, lengths, held = fs.open_output_stream(f"{root}/_temporary/{name}.ids.{attempt}", compression=None, buffer_size=1 << 20), [], [], 0
                out.write(np.frombuffer(x, "<u4").astype(kind).tobytes() + end)
                docs.append(doc)
                lengths.append(len(x) // 4 + 1)
                held += lengths[-1]
                if held >= roll_tokens:
                    close()
        if out is not None:
            close()
        enc.trim()
        if done:
            kinds = [pa.int32(), pa.int32()] + [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return run


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    tokenizer: str,
    end_id: int = 2,
    vocabulary: int = 50_257,
    roll_tokens: int = 1 << 29,
    partitions: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode all texts and write their ids in ascending document order.

    Every shard is an array of 16-bit ids (32-bit where the vocabulary needs them) and an index:
    Elias-Fano boundaries of its documents, and their Elias-Fano coded ids. The manifest, which
    appears last, lists the shards in order with the ids before each.

    Null ids come first. Rows that share an id are ordered by a hash of the text, then the text.
    A null or empty text is the end id alone. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = rows.repartitionByRange(partitions or shuffle_partitions(spark), *order[:2]).sortWithinPartitions(*order)
    listed = ordered.mapInArrow(_writer(tokenizer, out_dir, end_id, 2 if vocabulary <= 1 << 16 else 4, roll_tokens), MANIFEST)
    files, before = [], 0
    for e in sorted((r.asDict() for r in listed.collect()), key=lambda e: (e["shard"], e["seq"])):  # one row per shard file
        files.append({"temp": e["temp"], "file": e["file"], "index": e["index"], "docs": e["docs"], "tokens": e["tokens"], "first_token": before})
        files.append({"temp": e["temp_index"], "file": e["index"]})
        before += e["tokens"]
    commit_files(spark, out_dir, files)
    return out_dir


def _reader(out_dir: str, with_ids: bool):
    def run(batches):
        fs, root = open_fs(out_dir)
        for batch in batches:
            for name, index, first in zip(*(column(batch, c).to_pylist() for c in ("file", "index", "first_token")), strict=True):
                with fs.open_input_stream(f"{root}/{index}", compression=None) as f:
                    head, bounds, known = load_index(f.read())
                kind, width = ("<u2", 2) if head["id_bytes"] == 2 else ("<u4", 4)
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{name}") as f:
                    for at in range(0, head["docs"], SAMPLE):
                        to, nulls = min(at + SAMPLE, head["docs"]), head["null_ids"]
                        cuts = bounds.range(at, to + 1).tolist()
                        ids = [None] * (min(to, nulls) - min(at, nulls)) + known.range(max(at, nulls) - nulls, max(to, nulls) - nulls).tolist()
                        f.seek(cuts[0] * width)
                        block = np.frombuffer(f.read((cuts[-1] - cuts[0]) * width), kind).astype("<u4")
                        for doc, a, b in zip(ids, cuts[:-1], cuts[1:], strict=True):
                            own = block[a - cuts[0] : b - cuts[0]]
                            rows.append((doc, first + a, len(own), zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if with_ids else ()))
                        held += len(block) * with_ids
                        if len(rows) >= 4096 or held > 1 << 20:
                            yield _batch(rows, with_ids)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, with_ids)

    return run


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    names = [x.split()[0] for x in DOCS.split(", ")] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_token_files(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files in the manifest, with its ids if asked for.

    Boundaries and document ids are decoded by select, SAMPLE documents at a time; a file's index stays encoded.
    """
    listed = spark.read.schema("file string, index string, docs long, tokens long, first_token long").json(f"{out_dir}/MANIFEST.jsonl").where("index is not null")
    spread = listed.repartition(shuffle_partitions(spark), "file")
    return spread.mapInArrow(_reader(out_dir, with_ids), DOCS + ", ids array<int>" * with_ids)


def encode_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of `docs` to new files in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, scratch(spark, "tokens"), tokenizer, **options))
