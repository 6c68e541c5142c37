"""Removal of repeated byte strings by bucket-pointer refinement.

Positions are put into buckets by their first 24 bytes; buckets that one document alone has are
settled. In what remains each block of documents sorts its positions by the numbers of their own
bucket and of the bucket 24 bytes on, which gives 48-byte buckets, and then by the new numbers of
their own bucket and of that 2 bytes on, which gives 50-byte buckets. Blocks meet by the buckets' names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import byte_table, column, drop_path, give_back, mix, open_fs, scratch, shuffle_partitions, slices, small_batches, utf8, window_hash, write_table

Q = 24  # bytes of an initial bucket
SPLIT_BITS = 32  # a block's number has its split's number above so many bits
LAST = np.int64(2**63 - 1)
PACKED = "bucket int, block long, size long, check long, keys binary, marks binary"
FLAGS = "block long, bucket int, size long, check long, bits binary"
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(raw: np.ndarray, off: np.ndarray, length: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all `length`-byte strings inside texts but those to skip, the anchor of each, and the
    bucket identifiers of all positions.

    The anchor of a string is the leftmost of its 24-byte substrings with the least hash, so equal
    strings have equal anchors at equal places, and about one position in fourteen is an anchor.
    """
    bucket = window_hash(byte_table(5)[raw], Q)
    span = length - Q + 1
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bucket
    low = np.uint64((1 << 30) - 1)
    packed = (bucket & ~low) | np.arange(len(bucket), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    rest = span - width
    least = np.minimum(packed[: len(packed) - rest], packed[rest:]) if rest else packed
    inside = np.ones(n, bool)
    for cut in off[1:-1].tolist():
        inside[max(0, cut - length + 1) : cut] = False
    for i in np.flatnonzero(skip).tolist():
        inside[off[i] : off[i + 1]] = False
    starts = np.flatnonzero(inside)
    return starts, (least[:n][starts] & low).astype(np.int64), bucket


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place among the distinct keys, by a sort, and an entry that has each of these."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return rank, order[new]


def refine(bucket: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the `length`-byte buckets of some positions, and a position in each bucket.

    Numbers start as ranks of the Q-byte buckets. A round sorts positions by the numbers of their own
    bucket and of that at the end of their own, and writes the new numbers over the old ones, where
    the next round, of up to twice the depth, reads them for the positions that point there.
    """
    steps, depth = [], Q
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    needed = [at]
    for step in reversed(steps):
        seen = np.zeros(len(bucket), bool)
        seen[needed[0]] = True
        seen[needed[0] + step] = True
        needed.insert(0, np.flatnonzero(seen))
    number = np.zeros(len(bucket), np.uint32)
    rank, some = dense(bucket[needed[0]])
    number[needed[0]] = rank
    for step, open_ in zip(steps, needed[1:], strict=True):
        rank, some = dense(number[open_].astype(np.uint64) << np.uint64(32) | number[open_ + step])
        number[open_] = rank
    return rank, needed[-1][some]


def names(bucket: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the `length`-byte strings at some positions, equal in all blocks."""
    steps = [*range(0, length - Q, Q), length - Q]
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i, step in enumerate(steps):
            out = mix(out + bucket[at + step] * np.uint64(2 * i + 1))
    return out


class Block:
    """Some documents of an input split: their ids, their bytes end to end, and offsets."""

    def __init__(self, number: int, parts: list[pa.RecordBatch], length: int):
        self.number, self.length = number, length
        self.doc_ids = pa.concat_arrays([column(b, "doc_id") for b in parts])
        bytes_, sizes = zip(*((raw, np.diff(off)) for raw, off in (utf8(column(b, "text")) for b in parts)), strict=True)
        self.raw, self.off = np.concatenate(bytes_), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.ids = pc.fill_null(self.doc_ids, int(LAST)).to_numpy()
        self.copy = np.zeros(len(self.ids), bool)
        self.ranked, rank = np.unique(self.ids, return_inverse=True)
        self.rank = rank.astype(np.int32)
        self.check = int(np.bitwise_xor.reduce(mix(self.ids.astype(np.uint64) + np.arange(len(self.ids), dtype=np.uint64)), initial=np.uint64(0)) >> np.uint64(1))

    def text_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct texts' identifiers, the smallest id of each, and each document's place among them."""
        cuts = self.off.tolist()
        keys = np.fromiter((xxhash.xxh3_64_intdigest(self.raw[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.uint64, len(self.ids))
        return grouped(keys, self.ids, np.minimum)

    def drop_copies(self, least: np.ndarray, place: np.ndarray, smaller: np.ndarray) -> None:
        """Mark the documents whose whole text a document with a smaller id has."""
        self.copy = smaller[place] | (least[place] < self.ids)

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the strings, their anchors, buckets of all positions; copies have no strings."""
        return anchors(self.raw, self.off, self.length, self.copy)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, side="right") - 1

    def anchor_keys(self, anchor: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchor buckets, whether one document has each, or more, the anchors, and their
        places among the buckets."""
        at = np.unique(anchor)
        key, (least, most), place = grouped(bucket[at], self.ids[self.document(at)], np.minimum, np.maximum, flat=False)
        return key, 1 + (least != most).astype(np.uint8), at, place

    def strings(self, shared) -> tuple[np.ndarray, ...]:
        """Strings in unsettled buckets: starts, ranks of the documents' ids, place of each among the
        refined buckets, and the names and least ranks of these. shared(n) has the n buckets' bits."""
        starts, anchor, bucket = self.anchored()
        key, _, at, place = self.anchor_keys(anchor, bucket)
        known = np.zeros(len(bucket), bool)
        known[at] = shared(len(key))[place]
        starts = starts[known[anchor]]
        del anchor, known, place, at
        rank = self.rank[self.document(starts)]
        if not len(starts):
            return starts, rank, rank, np.zeros(0, np.uint64), rank
        number, some = refine(bucket, starts, self.length)
        name = names(bucket, some, self.length)
        least = np.full(len(some), len(self.ranked), np.int32)
        np.minimum.at(least, number, rank)
        order = np.argsort(name)
        where = np.empty(len(order), np.int32)
        where[order] = np.arange(len(order), dtype=np.int32)
        return starts, rank, where[number], name[order], least[order]


def blocks(batches, length: int, block_bytes: int):
    """The documents of a task's split as blocks of at most block_bytes of text, one document at least."""
    split, parts, held, n = TaskContext.get().partitionId() << SPLIT_BITS, [], 0, 0
    for part in slices(batches, ("text",), block_bytes):
        size = pc.sum(pc.binary_length(column(part, "text"))).as_py() or 0
        if parts and held + size > block_bytes:
            yield Block(split + n, parts, length)
            give_back()
            parts, held, n = [], 0, n + 1
        parts.append(part)
        held += size
    if parts:
        yield Block(split + n, parts, length)


def grouped(keys: np.ndarray, values: np.ndarray, *how, flat: bool = True):
    """Distinct keys in order, reductions of their values, and each entry's place among the keys."""
    if not len(keys):
        out = [values for _ in how]
        return keys, out[0] if flat else out, np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    ordered = ordered[first]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    values = values[order]
    del order, new
    out = [f.reduceat(values, first) for f in how]
    return ordered, out[0] if flat else out, place


def pack(block: int, check: int, keys: np.ndarray, marks: np.ndarray, shift: int):
    """Sorted keys and a mark for each, a row per bucket; marks in the fewest bytes."""
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True) if len(keys) else ():
        m = marks[a:b]
        kind = next(k for k in ("<u1", "<u4", "<i8") if m.min() >= 0 and m.max() <= np.iinfo(k).max or k == "<i8")
        rows.append((int(bucket[a]), block, b - a, check, keys[a:b].astype("<u8").tobytes(), m.astype(kind).tobytes()))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])


def meet(rule):
    """Bring the blocks' keys of a bucket together and return a bit for each of them.

    A key is one entry per block, whatever its count. rule(marks, first) gives each group's value
    and a test of a mark against it.
    """

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, *row in zip(*(column(batch, c).to_pylist() for c in ("bucket", "block", "size", "check", "keys", "marks")), strict=True):
                held.setdefault(bucket, []).append(row)
        for bucket in sorted(held):
            rows = held.pop(bucket)
            kinds = {1: "<u1", 4: "<u4", 8: "<i8"}
            keys = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows])
            marks = np.concatenate([np.frombuffer(r[4], kinds[len(r[4]) // r[1]]).astype(np.int64) for r in rows])
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            bits = np.empty(len(keys), bool)
            bits[order] = rule(marks[order], first, group)
            ends = np.cumsum([r[1] for r in rows]).tolist()
            parts = [np.packbits(bits[a:b], bitorder="little").tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(parts, pa.binary())],
                names=[x.split()[0] for x in FLAGS.split(", ")],
            )

    return run


def in_two_documents(marks, first, group):
    return np.add.reduceat(marks, first)[group] >= 2


def in_a_smaller_document(marks, first, group):
    return np.minimum.reduceat(marks, first)[group] < marks


def write_flags(packed: DataFrame, rule, partitions: int, name: str) -> str:
    """The bits of each block, written so that its task finds them: folder split % partitions, sorted."""
    path = scratch(packed.sparkSession, name)
    flags = packed.repartition(partitions, "bucket").mapInArrow(meet(rule), FLAGS).withColumn("grp", F.shiftright("block", SPLIT_BITS) % partitions)
    flags.repartition(partitions, "grp").sortWithinPartitions("grp", "block", "bucket").write.partitionBy("grp").parquet(path)
    return path


def read_flags(path: str, block: int, check: int, partitions: int, expected: int) -> np.ndarray:
    """The bits of one block, for its keys in order."""
    if not expected:
        return np.zeros(0, bool)
    fs, root = open_fs(path)
    table = pads.dataset(f"{root}/grp={(block >> SPLIT_BITS) % partitions}", format="parquet", filesystem=fs).to_table(columns=["block", "bucket", "size", "check", "bits"], filter=pads.field("block") == block).sort_by("bucket")
    sizes = table.column("size").to_pylist()
    if set(table.column("check").to_pylist()) != {check} or sum(sizes) != expected:
        raise RuntimeError(f"input split {block >> SPLIT_BITS} holds other documents than before")
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")[:n] for n, b in zip(sizes, table.column("bits").to_pylist(), strict=True)]).astype(bool)


def is_scan(df: DataFrame) -> bool:
    """Whether a table is read from files as it is, so that its splits are the same each time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return str(plan.nodeName()) == "Project" and plan.children().size() == 1 and str(plan.child().nodeName()).startswith("LogicalRelation") or str(plan.nodeName()).startswith("LogicalRelation")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_bytes: int = 1 << 20) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that a document with a smaller id has too.

    Texts are their UTF-8 bytes; strings never cross documents and are judged on the input. Input
    splits are cut into blocks of at most `block_bytes` of text, one document at least, so a task's
    memory follows neither its split nor the table, only its longest document. A first pass sends the
    identifiers of whole texts around and gets a bit back for each: whether a smaller document has
    it, which settles copies. A second does so for the distinct anchor buckets of each block: whether
    two documents have it. A third for the names of the refined buckets of the strings in those, each
    with the block's smallest id: whether another block has a smaller one. A last one removes. So
    what moves are distinct keys per block, no key, document or group of copies is a hot spot, texts
    are never shuffled, and a lost task is done again alike. A table that is not a plain file scan is
    written first, which fixes its splits. Names have 64 bits.

    A null text is empty. Rows without an id count as larger than all others and as equal among
    themselves; so do rows that share an id: they take nothing from each other. An empty table
    gives no rows. Only the two named columns are read; ids are cast to long. Returns doc_id and
    RESULT; `with_text` adds the kept bytes.
    """
    with small_batches(docs.sparkSession):
        return _remove_repeats(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), length, with_text, block_bytes)


def _remove_repeats(rows: DataFrame, length: int, with_text: bool, block_bytes: int) -> DataFrame:
    spark, own_copy = rows.sparkSession, []
    if not is_scan(rows):
        rows, path = write_table(rows, "repeat-docs")
        own_copy = [path]
    n = shuffle_partitions(spark)
    shift = 64 - max(6, (n - 1).bit_length())

    def copies(batches):
        for block in blocks(batches, length, block_bytes):
            keys, least, _ = block.text_keys()
            yield from pack(block.number, block.check, keys, least, shift)

    copies_path = write_flags(rows.mapInArrow(copies, PACKED), in_a_smaller_document, n, "repeat-copies")

    def originals(batches):
        for block in blocks(batches, length, block_bytes):
            keys, least, place = block.text_keys()
            block.drop_copies(least, place, read_flags(copies_path, block.number, block.check, n, len(keys)))
            yield block

    def first(batches):
        for block in originals(batches):
            _, anchor, bucket = block.anchored()
            keys, marks, _, _ = block.anchor_keys(anchor, bucket)
            yield from pack(block.number, block.check, keys, marks, shift)

    shared_path = write_flags(rows.mapInArrow(first, PACKED), in_two_documents, n, "repeat-anchors")

    def refined(batches):
        for block in originals(batches):
            yield block, *block.strings(lambda size, block=block: read_flags(shared_path, block.number, block.check, n, size))

    def second(batches):
        for block, _, _, _, name, least in refined(batches):
            yield from pack(block.number, block.check, name, block.ranked[least], shift)

    smaller_path = write_flags(rows.mapInArrow(second, PACKED), in_a_smaller_document, n, "repeat-strings")

    def third(batches):
        for block, starts, rank, place, name, least in refined(batches):
            raw, off = block.raw, block.off
            smaller = read_flags(smaller_path, block.number, block.check, n, len(name))
            hit = starts[smaller[place] | (least[place] < rank)]
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for i in np.flatnonzero(block.copy & (off[1:] - off[:-1] >= length)).tolist():
                gone[off[i] : off[i + 1]] = True
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            cuts = off[(off > 0) & (off < len(raw))]
            begins[cuts] = gone[cuts]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
            kept = [raw[a:b].tobytes() if removed[a] == removed[b] else raw[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            cols = [block.doc_ids, pa.array(off[1:] - off[:-1]), pa.array(removed[off[1:]] - removed[off[:-1]]), pa.array(spans[off[1:]] - spans[off[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    out, _ = write_table(rows.mapInArrow(third, f"doc_id long, {RESULT}" + ", kept binary" * with_text), "repeat-result")
    drop_path(spark, copies_path, shared_path, smaller_path, *own_copy)
    return out
