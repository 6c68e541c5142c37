"""Sum-of-squares packing: whole documents into as few sequences as possible."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import column, slices
from gristmill.llm.tokens import DROPS_SPACE, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenSequences:
    """Open sequences by residual gap, and where a piece leaves the least sum of squared counts.

    With c[g] sequences of gap g, a piece of n that goes from gap g to g - n changes the sum of c**2 over
    the gaps 1 to size - 1 by 2 * (c[g - n] - c[g]) + 2, and by 1 - 2 * c[g] where it closes the
    sequence. `after` holds 2 * c and -1 at gap 0, `before` the same and a low value where there is no
    sequence, so one subtraction ranks all gaps; among equals the smallest gap is taken.
    """

    NONE = -(1 << 30)

    def __init__(self, size: int):
        self.size, self.opened = size, 0
        self.after = np.zeros(size + 1, np.int32)
        self.after[0] = -1
        self.before = np.full(size + 1, self.NONE, np.int32)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]
        self.buffer = np.empty(size + 1, np.int32)

    def _count(self, gap: int) -> None:
        n = 2 * len(self.stacks[gap])
        self.after[gap], self.before[gap] = n, n or self.NONE

    def place(self, n: int) -> tuple[int, int]:
        """The sequence and the offset in it for a piece of n; a new sequence only if none has room."""
        size = self.size
        if n < size:
            change = np.subtract(self.after[: size - n], self.before[n:size], out=self.buffer[: size - n])
            at = int(change.argmin())
            if change[at] < -(self.NONE >> 1):
                gap = at + n
                seq = self.stacks[gap].pop()
                self._count(gap)
                if at:
                    self.stacks[at].append(seq)
                    self._count(at)
                return seq, size - gap
        seq, self.opened = self.opened, self.opened + 1
        if n < size:
            self.stacks[size - n].append(seq)
            self._count(size - n)
        return seq, 0


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences; longer pieces are placed first."""
    seq, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), OpenSequences(size)
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        seq[i], offset[i] = bins.place(n)
    return seq, offset, bins.opened


def _packer(path: str, size: int, end_id: int, block_tokens: int, with_ids: bool, batch_bytes: int, cached: int | None):
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        enc, base, held, rows, ids = encoder(path, DROPS_SPACE, cached), TaskContext.get().partitionId() << 36, 0, [], []

        def emit():
            nonlocal base
            docs, piece, start, length, crc = zip(*rows, strict=True)
            length = np.asarray(length, np.int64)
            seq, offset, opened = pack(length, size)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, k) for x, k in zip((docs, piece, start, length, crc, seq + base, offset), kinds, strict=True)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in ids], pa.list_(pa.int32())))
                names.append("ids")
            base += opened
            out = pa.RecordBatch.from_arrays(arrays, names=names)
            for at in range(0, out.num_rows, 4096):
                yield out.slice(at, 4096)

        for batch in slices(batches, ("text",), batch_bytes):
            for doc, x in zip(column(batch, "doc_id").to_pylist(), enc.encode(column(batch, "text")), strict=True):
                x += tail
                for k, at in enumerate(range(0, len(x), 4 * size)):
                    part = x[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(part)
                held += len(x) // 4
                if held >= block_tokens:
                    yield from emit()
                    held, rows, ids = 0, [], []
        if rows:
            yield from emit()
        enc.trim()

    return run


def pack_best_fit(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 0,
    block_tokens: int = 1 << 24,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 16 << 20,
    cached: int | None = None,
) -> DataFrame:
    """Pack all documents into as few sequences of at most `size` ids as possible, one row per piece.

    A document is its ids and `end_id`; only one of more than `size` ids is cut, into pieces of
    `size` and a shorter last one. Each task packs the documents of its split in blocks of about
    `block_tokens` ids: by descending length, each piece goes where the sum of the squared counts of
    open sequences per residual gap becomes smallest, and opens a sequence only if none has room.
    Nothing is shuffled, and a lost task is packed again alike. A block of some thousand
    documents usually needs the fewest sequences that its ids fit in; there is one such remainder a block.

    A null or empty text is the end id alone; null and repeated ids are kept as they are, each row is
    a document of its own; an empty table gives no rows; equal lengths are placed in input order. Only
    the two named columns are read. With `with_ids` the pieces carry their ids. A task holds 40 bytes for each piece of a
    block (with ids, also these), `batch_bytes` of text and two generations of `cached` words.
    """
    if size < 1:
        raise ValueError("a sequence has at least one id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES + ", ids array<int>" * with_ids
    return rows.mapInArrow(_packer(tokenizer, size, end_id, block_tokens, with_ids, batch_bytes, cached), schema)
