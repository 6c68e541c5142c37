"""Cost-balanced packing of tokenized documents into sequences."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import column, slices
from gristmill.llm.tokens import DROPS_SPACE, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, sequence_cost double"


class OpenSequences:
    """Sequences by free room; the cheapest with enough room is found through a tree of minima."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.least: list[tuple[float, int] | None] = [None] * (2 * self.width)

    def _lift(self, room: int) -> None:
        i = self.width + room
        self.least[i] = self.heaps[room][0] if self.heaps[room] else None
        while i > 1:
            i //= 2
            a, b = self.least[2 * i], self.least[2 * i + 1]
            self.least[i] = b if a is None or b is not None and b < a else a

    def put(self, room: int, cost: float, seq: int) -> None:
        heapq.heappush(self.heaps[room], (cost, seq))
        self._lift(room)

    def cheapest(self, need: int) -> tuple[float, int] | None:
        lo, hi, best = self.width + need, 2 * self.width, None
        while lo < hi:
            for i in ([lo] if lo & 1 else []) + ([hi - 1] if hi & 1 else []):
                x = self.least[i]
                best = x if best is None or x is not None and x < best else best
            lo, hi = (lo + 1) // 2, hi // 2
        return best

    def take(self, room: int) -> None:
        heapq.heappop(self.heaps[room])
        self._lift(room)


def pack(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """Pieces (document, start, length, sequence, offset), and each sequence's capacity and cost.

    As many sequences of `size` as the ids fill are opened, and one for each power of two in what
    remains, so every sequence ends up full. Documents of at least `size` fill sequences of their
    own. The rest goes by descending length to the sequence of lowest cost, linear * n + quadratic
    * n**2 summed over its pieces, among those with room. What fits nowhere whole is cut over the
    gaps, cheapest first.
    """
    total = sum(lengths)
    room = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if total % size >> b & 1]
    caps, cost, pieces, at, used = list(room), [0.0] * len(room), [], 0, [0] * len(room)

    def place(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    rest = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= size and at < total // size:
            place(doc, start, size, at)
            start, at = start + size, at + 1
        if n - start:
            rest.append((n - start, doc, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    free, cut = OpenSequences(size), []
    for seq in range(at, len(room)):
        free.put(room[seq], 0.0, seq)
    for n, doc, start in rest:
        got = free.cheapest(n) if n <= size else None
        if got is None:
            cut.append((n, doc, start))
            continue
        seq = got[1]
        free.take(room[seq])
        place(doc, start, n, seq)
        if room[seq]:
            free.put(room[seq], cost[seq], seq)
    gaps = [(cost[s], s) for s in range(at, len(room)) if room[s]]
    heapq.heapify(gaps)
    for n, doc, start in cut:
        while n:
            _, seq = heapq.heappop(gaps)
            m = min(n, room[seq])
            place(doc, start, m, seq)
            n, start = n - m, start + m
            if room[seq]:
                heapq.heappush(gaps, (cost[seq], seq))
    return pieces, caps, cost


def _packer(path: str, size: int, end_id: int, linear: float, quadratic: float, block_tokens: int, with_ids: bool, batch_bytes: int, cached: int | None):
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        enc, base, held, ids, docs = encoder(path, DROPS_SPACE, cached), TaskContext.get().partitionId() << 36, 0, [], []

        def emit():
            nonlocal base
            lengths = [len(x) // 4 for x in ids]
            pieces, caps, cost = pack(lengths, size, linear, quadratic)
            parts = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            d, s, n, q, o = (np.asarray(c, np.int64) for c in zip(*pieces, strict=True))
            arrays = [
                pa.array([docs[i] for i in d], pa.int64()),
                pa.array(s),
                pa.array(n),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array(np.asarray(lengths, np.int64)[d]),
                pa.array(q + base),
                pa.array(o),
                pa.array(np.asarray(caps, np.int64)[q]),
                pa.array(np.asarray(cost)[q]),
            ]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            base += len(caps)
            out = pa.RecordBatch.from_arrays(arrays, names=names)
            for at in range(0, out.num_rows, 4096):
                yield out.slice(at, 4096)

        for batch in slices(batches, ("text",), batch_bytes):
            for doc, x in zip(column(batch, "doc_id").to_pylist(), enc.encode(column(batch, "text")), strict=True):
                ids.append(x + tail)
                docs.append(doc)
                held += len(x) // 4 + 1
                if held >= block_tokens:
                    yield from emit()
                    held, ids, docs = 0, [], []
        if ids:
            yield from emit()
        enc.trim()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_tokens: int = 1 << 22,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 16 << 20,
    cached: int | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most `size` ids, one row per piece.

    Each task packs the documents of its input split in blocks of about `block_tokens` ids, so
    nothing is shuffled, memory is bounded and a lost task is packed again alike. `sequence_id`
    is the split's number and a count in it. The last ids of a block go to sequences of a power of
    two each, which need no padding, so `padded_length` is the filled length everywhere.

    A null or empty text is the end id alone; null and repeated ids are kept as they are and each
    row is a document of its own; an empty table gives no rows. A document of any length is cut
    over as many sequences as it needs. Only the two named columns are read. With `with_ids` the
    pieces carry their ids. A worker encodes `batch_bytes` of text at a time and keeps two generations
    of `cached` words; less of either costs time and saves memory.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES + ", ids array<int>" * with_ids
    return rows.mapInArrow(_packer(tokenizer, size, end_id, linear, quadratic, block_tokens, with_ids, batch_bytes, cached), schema)
