"""Benchmark decontamination by latent semantic retrieval.

A randomised SVD of the corpus' TF-IDF passages gives a latent space and term weights; windows of
every document whose latent cosine with an item is high are checked by their longest common
subsequence with it, and by its answer. Windows that could not pass that check are not scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import LOWER, byte_table, column, range_hash, shuffle_partitions, slices, small_batches, utf8, words

COLUMN_BITS = 15
COLUMNS = 1 << COLUMN_BITS
BLOCK = 8  # words; windows are whole blocks
PASSAGE = 4  # blocks of a passage of the SVD
PARTS = 32  # row blocks of the sketch
FOLD = LOWER.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        FOLD[_c] = 0x20


@dataclass
class Words:
    """The words of a batch of texts: hashes, each text's first word, and 8-word blocks.

    `block` numbers them with PASSAGE - 1 empty blocks after each text, so a window that begins
    in a text never reaches the next.
    """

    hashes: np.ndarray
    first: np.ndarray
    block: np.ndarray
    block_first: np.ndarray
    block_end: np.ndarray
    blocks: int

    @property
    def cols(self) -> np.ndarray:
        return (self.hashes >> np.uint64(64 - COLUMN_BITS)).astype(np.int32)


def split_words(col: pa.Array) -> Words:
    """Runs of letters and digits, A-Z lower-cased; bytes beyond ASCII count as letters."""
    raw, off = utf8(col)
    raw = FOLD[raw]
    s, e, first = words(raw, off)
    n = first[1:] - first[:-1]
    per_text = -(-n // BLOCK)
    start = np.cumsum(per_text + PASSAGE - 1) - (per_text + PASSAGE - 1)
    inside = np.arange(len(s)) - np.repeat(first[:-1], n)
    return Words(range_hash(raw, s, e, byte_table(3)), first, np.repeat(start, n) + inside // BLOCK, start, start + per_text, int((per_text + PASSAGE - 1).sum()))


def summed(rows: np.ndarray, at: np.ndarray, group: np.ndarray, out: np.ndarray, chunk: int = 1 << 12) -> np.ndarray:
    """Adds up the rows at some places by group, groups in ascending order; a chunk of rows stays in the processor's cache."""
    held = np.empty((min(chunk, len(at)), rows.shape[1]), rows.dtype)
    for lo in range(0, len(at), chunk):
        i, g = at[lo : lo + chunk], group[lo : lo + chunk]
        np.take(rows, i, axis=0, out=held[: len(i)], mode="clip")
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out[g[cut]] += np.add.reduceat(held[: len(i)], cut, axis=0)
    return out


# ------------------------------------------------------------------ the latent space


def _passages(w: Words) -> np.ndarray:
    """The passage of each word: PASSAGE blocks of its text, numbered by their first block."""
    of_text = np.repeat(w.block_first, w.first[1:] - w.first[:-1])
    return of_text + (w.block - of_text) // PASSAGE * PASSAGE


def _frequencies(text_col: str):
    def run(batches):
        df, n = np.zeros(COLUMNS, np.int64), 0
        for batch in slices(batches, (text_col,)):
            w = split_words(column(batch, text_col))
            each = np.unique(_passages(w).astype(np.int64) << COLUMN_BITS | w.cols)  # a term counts once a passage
            df += np.bincount(each & (COLUMNS - 1), minlength=COLUMNS)
            n += int((-(-(w.first[1:] - w.first[:-1]) // (BLOCK * PASSAGE))).sum())
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], names=["col", "n"])

    return run


def _sketch(text_col: str, weight, rank: int, seed: int):
    """This task's part of A'A times a random matrix, in row blocks; A has a row per passage, of length one."""

    def run(batches):
        idf = weight.value
        omega = np.random.default_rng(seed).standard_normal((COLUMNS, rank)).astype(np.float32) * idf[:, None]
        total = np.zeros((COLUMNS, rank), np.float32)
        for batch in slices(batches, (text_col,)):
            w = split_words(column(batch, text_col))
            if not len(w.hashes):
                continue
            passage, cols = _passages(w), w.cols
            number = np.cumsum(np.concatenate([[0], passage[1:] != passage[:-1]]))
            y = summed(omega, cols, number, np.zeros((int(number[-1]) + 1, rank), np.float32))
            norm = np.bincount(number, idf[cols].astype(np.float64) ** 2)
            y /= np.maximum(norm, 1e-9).astype(np.float32)[:, None]
            order = np.argsort(cols.astype(np.uint16), kind="stable")  # a radix sort
            summed(y, number[order], cols[order], total)
        total *= idf[:, None]
        rows = COLUMNS // PARTS
        for i in range(PARTS):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i * rows : (i + 1) * rows].tobytes()], pa.binary())], names=["part", "data"])

    return run


def _add(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(column(batch, "part").to_pylist(), column(batch, "data").to_pylist(), strict=True):
            new = np.frombuffer(data, np.float32)
            held[i] = held[i] + new if i in held else new.astype(np.float64)
    for i, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["part", "data"])


@dataclass
class LatentSpace:
    idf: np.ndarray
    basis: np.ndarray


def fit_space(docs: DataFrame, text_col: str = "text", rank: int = 64, sharpness: float = 1.0, seed: int = 11) -> LatentSpace:
    """A randomised SVD of the TF-IDF matrix of all passages, over hashed terms.

    The range of A'A is sampled by a Gaussian matrix in one pass and its left singular vectors are
    the basis. Idf counts the passages that have a term in each of the 2**15 columns against all
    passages; `sharpness` raises it to a power. Sketch and basis are 2**15 rows whatever the corpus,
    summed by tasks, then by row blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(text_col)
    found = rows.mapInArrow(_frequencies(text_col), "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).collect()  # 2**15 + 1 at most
    df, n = np.zeros(COLUMNS), 0
    for r in found:
        if r["col"] < 0:
            n = r["n"]
        else:
            df[r["col"]] = r["n"]
    idf = (np.log(np.maximum((n + 1) / (df + 1), 1.1)) ** sharpness).astype(np.float32)
    idf /= max(float(idf.max()), 1e-9)
    weight = spark.sparkContext.broadcast(idf)
    parts = rows.mapInArrow(_sketch(text_col, weight, rank, seed), "part int, data binary").repartition(min(PARTS, shuffle_partitions(spark)), "part").mapInArrow(_add, "part int, data binary").collect()  # 2**15 rows
    sketch = np.zeros((COLUMNS, rank), np.float32)
    size = COLUMNS // PARTS
    for r in parts:
        sketch[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["data"], np.float32).reshape(size, rank)
    u, s, _ = np.linalg.svd(sketch.astype(np.float64), full_matrices=False)
    return LatentSpace(idf, np.ascontiguousarray(u[:, s > s[0] * 1e-6] if s[0] > 0 else u, np.float32))


# ---------------------------------------------------------------------------- checks


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit of an integer per element of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """The benchmark: ids, word hashes, first word of the answer, latent vectors, which columns each
    item's words have, and anchors: sorted word hashes with the item and the place there of each."""

    ids: list
    words: list[list[int]]
    answer: list[int]
    vectors: np.ndarray
    member: np.ndarray
    keys: np.ndarray
    anchor_item: np.ndarray
    anchor_at: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.words), np.int64, len(self.words))


def _latent(hashes: np.ndarray, space: LatentSpace) -> np.ndarray:
    """The unit vector of some words, zero if the space has none of them."""
    cols = (hashes >> np.uint64(64 - COLUMN_BITS)).astype(np.int32)
    v = (space.basis[cols] * space.idf[cols][:, None]).sum(axis=0, dtype=np.float64)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def prepare_items(rows: list[tuple], space: LatentSpace, min_lcs: float) -> Items:
    """Anchors of each item: the fewest of its rarest words, all their places in it, that are more
    than a common subsequence of `min_lcs` of the item can leave out. So every such subsequence
    has an anchor in it, wherever in the item its words are.

    The answer is what follows the last sentence end before the text's last word.
    """
    texts_ = pa.array([t for _, t in rows], pa.string())
    w = split_words(texts_)
    hashes = [w.hashes[a:b].tolist() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    answer = []
    for (_, text), own in zip(rows, hashes, strict=True):
        body = text.rstrip(" \t\r\n.!?;:\"')")
        cut = max(body.rfind(c) for c in ".!?\n") + 1
        tail = split_words(pa.array([body[cut:]], pa.string()))
        answer.append(max(0, len(own) - len(tail.hashes)))
    keys, anchor_item, anchor_at = [], [], []
    vectors = np.zeros((len(rows), space.basis.shape[1]))
    member = np.zeros((len(rows), COLUMNS // 8), np.uint8)
    for i, own in enumerate(hashes):
        part = np.asarray(own, np.uint64)
        c = (part >> np.uint64(64 - COLUMN_BITS)).astype(np.int64)
        np.bitwise_or.at(member[i], c // 8, (1 << c % 8).astype(np.uint8))
        vectors[i] = _latent(part, space)
        order = np.lexsort((part, -space.idf[c]))  # the places of a word stay together
        kept = len(own) - min(len(own), _least(min_lcs, len(own))) + 1
        anchors = order[: min(kept, len(own))]
        keys.append(part[anchors])
        anchor_item.append(np.full(len(anchors), i))
        anchor_at.append(anchors)
    flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    return Items([i for i, _ in rows], hashes, answer, vectors, member, flat[order], np.concatenate([*anchor_item, np.zeros(0, np.int64)])[order].astype(np.int64), np.concatenate([*anchor_at, np.zeros(0, np.int64)])[order].astype(np.int64))


def _least(share: float, n: int) -> int:
    """The fewest words that are `share` of n, one at least."""
    return max(1, int(np.ceil(share * n - 1e-9)))


def _places(w: Words, items: Items, known: np.ndarray, chunk: int = 1 << 18):
    """Where an item may lie: (text, item, word of the batch at which it would begin), in parts.

    Every word that is an anchor of an item gives a place, so windows slide word by word and those
    without an anchor, which cannot meet the rule, are never looked at.
    """
    at = np.flatnonzero(known[(w.hashes >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(items.keys, w.hashes[at]), np.searchsorted(items.keys, w.hashes[at], side="right")
    at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    text = np.searchsorted(w.first, at, side="right") - 1
    ends = np.cumsum(n)
    begin = 0
    while begin < len(at):
        to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + chunk, side="right")))
        m = n[begin:to]
        which = np.repeat(lo[begin:to] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        yield np.unique(np.stack([np.repeat(text[begin:to], m), items.anchor_item[which], np.repeat(at[begin:to], m) - items.anchor_at[which]]), axis=1)
        begin = to


def _shared_words(cols: np.ndarray, a: np.ndarray, z: np.ndarray, member: np.ndarray, item: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """How many of the words a..z have a column that some word of the item has: no fewer than a
    common subsequence can take."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), chunk):
        s, e, i = a[at : at + chunk], z[at : at + chunk], item[at : at + chunk]
        place = s[:, None] + np.arange(int((e - s).max()))
        c = cols[np.minimum(place, len(cols) - 1)]
        has = (member[i[:, None], c >> 3] >> (c & 7).astype(np.uint8)) & 1
        out[at : at + chunk] = (has.astype(bool) & (place < e[:, None])).sum(axis=1)
    return out


def _cosines(cols: np.ndarray, a: np.ndarray, z: np.ndarray, item: np.ndarray, basis: np.ndarray, vectors: np.ndarray, chunk: int = 1 << 12) -> np.ndarray:
    """The latent cosine of the words a..z with each one's item; 0 for windows that the space knows no word of."""
    out = np.zeros(len(a))
    for at in range(0, len(a), chunk):
        s, n = a[at : at + chunk], np.maximum(z[at : at + chunk] - a[at : at + chunk], 0)
        which = np.repeat(np.arange(len(s)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
        v = summed(basis, cols[place], which, np.zeros((len(s), basis.shape[1]))) if len(place) else np.zeros((len(s), basis.shape[1]))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        out[at : at + chunk] = np.einsum("ij,ij->i", v, vectors[item[at : at + chunk]])
    return out


def _search(text_col: str, shared, min_cosine: float, min_lcs: float, sure_lcs: float, min_answer: float, slack: int = 8):
    def run(batches):
        space, items = shared.value
        sizes, basis = items.sizes, space.basis * space.idf[:, None]
        least = np.fromiter((_least(min_lcs, n) for n in sizes.tolist()), np.int64, len(sizes))
        known = np.zeros(1 << 20, bool)
        known[(items.keys >> np.uint64(44)).astype(np.int64)] = True
        for batch in slices(batches, (text_col,)):
            w = split_words(column(batch, text_col))
            if not len(w.hashes) or not len(items.keys):
                continue
            cols, room = w.cols, np.minimum(slack, sizes // 2)
            best: dict[tuple[int, int], tuple] = {}
            for texts_, items_, begins in _places(w, items, known):
                starts = np.maximum(w.first[texts_], begins - room[items_])
                stops = np.minimum(w.first[texts_ + 1], begins + sizes[items_] + room[items_])
                likely = np.flatnonzero(_shared_words(cols, starts, stops, items.member, items_) >= least[items_])
                texts_, items_, begins, starts, stops = (x[likely] for x in (texts_, items_, begins, starts, stops))
                third = sizes[items_] // 3  # an item may lack its beginning or its end, so windows without either are scored too
                spans = [(begins, begins + sizes[items_]), (begins + third, begins + sizes[items_]), (begins, begins + sizes[items_] - third)]
                cosine = np.max([_cosines(cols, np.maximum(w.first[texts_], a), np.minimum(w.first[texts_ + 1], z), items_, basis, items.vectors) for a, z in spans], axis=0)
                near_ = np.flatnonzero(cosine >= min_cosine)
                near_ = near_[np.lexsort((-cosine[near_], items_[near_], texts_[near_]))]  # an item's likeliest window first
                for text, item, a, b, cos in zip(*(x[near_].tolist() for x in (texts_, items_, starts, stops, cosine)), strict=True):
                    key, own = (text, item), items.words[item]
                    if key in best and best[key][0] == len(own):
                        continue
                    near = w.hashes[a:b].tolist()
                    n = lcs_length(own, near)
                    if n < min_lcs * len(own):
                        continue
                    tail = own[items.answer[item] :]
                    answered = lcs_length(tail, near) >= min_answer * len(tail)
                    if n >= sure_lcs * len(own) or answered:
                        best[key] = max(best.get(key, (0,)), (n, cos, a - int(w.first[text]), b - int(w.first[text]), answered))
            if best:
                keys = sorted(best)
                text, item = [k[0] for k in keys], [k[1] for k in keys]
                n, cos, a, b, answered = zip(*(best[k] for k in keys), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "_row").take(pa.array(text)),
                        pa.array([items.ids[i] for i in item], pa.int64()),
                        pa.array(cos, pa.float64()),
                        pa.array(n, pa.int64()),
                        pa.array([x / len(items.words[i]) for x, i in zip(n, item, strict=True)]),
                        pa.array(answered),
                        pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()),
                    ],
                    names=["_row", "item_id", "cosine", "lcs", "lcs_share", "answered", "word_start", "word_end"],
                )

    return run


HITS = "item_id long, cosine double, lcs long, lcs_share double, answered boolean, word_start long, word_end long"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rank: int = 64,
    min_cosine: float = 0.5,
    min_lcs: float = 0.6,
    sure_lcs: float = 0.8,
    min_answer: float = 0.5,
    items_at_once: int = 20_000,
) -> DataFrame:
    """The benchmark items that documents hold, verbatim, edited or paraphrased; a row per pair.

    Windows of an item's length, whole and without their first or last third, slide over every whole
    text word by word. A place is a candidate if the best latent cosine of its windows with the item is at least
    `min_cosine`. Of these the item leaks if the longest common subsequence of its words with those
    of the window and 8 words on each side (half the item's words, if it has under 16) has at least
    `sure_lcs` of them, or at least `min_lcs` and the answer's words have `min_answer` of theirs there.
    Places without an anchor (`prepare_items`) or with too few of the item's words can't meet
    that rule, so their cosines are not computed. -1 lets every place through to the rule.

    The items are the queries, in blocks of `items_at_once`; the space is fitted to all documents.
    Null and wordless texts on either side match nothing. Items without an id are left out. Rows that
    repeat an id are searched each, and may give its pair again. Either table may be empty. Only
    the named columns are read. Returns the id column and HITS.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    with small_batches(spark):
        space = fit_space(rows, "_text", rank)
    wanted = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    schema = T.StructType([T.StructField("_row", kind), *T._parse_datatype_string(HITS).fields])
    out, block = spark.createDataFrame([], schema), []

    def search(items: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast((space, prepare_items(items, space, min(min_lcs, sure_lcs))))
        return rows.mapInArrow(_search("_text", shared, min_cosine, min_lcs, sure_lcs, min_answer), schema)

    for r in wanted.toLocalIterator():  # a query set, a block at a time
        block.append((r["i"], r["t"]))
        if len(block) == items_at_once:
            out, block = out.unionByName(search(block)), []
    if block:
        out = out.unionByName(search(block))
    return out.withColumnRenamed("_row", id_col)
