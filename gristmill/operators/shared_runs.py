"""Runs of words that may matter: a filter of hashes that lets through all runs that do, and few others.

What is counted and compared afterwards are the runs' texts, so two runs of one hash cost time, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.sources.storage import open_fs, scratch, small_batches

#: Runs that a task brings together before it passes them on; bits of the filter for each run.
RUNS, KEYS, BITS = 1 << 19, 1 << 21, 16
#: Bits of a hash that are moved, more than the filter reads; words of texts whose runs one task compares.
HASH, PART = 40, 1 << 20
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of runs that are one word longer."""
    x = (h ^ (h >> np.uint64(29))) * _A + word
    return (x ^ (x >> np.uint64(32))) * _B


@lru_cache(1)
def _bits(paths: tuple[str, ...]) -> tuple[np.ndarray, np.uint64]:
    """The hashes' leading bits as a table of bits, read in parts: the hashes are never held together."""
    found = [dataset.dataset(base, filesystem=fs, format="parquet") for fs, base in map(open_fs, paths)]
    k = min(34, max(10, (BITS * sum(d.count_rows() for d in found)).bit_length()))
    table = np.zeros(1 << (k - 3), np.uint8)
    for d in found:
        for batch in d.to_batches(columns=["h"], batch_size=1 << 16, batch_readahead=1, fragment_readahead=1, use_threads=False):
            if batch.num_rows:
                at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - k))
                byte = (at >> np.uint64(3)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
                table[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (at & np.uint64(7)).astype(np.uint8), first)
    return table, np.uint64(64 - k)


def _seen(h: np.ndarray, paths: tuple[str, ...]) -> np.ndarray:
    table, shift = _bits(paths)
    at = h >> shift
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def flat(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and each one's row; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return col.flatten(), np.repeat(np.arange(len(col)), sizes)


def runs(words: np.ndarray, row: np.ndarray, longest: int, paths: tuple[str, ...], open_from: int, parts: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, the places where a run of n words begins, their hashes: runs shorter than `open_from` are in the filter, and with `parts` all runs in them."""
    h, ok = words.view(np.uint64), np.ones(len(words), bool)
    single = h
    for n in range(1, longest + 1):
        if n > 1:
            if len(h) < 2:
                return
            h = _longer(h[:-1], single[n - 1 :])
            ok = ok[:-1] & ok[1:] & (row[: len(h)] == row[n - 1 :])
        at = np.flatnonzero(ok)
        if n < open_from:
            at = at[_seen(h[at], paths)]
        if parts:
            ok = np.zeros(len(h), bool)
            ok[at] = True
        yield n, at, h[at]


@lru_cache(1)
def _ordinals(path: str) -> np.ndarray:
    """The hashes of all classes in order: a class' place stands for it."""
    fs, base = open_fs(path)
    return np.sort(dataset.dataset(base, filesystem=fs, format="parquet").to_table(columns=["c"], use_threads=False).column(0).to_numpy())


def _packed(values: np.ndarray) -> tuple[int, int, bytes]:
    """The first of ascending numbers, bytes a step, and the steps to the others, byte by byte of all."""
    steps = np.diff(values)
    kind = np.dtype(np.uint32 if not len(steps) or steps.max() < 1 << 32 else np.uint64)
    return int(values[0]), kind.itemsize, steps.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def _unpacked(first: int, width: int, body: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, -1).T).view(f"u{width}").ravel()
    return np.cumsum(np.concatenate([[np.uint64(first)], steps.astype(np.uint64)]), dtype=np.uint64)


def shared(words: DataFrame, longest: int, min_classes: int) -> tuple[str, ...]:
    """Where the hashes are of the runs of `words` (class, words) that at least `min_classes` classes have.

    A run is looked at only if the two runs that are one word shorter are such; so of the long ones, most are never moved.
    Of a run moves HASH bits of its hash and its class' number, as steps between the ascending numbers of a task.
    """
    spark, paths = words.sparkSession, ()
    known = scratch(spark, "classes")
    words.select(F.xxhash64("class").alias("c")).distinct().write.parquet(known)
    total, classes = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0], spark.read.parquet(known).count()
    low = max(classes, 1).bit_length()
    keep, parts = min(HASH, 63 - low), max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)
    cut = np.asarray([(p << (keep + low)) // parts for p in range(parts + 1)], np.uint64)

    for upto in [min(2, longest), *range(3, longest + 1)]:

        def run(batches: Iterator[pa.RecordBatch], paths=paths, upto=upto) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def out() -> pa.RecordBatch:
                values = np.unique(np.concatenate(held))
                ends = np.searchsorted(values, cut)
                made = [(p, *_packed(values[ends[p] : ends[p + 1]])) for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "first", "width", "steps"])

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    of, (found, row) = np.searchsorted(_ordinals(known), part.column(0).to_numpy()).astype(np.uint64), flat(part.column(1))
                    for n, place, h in runs(found.to_numpy(), row, upto, paths, upto if paths else 1):
                        if not paths or n == upto:
                            held.append(((h >> np.uint64(64 - keep)) << np.uint64(low)) | of[row[place]])
                            size += len(h)
                    if size >= KEYS:
                        yield out()
                        held, size = [], 0
            if size:
                yield out()

        def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, held, size = np.zeros(0, np.uint64), [], 0
            for batch in batches:
                for row in range(batch.num_rows):
                    held.append(_unpacked(*(batch.column(i)[row].as_py() for i in range(3))))
                    size += len(held[-1])
                    if size >= max(len(values), KEYS // 4):
                        values, held, size = np.unique(np.concatenate([values, *held])), [], 0
            h, n = np.unique(np.unique(np.concatenate([values, *held])) >> np.uint64(low), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((h[n >= min_classes] << np.uint64(64 - keep)).view(np.int64))], names=["h"])

        path = scratch(spark, "shared-runs")
        met = words.select(F.xxhash64("class").alias("c"), hashed(F.col("words"))).mapInArrow(run, "part int, first long, width int, steps binary")
        found = met.repartitionById(parts, F.col("part")).select("first", "width", "steps").mapInArrow(often, "h long")
        with small_batches(spark):
            found.write.parquet(path)
        paths = (*paths, path)
    return paths


def listed(terms: DataFrame, longest: int) -> tuple[str, ...]:
    """Where the hashes are of the runs `term` of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row = flat(batch.column(0))
            h, made = words.to_numpy().view(np.uint64), []
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(row)))
            for n in range(1, longest + 1):
                at = first[sizes == n]
                x = h[at]
                for i in range(1, n):
                    x = _longer(x, h[at + i])
                made.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(made)).view(np.int64))], names=["h"])

    path = scratch(terms.sparkSession, "listed-runs")
    terms.select(hashed(F.split("term", " "))).mapInArrow(run, "h long").write.parquet(path)  # equal ones do no harm
    return (path,)


def counted(words: DataFrame, keys: list[str], longest: int, paths: tuple[str, ...], each: bool = False) -> DataFrame:
    """The keys, term, n: how often the rows of equal keys have each run that the filter lets through; several rows a run of equal keys.

    With `each` a row of `words` is counted by itself. Without, the filter is that of `shared`, and an empty term counts the
    rows with a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            by = ["_row", *keys, "term"] if each else [*keys, "term"]
            made = table.group_by(by, use_threads=False).aggregate([("n", "sum")])
            yield from made.select([*keys, "term", "n_sum"]).rename_columns([*keys, "term", "n"]).to_batches(1 << 16)

        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text, row = flat(part.column(len(keys)))
                found = flat(part.column(len(keys) + 1))[0].to_numpy()
                for n, place, _ in runs(found, row, longest, paths, longest + 1, not each):
                    term = text.take(pa.array(place)) if n == 1 else pc.binary_join_element_wise(*(text.take(pa.array(place + i)) for i in range(n)), " ")
                    held.append(pa.table([*(part.column(i).take(pa.array(row[place])) for i in range(len(keys))), pa.array(row[place] + rows), term, pa.array(np.ones(len(place), np.int64))], names=[*keys, "_row", "term", "n"]))
                    size += len(place)
                if not each:
                    own = np.unique(row)
                    held.append(pa.table([*(part.column(i).take(pa.array(own)) for i in range(len(keys))), pa.array(own), pa.array([""] * len(own), pa.string()), pa.array(np.ones(len(own), np.int64))], names=[*keys, "_row", "term", "n"]))
                rows += part.num_rows
                if size >= RUNS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    kinds = ", ".join(f"`{k}` {words.schema[k].dataType.simpleString()}" for k in keys)
    return words.select(*keys, "words", hashed(F.col("words"))).mapInArrow(run, f"{kinds}, term string, n long")
