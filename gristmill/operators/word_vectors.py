"""Vectors of words and texts from the corpus itself: positive mutual information, factorised.

Words are 64-bit hashes in texts and places in the sorted hashes of the vocabulary (codes) in the matrix. Code c
is row c // G of block c % G; a task has one block of rows and reads what it is multiplied by block by block.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.topics import tokens
from gristmill.sources.filesets import get_text, put_text
from gristmill.sources.storage import open_fs, scratch, written

#: Rows in a block, neighbouring places that one block's task may meet, and entries multiplied at a time.
ROWS, MEETINGS, CHUNK = 1 << 16, 1 << 25, 1 << 15
#: Pairs that a task counts before it passes them on, and words of texts that are given vectors together.
PAIRS, WORDS = 1 << 22, 1 << 22


def _hashed(text: Column, stop: tuple[str, ...]) -> Column:
    return F.transform(tokens(text, stop), lambda w: F.xxhash64(w))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and each one's row; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), sizes)


def _column(path: str, *names: str) -> list[np.ndarray]:
    fs, base = open_fs(path)
    found = dataset.dataset(base, filesystem=fs, format="parquet").to_table(columns=list(names), use_threads=False)
    return [found.column(n).to_numpy() for n in names]


@lru_cache(1)
def _codes(path: str) -> np.ndarray:
    """The hashes of a vocabulary in order, 8 bytes a word."""
    return np.sort(_column(path, "h")[0])


@lru_cache(1)
def _margins(path: str, size: int) -> np.ndarray:
    code, n = _column(path, "code", "n")
    out = np.zeros(size)
    out[code] = n
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _save(path: str, x: np.ndarray) -> None:
    """An array written whole or not at all."""
    fs, base = open_fs(path)
    fs.create_dir(base.rpartition("/")[0], recursive=True)
    temp = f"{base}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as out:
        np.save(out, x)
    fs.move(temp, base)


def _load(path: str) -> np.ndarray:
    fs, base = open_fs(path)
    with fs.open_input_file(base) as f:
        return np.load(f)


def _counted(docs: DataFrame, text_col: str, stop: tuple[str, ...], min_count: int) -> tuple[DataFrame, str]:
    """term, n, h: the words that occur `min_count` times and their hashes; where they are written."""
    counts = docs.select(F.explode(tokens(F.col(text_col), stop)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    path = scratch(docs.sparkSession, "vocabulary")
    counts.where(F.col("n") >= min_count).withColumn("h", F.xxhash64("term")).write.parquet(path)
    return docs.sparkSession.read.schema("term string, n long, h long").parquet(path), path


def _coded(vocabulary: DataFrame, path: str) -> DataFrame:
    """term, n, code of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _codes(path)
        for batch in batches:
            code = np.searchsorted(known, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code)], names=["term", "n", "code"])

    return vocabulary.select("term", "n", "h").mapInArrow(run, "term string, n long, code long")


def _pairs(docs: DataFrame, text_col: str, window: int, stop: tuple[str, ...], path: str) -> DataFrame:
    """a, b, n: how often two words of the vocabulary, as codes, stand near each other, both ways round; several rows a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _codes(path), [], 0
        v = max(len(known), 1)

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            a, b = np.divmod(keys, v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((a, b), (b, a), (n, n))], names=["a", "b", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                words, row = _flat(batch.column(0).slice(at, 256))
                code = np.minimum(np.searchsorted(known, words), v - 1)
                code[known[code] != words if len(known) else slice(None)] = -1
                for d in range(1, window + 1):
                    a, b = code[:-d], code[d:]
                    met = (row[:-d] == row[d:]) & (a >= 0) & (b >= 0)
                    held.append(np.minimum(a[met], b[met]) * v + np.maximum(a[met], b[met]))
                    size += len(held[-1])
                if size >= PAIRS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return docs.select(_hashed(F.col(text_col), stop)).mapInArrow(run, "a long, b long, n long")


def cooccurrence(docs: DataFrame, text_col: str, window: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """a, b, n: how often two words stand at most `window` words apart in a text, both ways round."""
    vocabulary, path = _counted(docs, text_col, stop, 1)
    terms = written(_coded(vocabulary, path), "codes")
    pairs = _pairs(docs, text_col, window, stop, path).groupBy("a", "b").agg(F.sum("n").alias("n"))
    named = lambda c: terms.select(F.col("code").alias(c), F.col("term").alias(f"{c}_term"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select(F.col("a_term").alias("a"), F.col("b_term").alias("b"), "n")


def _matrix(pairs: DataFrame, base: str, blocks: int, height: int) -> DataFrame:
    """code, n: the sums of the matrix' rows. Each block's entries are written to `base`: keys (block of b, row of a, row of b) in order, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held, size, block = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, None

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip((keys, n), *held, strict=True)))

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            block = int(a[0] % blocks)
            held.append((((b % blocks) * height + a // blocks) * height + b // blocks, batch.column(2).to_numpy()))
            size += len(a)
            if size >= max(len(keys), 1 << 20):
                keys, n = merged()
                held, size = [], 0
        if block is None:
            return
        keys, n = merged()
        _save(f"{base}/keys-{block}", keys)
        _save(f"{base}/n-{block}", n)
        of = np.bincount(keys // height % height, weights=n, minlength=height)
        row = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array(row * blocks + block), pa.array(of[row])], names=["code", "n"])

    part = F.pmod("a", F.lit(blocks)).cast("int")
    return pairs.repartitionById(blocks, part).mapInArrow(run, "code long, n double")


def _blockwise(spark: SparkSession, blocks: int, k: int, make) -> np.ndarray:
    """The sum of the k by k matrices that `make` has of each block; k * k numbers a task, as many in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for block in batch.column(0).to_pylist():
                total += make(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "x"])

    out = np.zeros(k * k)
    for r in spark.range(0, blocks, 1, blocks).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out.reshape(k, k)


def _multiply(base: str, block: int, blocks: int, height: int, k: int, of: np.ndarray, total: float, x: str) -> np.ndarray:
    """A block of rows of the matrix of positive mutual information times the rows of `x`."""
    keys, n, out = _load(f"{base}/keys-{block}"), _load(f"{base}/n-{block}"), np.zeros((height, k))
    ends = np.searchsorted(keys, np.arange(blocks + 1) * height * height)
    for other in range(blocks):
        if ends[other] == ends[other + 1]:
            continue
        rows = _load(f"{base}/{x}-{other}")
        for lo in range(ends[other], ends[other + 1], CHUNK):
            hi = min(lo + CHUNK, ends[other + 1])
            a, b = np.divmod(keys[lo:hi] - other * height * height, height)
            m = np.log(n[lo:hi] * total / (of[a * blocks + block] * of[b * blocks + other]))
            above = m > 0
            a, b, m = a[above], b[above], m[above]
            if len(a):
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                out[a[first]] += np.add.reduceat(m[:, None] * rows[b], first, axis=0)
    return out


def _orthogonal(gram: np.ndarray) -> np.ndarray:
    """What makes columns of these products orthonormal; directions that the matrix does not have become zero."""
    values, axes = np.linalg.eigh(gram)
    keep = values > max(values.max(), 0) * 1e-10
    return axes * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)


@dataclass(frozen=True)
class WordVectors:
    """term, n, v: each word of the vocabulary with its count and vector; `total` counts all of them."""

    words: DataFrame
    dims: int
    total: int

    def embed(self, docs: DataFrame, id_col: str, text_col: str, stop: tuple[str, ...] = (), rare: float = 1e-3) -> DataFrame:
        """id, embedding: the mean of a text's word vectors, of length one; a word's weight is rare / (rare + its share).

        A text without a known word has a vector of zeros. No text or word is moved: a task reads the model past the words of its own texts.
        """
        path = scratch(docs.sparkSession, "word-vectors")
        self.words.select(F.xxhash64("term").alias("h"), (rare / (rare + F.col("n") / self.total)).cast("double").alias("w"), F.col("v").cast("array<float>").alias("v")).write.parquet(path)
        dims = self.dims

        def vectors(found: list[np.ndarray], rows: int) -> np.ndarray:
            """Of texts whose words are `found`: the vectors of all words are read past those that occur."""
            own, at = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            keys, n = np.unique(np.concatenate([r for _, r in found]) * max(len(own), 1) + at, return_counts=True)
            row, at = np.divmod(keys, max(len(own), 1))
            weights, x, out = np.zeros(len(own)), np.zeros((len(own), dims), np.float32), np.zeros((rows, dims))
            fs, base = open_fs(path)
            for part in dataset.dataset(base, filesystem=fs, format="parquet").to_batches(batch_size=ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False) if len(own) else ():
                place = np.minimum(np.searchsorted(own, h := part.column(0).to_numpy()), len(own) - 1)
                there = np.flatnonzero(own[place] == h)
                weights[place[there]] = part.column(1).to_numpy()[there]
                x[place[there]] = part.column(2).flatten().to_numpy().reshape(-1, dims)[there]
            for lo in range(0, len(row), CHUNK):
                r, c = row[lo : lo + CHUNK], at[lo : lo + CHUNK]
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                out[r[first]] += np.add.reduceat((n[lo : lo + CHUNK] * weights[c])[:, None] * x[c], first, axis=0)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(size > 0, size, 1)).astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, found, rows, size = [], [], 0, 0

            def out() -> Iterator[pa.RecordBatch]:
                made, at = vectors(found, rows), 0
                for col in ids:
                    yield pa.RecordBatch.from_arrays([col, pa.FixedSizeListArray.from_arrays(made[at : at + len(col)].ravel(), dims).cast(pa.list_(pa.float32()))], names=[id_col, "embedding"])
                    at += len(col)

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    words, row = _flat(part.column(1))
                    ids.append(part.column(0))
                    found.append((words, row + rows))
                    rows, size = rows + part.num_rows, size + len(words)
                    if size >= WORDS:
                        yield from out()
                        ids, found, rows, size = [], [], 0, 0
            if rows:
                yield from out()

        kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
        return docs.select(F.col(id_col), _hashed(F.col(text_col), stop)).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """term, tv: vectors of terms of one or more words, the means of their words' unit vectors."""
        single = terms.select("term").distinct().select("term", F.explode(F.split("term", " ")).alias("w"))
        found = single.join(self.words.select(F.col("term").alias("w"), unit(F.col("v")).alias("u")), "w")
        return found.groupBy("term").agg(vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("tv"))

    def write(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        fs, base = open_fs(path)
        put_text(fs, f"{base}/model.json", json.dumps({"dims": self.dims, "total": self.total}))

    @staticmethod
    def read(spark: SparkSession, path: str) -> WordVectors:
        fs, base = open_fs(path)
        found = json.loads(get_text(fs, f"{base}/model.json") or "null")
        if found is None:
            raise FileNotFoundError(f"no word vectors in {path}")
        return WordVectors(spark.read.parquet(f"{path}/words"), found["dims"], found["total"])


def unit(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def fit_words(docs: DataFrame, text_col: str, dims: int = 64, window: int = 4, min_count: int = 5, rounds: int = 2, spare: int = 8, seed: int = 7, stop: tuple[str, ...] = ()) -> WordVectors:
    """Vectors of all words that occur `min_count` times, from which words stand near them.

    The matrix of positive mutual information is factorised by a randomised decomposition: a random sign for each
    word and dimension, drawn by a hash, is multiplied by the matrix, made orthonormal and multiplied again,
    `rounds` times; the small matrix that remains gives the leading eigenvectors, scaled by the root of their values.
    A task counts the pairs of its texts, passes them on by block of rows, and multiplies one block, so the matrix is
    nowhere held as a whole; what the driver gets are matrices of dims + spare rows. Null texts count as empty; without
    a word that is frequent enough the vocabulary is empty. The same corpus gives the same vectors, but for rounding.
    """
    spark = docs.sparkSession
    vocabulary, path = _counted(docs, text_col, stop, min_count)
    size, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    zero = F.array(*[F.lit(0.0)] * dims).cast("array<float>")
    if not size:
        return WordVectors(vocabulary.select("term", "n", zero.alias("v")), dims, 0)
    k, base = dims + spare, scratch(spark, "matrix")
    blocks = max(1, min(size, max(spark.sparkContext.defaultParallelism, -(-size // ROWS), total * 2 * window // MEETINGS)))
    height = -(-size // blocks)
    words = written(_coded(vocabulary, path), "codes").withColumn("block", F.pmod("code", F.lit(blocks)).cast("int"))
    edge = scratch(spark, "margins")
    _matrix(_pairs(docs, text_col, window, stop, path), base, blocks, height).write.parquet(edge)
    pairs = spark.read.schema("code long, n double").parquet(edge).agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.array_distinct(F.collect_list(F.pmod("code", F.lit(blocks))))).first()
    entries, there = pairs[0], frozenset(pairs[1])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, block = np.zeros((height, k)), None
        for batch in batches:
            if batch.num_rows:
                code = batch.column(0).to_numpy()
                block = int(code[0] % blocks)
                x[code // blocks] = batch.column(1).flatten().to_numpy().reshape(-1, k)
        if block is not None:
            _save(f"{base}/x0-{block}", x)
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["n"])

    signs = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(F.xxhash64("term", i, F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0))
    words.repartitionById(blocks, F.col("block")).select("code", signs.alias("v")).mapInArrow(first, "n long").agg(F.sum("n")).collect()

    def times(x: str, by: np.ndarray, out: str | None):
        """The block's rows of the matrix times `x` and `by`, and their products with themselves, or those of `x` with them."""

        def make(block: int) -> np.ndarray:
            made = np.zeros((height, k)) if block not in there else _multiply(base, block, blocks, height, k, _margins(edge, blocks * height), entries, x) @ by
            if out is None:
                return (_load(f"{base}/{x}-{block}") @ by).T @ made
            _save(f"{base}/{out}-{block}", made)
            return made.T @ made

        return make

    by = np.eye(k)
    for r in range(rounds + 1):
        by = _orthogonal(_blockwise(spark, blocks, k, times(f"x{r}", by, f"x{r + 1}")))
    values, axes = np.linalg.eigh(_blockwise(spark, blocks, k, times(last := f"x{rounds + 1}", by, None)))
    best = np.argsort(-values, kind="stable")[:dims]
    turn = by @ axes[:, best] * np.sqrt(np.maximum(values[best], 0))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            if batch.num_rows:
                code = batch.column(2).to_numpy()
                x = _load(f"{base}/{last}-{code[0] % blocks}") @ turn if x is None else x
                v = pa.FixedSizeListArray.from_arrays(x[code // blocks].astype(np.float32).ravel(), dims).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v], names=["term", "n", "v"])

    made = words.repartitionById(blocks, F.col("block")).select("term", "n", "code").mapInArrow(turned, "term string, n long, v array<float>")
    return WordVectors(written(made, "words"), dims, int(total))
