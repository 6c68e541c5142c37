"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import column, drop_path, shuffle_partitions, slices, small_batches, texts, window_hash, write_table
from gristmill.llm.counting import PACKED, KeyCounts, packed_rows, sum_counts

ORDERS = (4, 5)
BUCKET_BITS = 8  # the filter is built in so many parts, by the top bits of an n-gram's hash
SHIFT = 64 - BUCKET_BITS
PROBES = 2
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(batch_texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hashes of the n-grams of each order with the text that each is in; whether texts have letters.

    Texts are lower-cased, every run of other characters than letters is one space, and a space
    stands at both ends.
    """
    padded = [f" {t.lower()} " for t in batch_texts]
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.cumsum(lens) - lens
    keep[starts] = True
    own = np.repeat(np.arange(len(padded), dtype=np.int32), lens)[keep]
    values = np.where(letter, points, 32)[keep].astype(np.uint64)
    has = np.zeros(len(padded), bool)
    has[own[letter[keep]]] = True
    out = []
    for n in ORDERS:
        if len(values) < n:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
            continue
        inside = own[: len(own) - n + 1] == own[n - 1 :]
        out.append(((window_hash(values, n) ^ np.uint64(n))[inside], own[: len(own) - n + 1][inside]))
    return out, has


def rows_of(hashes: np.ndarray, row_bits: int) -> list[np.ndarray]:
    """The filter rows of each hash: its bucket by the top bits, the row in it by other bits."""
    inner = row_bits - BUCKET_BITS
    top = (hashes >> np.uint64(SHIFT)) << np.uint64(inner)
    return [(top | (hashes >> np.uint64(inner * p)) & np.uint64((1 << inner) - 1)).astype(np.int64) for p in range(PROBES)]


@dataclass
class LanguageFilter:
    """table[row, word] has a bit for each language; an n-gram's languages are the AND of its rows.

    `rank` orders the languages by their training n-grams, most first: it decides ties.
    """

    langs: list[str]
    table: np.ndarray
    false_positive: np.ndarray
    rank: np.ndarray
    row_bits: int

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        at = rows_of(hashes, self.row_bits)
        out = self.table[at[0]]
        for rows in at[1:]:
            out = out & self.table[rows]
        return out

    def judge(self, batch_texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, the score of the decision, and the corrected share of the
        text's n-grams that the language has."""
        orders, has = ngrams(batch_texts)
        n = len(batch_texts)
        hits, total = np.zeros((len(self.langs), n)), np.zeros(n)
        for hashes, own in orders:
            total += np.bincount(own, minlength=n)
            masks = self.masks(hashes)
            first = np.searchsorted(own, np.arange(n + 1))
            for i in range(len(self.langs)):
                bits = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                run = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
                hits[i] += run[first[1:]] - run[first[:-1]]
        fp = self.false_positive[:, None]
        share = np.clip((hits / np.maximum(total, 1) - fp) / np.maximum(1 - fp, 1e-9), 0, None)
        best = self.rank[share[self.rank].argmax(axis=0)]
        top, whole = share[best, np.arange(n)], share.sum(axis=0)
        score = np.where(has & (whole > 0), top / np.maximum(whole, 1e-12), 0.0)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, has, strict=True)], score, np.where(has, top, 0.0)


def _count(langs: list[str]):
    index = {v: i for i, v in enumerate(langs)}

    def run(batches):
        held = KeyCounts()
        for batch in slices(batches, ("text",)):
            orders, _ = ngrams(texts(column(batch, "text")))
            group = np.fromiter((index[v] for v in column(batch, "lang").to_pylist()), np.int32, batch.num_rows)
            for hashes, own in orders:
                of = group[own]
                for g in np.unique(group):
                    held.add(int(g), hashes[of == g])
        yield from held.packed(SHIFT)

    return run


def _build(totals: np.ndarray, row_bits: int, ratio: float):
    """The part of the filter of each bucket of n-grams; an n-gram is put in for the languages that have
    it at `ratio` times the rate of the one that has it most."""
    rows, words, size = 1 << (row_bits - BUCKET_BITS), (len(totals) + 63) // 64, np.maximum(totals, 1).astype(float)

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for bucket, grp, keys, counts in packed_rows(batch):
                parts.setdefault(bucket, []).append((grp, keys, counts))
        for bucket in sorted(parts):
            held = parts.pop(bucket)
            every = np.unique(np.concatenate([k for _, k, _ in held]))
            top = np.zeros(len(every))
            for g, k, c in held:
                at = np.searchsorted(every, k)
                top[at] = np.maximum(top[at], c / size[g])
            table = np.zeros((rows, words), np.uint64)
            for g, k, c in held:
                own = k[c / size[g] >= ratio * top[np.searchsorted(every, k)]]
                for at in rows_of(own, row_bits):
                    np.bitwise_or.at(table, (at & (rows - 1), g // 64), np.uint64(1 << g % 64))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([table.astype("<u8").tobytes()], pa.binary())], names=["bucket", "part"])

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_bits: int = 20, most_bits: int = 24, ratio: float = 0.1) -> LanguageFilter:
    """Collect the n-grams of every labelled text and build the filter of all languages.

    An n-gram is put in for the language in which it is most frequent and for all that have it at
    `ratio` times that rate or more; with 0 for all languages that ever had it. Large corpora have
    passages in other languages under every label, so that in the end every language has nearly
    every n-gram once, and popcounts of bare occurrence tell nothing. The filter has eight rows for each n-gram of the language that has most, at least
    2**least_bits and at most 2**most_bits rows of 8 bytes for every 64 languages: that bounds
    what is collected and broadcast, whatever the corpus. Where that is too few, false positives
    grow, and the correction takes them out of the shares. Rows with a null language or null text
    teach nothing; repeated rows teach nothing new.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    langs = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    buckets, n = 1 << BUCKET_BITS, shuffle_partitions(spark)
    words = max(1, (len(langs) + 63) // 64)
    if not langs:
        return LanguageFilter([], np.zeros((1 << least_bits, words), np.uint64), np.zeros(0), np.zeros(0, np.int64), least_bits)
    with small_batches(spark):
        counted, path = write_table(sum_counts(rows.mapInArrow(_count(langs), PACKED), min(buckets, n), SHIFT), "lang-counts")

    def add_up(batches):
        total, distinct = np.zeros(len(langs), np.int64), np.zeros(len(langs), np.int64)
        for batch in batches:
            for _, grp, keys, counts in packed_rows(batch):
                total[grp] += counts.sum()
                distinct[grp] += len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs)), pa.int32()), pa.array(total), pa.array(distinct)], names=["grp", "n", "d"])

    sums = counted.mapInArrow(add_up, "grp int, n long, d long").groupBy("grp").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()  # a row per language
    totals, most = np.zeros(len(langs), np.int64), 1
    for r in sums:
        totals[r["grp"]], most = r["n"], max(most, r["d"])
    row_bits = min(most_bits, max(least_bits, (8 * most - 1).bit_length()))
    spread = counted.repartition(min(buckets, n), "bucket")
    parts = spread.mapInArrow(_build(totals, row_bits, ratio), "bucket int, part binary").collect()  # 2**row_bits rows in all
    table = np.zeros((buckets, 1 << (row_bits - BUCKET_BITS), words), np.uint64)
    for r in parts:
        table[r["bucket"]] = np.frombuffer(r["part"], "<u8").reshape(table.shape[1:])
    table = table.reshape(-1, words)
    drop_path(spark, path)
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return LanguageFilter(langs, table, fill**PROBES, np.argsort(-totals, kind="stable"), row_bits)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", share_out: str | None = None) -> DataFrame:
    """Add the predicted language and its score to every row, whatever its other columns.

    The score is the corrected share of the text's n-grams that the language has, over the sum of
    those shares: 1 where no other language has any. `share_out` adds the share itself, which is low
    where no language fits. Equal shares go to the language with most training n-grams, then the
    first by name. A null text and one without a letter are `und` with score 0. A text with letters
    of which no language has an n-gram takes the language with most, score 0. Repeated rows are
    judged each. Columns named like the outputs are replaced. Without languages to choose from
    every row is `und`. An empty table gives no rows.
    """
    outputs = [(lang_out, T.StringType()), (score_out, T.DoubleType()), *([(share_out, T.DoubleType())] if share_out else [])]
    taken = {n.lower() for n, _ in outputs}
    rows = docs.drop(*(c for c in docs.columns if c.lower() in taken))
    schema = T.StructType(rows.schema.fields + [T.StructField(n, t) for n, t in outputs])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = schema.names

    def run(batches):
        own = shared.value
        for batch in slices(batches, (text_col,)):
            t = texts(column(batch, text_col))
            none = np.zeros(len(t))
            lang, score, share = own.judge(t) if own.langs else ([UNDETERMINED] * len(t), none, none)
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made[: len(outputs)]], names=names)

    return rows.mapInArrow(run, schema)
