"""Quality rules: surface statistics, and perplexity bands of a modified Kneser-Ney model."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import SPACE, byte_table, column, drop_path, mix, open_fs, range_hash, scratch, shuffle_partitions, slices, texts, unmix, utf8, window_hash, words
from gristmill.llm.counting import PACKED, KeyCounts, packed_rows, sum_counts

ORDER = 5
BITS = 12  # 4096 symbols
TOP = ORDER * BITS
SHIFT = 64 - 10  # 1024 buckets of n-grams, by hash
OTHERS = 32  # the first symbol of letters beyond a-z
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_symbol_table: list[np.ndarray] = []
_models: OrderedDict[tuple[str, int], Model] = OrderedDict()


# ------------------------------------------------------------------ base statistics


def base_statistics(col: pa.Array) -> list[np.ndarray]:
    """The five counts of BASE for each text."""
    raw, off = utf8(col)
    n = len(off) - 1
    s, e, first = words(raw, off)
    n_words = first[1:] - first[:-1]

    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[off[1:]] - run[off[:-1]]

    word_chars = per_text(((raw & 0xC0) != 0x80) & ~SPACE[raw])
    symbol = np.zeros(256, bool)
    symbol[SYMBOLS] = True
    n_symbols = per_text(symbol[raw])
    dup = np.fromiter((duplicate_lines(t) for t in texts(col)), np.int64, n)
    return [n_words, word_chars, n_symbols, dup, repeated_words(range_hash(raw, s, e, byte_table(1)), first)]


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    with_word = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(with_word) - len(set(with_word))


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """Words of each text that lie in a window of `width` words found twice or more in that text."""
    n = len(first) - 1
    own = np.repeat(np.arange(n), first[1:] - first[:-1])
    if len(hashes) < width:
        return np.zeros(n, np.int64)
    inside = own[: len(own) - width + 1] == own[width - 1 :]
    at = np.flatnonzero(inside)
    keys = window_hash(hashes, width)[at] ^ window_hash(own[at].astype(np.uint64) + np.uint64(1), 1)
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = at[order[twice]]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


# -------------------------------------------------------------------- symbols, model


def symbol_table() -> np.ndarray:
    """Each code point's symbol: 0 space, 1-26 letters a-z, 27 digit, 28 stop, 29 other; every other letter
    in lower case has one of the symbols from OTHERS on, by a hash of its code point."""
    if not _symbol_table:
        out = np.full(0x110000, 29, np.uint16)
        others = OTHERS + (mix(np.arange(0x110000, dtype=np.uint64)) % np.uint64((1 << BITS) - OTHERS)).astype(np.int64)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                out[i] = 0
            elif c.isalpha():
                low = ord(c.lower()[0])
                out[i] = low - 96 if 97 <= low <= 122 else others[low]
            elif c.isdigit():
                out[i] = 27
            elif c in ".,;:!?":
                out[i] = 28
        _symbol_table.append(out)
    return _symbol_table[0]


def grams(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram code that ends at each symbol of each text, and the text; runs of space are one.

    A text begins after ORDER - 1 spaces and ends with one.
    """
    pad = "\x00" * (ORDER - 1)
    lens = np.fromiter((len(t) + ORDER for t in batch_texts), np.int64, len(batch_texts))
    joined = "".join(f"{pad}{t} " for t in batch_texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sym = symbol_table()[points]
    start = np.cumsum(lens) - lens
    lead = (start[:, None] + np.arange(ORDER - 1)).ravel()
    sym[lead] = 0
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    keep[lead] = True
    own = np.repeat(np.arange(len(batch_texts), dtype=np.int32), lens)[keep]
    sym = sym[keep].astype(np.uint64)
    code = sym[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        code |= sym[ORDER - 1 - k : len(sym) - k] << np.uint64(BITS * k)
    inside = own[: len(own) - ORDER + 1] == own[ORDER - 1 :]
    return code[inside], own[ORDER - 1 :][inside]


class Model:
    """Interpolated modified Kneser-Ney: for each order sorted n-gram codes with their -log2 probabilities,
    and sorted contexts with their back-off weights, also as -log2."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.contexts = grams, contexts

    @property
    def size(self) -> int:
        return sum(x.nbytes for level in (*self.grams, *self.contexts) for x in level)

    def bits(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """-log2 of each n-gram's probability; an unseen one backs off to the next shorter."""
        if order == 0:
            return np.full(len(codes), float(BITS))
        keys, cost = self.grams[order - 1]
        at, found = _find(keys, codes)
        out = np.where(found, cost[at] if len(cost) else 0.0, 0.0)
        miss = np.flatnonzero(~found)
        if len(miss):
            ctx_keys, ctx_cost = self.contexts[order - 1]
            ctx, known = _find(ctx_keys, codes[miss] >> np.uint64(BITS))
            lower = codes[miss] & np.uint64((1 << BITS * (order - 1)) - 1)
            out[miss] = self.bits(lower, order - 1) + np.where(known, ctx_cost[ctx] if len(ctx_cost) else 0.0, 0.0)
        return out


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return at, keys[at] == codes


def fit(codes: np.ndarray, counts: np.ndarray) -> Model:
    """Modified Kneser-Ney from the counts of all 5-grams of one language, sorted by code.

    The highest order uses counts; each lower one the number of distinct symbols seen before the
    n-gram. Discounts for one, two, and three or more follow from the counts of counts. The
    recursion ends in equal probabilities of all symbols.
    """
    levels = [(codes, counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        longer, _ = levels[0]
        shorter, n = np.unique(longer & np.uint64((1 << BITS * order) - 1), return_counts=True)
        levels.insert(0, (shorter, n.astype(np.float64)))
    out, ctxs, lower_keys, lower_p = [], [], None, None
    for order, (keys, c) in enumerate(levels, 1):
        n1, n2, n3, n4 = (float((c == k).sum()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
        cut = np.asarray(d)[np.minimum(c, 3).astype(np.int64)]
        ctx = keys >> np.uint64(BITS)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        total, mass = np.add.reduceat(c, first), np.add.reduceat(cut, first)
        size = np.diff(np.concatenate([first, [len(keys)]]))
        gamma = mass / total
        if lower_p is None:
            below = np.full(len(keys), 1.0 / (1 << BITS))
        else:
            below = lower_p[np.searchsorted(lower_keys, keys & np.uint64((1 << BITS * (order - 1)) - 1))]
        p = (c - cut) / np.repeat(total, size) + np.repeat(gamma, size) * below
        out.append((keys, -np.log2(p)))
        ctxs.append((ctx[first], -np.log2(np.maximum(gamma, 1e-12))))
        lower_keys, lower_p = keys, p
    return Model(out, ctxs)


MODEL_ROWS = "grp int, ord int, what string, keys binary, cost binary"


def _fit_group(key, packed):
    held = KeyCounts()
    for batch in packed.to_batches():
        for _, grp, keys, counts in packed_rows(batch):
            held.add_counts(grp, unmix(keys), counts)
    grp = key[0].as_py()
    model = fit(*held.merged(grp))
    rows = [(grp, i, what, k.astype("<u8").tobytes(), v.astype("<f4").tobytes()) for what, levels in (("gram", model.grams), ("context", model.contexts)) for i, (k, v) in enumerate(levels, 1)]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["grp", "ord", "what", "keys", "cost"])


def load_model(path: str, grp: int, model_bytes: int) -> Model:
    """The model of one language of a written table. The Python worker keeps those used last, together
    of `model_bytes` or a single one, so its memory does not follow the number of languages."""
    if (path, grp) not in _models:
        for old in [k for k in _models if k[0] != path]:
            del _models[old]
        fs, root = open_fs(path)
        levels = {"gram": [None] * ORDER, "context": [None] * ORDER}
        found = pads.dataset(f"{root}/grp={grp}", format="parquet", filesystem=fs).to_table()
        for order, what, keys, cost in zip(*(found.column(c).to_pylist() for c in ("ord", "what", "keys", "cost")), strict=True):
            levels[what][order - 1] = (np.frombuffer(keys, "<u8"), np.frombuffer(cost, "<f4"))
        _models[path, grp] = Model(levels["gram"], levels["context"])
        while len(_models) > 1 and sum(m.size for m in _models.values()) > model_bytes:
            _models.popitem(last=False)
    _models.move_to_end((path, grp))
    return _models[path, grp]


def lines_of(batch: pa.RecordBatch, text_col: str, lang_col: str, index: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lines of a batch's texts, their languages' numbers, and a 64-bit key of language and line."""
    lines, group, keys = [], [], []
    for text, lang in zip(texts(column(batch, text_col)), column(batch, lang_col).to_pylist(), strict=True):
        own, grp = text.split("\n"), index[lang]
        lines += own
        group += [grp] * len(own)
        keys += [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), grp) for x in own]
    return lines, np.asarray(group, np.int32), np.asarray(keys, np.uint64)


def repeated_lines(docs: DataFrame, index: dict, text_col: str, lang_col: str, line_bits: int) -> np.ndarray:
    """A bit for each of 2**line_bits cells, set where a line that occurs again has its key; of fixed size."""
    words = (1 << line_bits) // 64 >> 64 - SHIFT  # of each bucket

    def count(batches):
        held = KeyCounts()
        for batch in slices(batches, (text_col,)):
            held.add(0, lines_of(batch, text_col, lang_col, index)[2])
        yield from held.packed(SHIFT)

    def mark(batches):
        parts: dict[int, KeyCounts] = {}
        for batch in batches:
            for bucket, _, keys, counts in packed_rows(batch):
                parts.setdefault(bucket, KeyCounts()).add_counts(0, keys, counts)
        for bucket, held in parts.items():
            keys, counts = held.merged(0)
            bits, at = np.zeros(words, np.uint64), _line_cell(keys[counts > 1], line_bits) & (words * 64 - 1)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["bucket", "bits"])

    spread = docs.select(text_col, lang_col).mapInArrow(count, PACKED).repartition(shuffle_partitions(docs.sparkSession), "bucket")
    table = np.zeros((1 << 64 - SHIFT, words), np.uint64)
    for r in spread.mapInArrow(mark, "bucket int, bits binary").collect():  # 2**line_bits bits in all
        table[r["bucket"]] = np.frombuffer(r["bits"], np.uint64)
    return table.ravel()


def _line_cell(keys: np.ndarray, line_bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - line_bits)).astype(np.int64)


def train_models(docs: DataFrame, langs: list[str | None], text_col: str, lang_col: str, line_bits: int = 24) -> str:
    """Count the 5-grams of all distinct lines per language, fit a model for each, and return the table's path.

    Lines that occur once are counted where they are. Only those whose cell says that they may occur
    again are brought together to be counted once, so it is repeated lines that move, not texts.
    """
    spark, index = docs.sparkSession, {v: i for i, v in enumerate(langs)}
    shared = spark.sparkContext.broadcast(repeated_lines(docs, index, text_col, lang_col, line_bits))

    def again(keys: np.ndarray) -> np.ndarray:
        at = _line_cell(keys, line_bits)
        return (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def add(held: KeyCounts, lines: list[str], group: np.ndarray) -> None:
        code, own = grams(lines)
        of = group[own]
        for g in np.unique(of):
            held.add(int(g), mix(code[of == g]))

    def count(batches):
        held = KeyCounts()
        for batch in slices(batches, (text_col,)):
            lines, group, keys = lines_of(batch, text_col, lang_col, index)
            once = np.flatnonzero(~again(keys))
            add(held, [lines[i] for i in once.tolist()], group[once])
        yield from held.packed(SHIFT)

    def pick(batches):
        for batch in slices(batches, (text_col,)):
            lines, group, keys = lines_of(batch, text_col, lang_col, index)
            some = np.flatnonzero(again(keys))
            own = {(int(group[i]), lines[i]) for i in some.tolist()}
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in own], pa.int32()), pa.array([x for _, x in own], pa.string())], names=["grp", "line"])

    def count_picked(batches):
        held = KeyCounts()
        for batch in slices(batches, ("line",)):
            add(held, column(batch, "line").to_pylist(), column(batch, "grp").to_numpy())
        yield from held.packed(SHIFT)

    rows = docs.select(text_col, lang_col)
    partial = rows.mapInArrow(count, PACKED).unionByName(rows.mapInArrow(pick, "grp int, line string").distinct().mapInArrow(count_picked, PACKED))
    counted = sum_counts(partial, shuffle_partitions(spark), SHIFT)
    path = scratch(spark, "kneser-ney")
    counted.groupBy("grp").applyInArrow(_fit_group, MODEL_ROWS).write.partitionBy("grp").parquet(path)
    return path


# -------------------------------------------------------------------------- operator


def bands(scored: DataFrame, lang_col: str, below: float, above: float, least: float) -> DataFrame:
    """Per language the median of the bits a symbol and a band of deviations `below` and `above` it.

    The deviation is 1.4826 times the median absolute deviation, `least` bits at least. Each distinct
    text counts once, by `text_hash`, so copies move neither. Bits are counted in steps of 1/256, so a language has a few thousand rows in the end whatever the corpus.
    """
    distinct = scored.where("bits is not null").groupBy(lang_col, "text_hash").agg(F.min("bits").alias("bits"))
    steps = distinct.groupBy(lang_col, F.round(F.col("bits") * 256).cast("long").alias("step")).agg(F.count("*").alias("n"))
    found: dict[str | None, list[tuple[int, int]]] = {}
    for r in steps.collect():  # languages x steps
        found.setdefault(r[lang_col], []).append((r["step"], r["n"]))

    def median(pairs: list[tuple[int, int]]) -> int:
        half, run = sum(n for _, n in pairs) / 2, 0
        for v, n in sorted(pairs):
            run += n
            if run >= half:
                return v
        return 0

    rows = []
    for lang, pairs in found.items():
        mid = median(pairs)
        dev = max(1.4826 * median([(abs(v - mid), n) for v, n in pairs]) / 256, least)
        rows.append((lang, mid / 256 - below * dev, mid / 256 + above * dev))
    return scored.sparkSession.createDataFrame(rows, T.StructType([T.StructField(lang_col, T.StringType()), T.StructField("bits_low", T.DoubleType()), T.StructField("bits_high", T.DoubleType())]))


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    below: float = 4.0,
    above: float = 4.0,
    least: float = 0.05,
    model_bytes: int = 1 << 29,
    line_bits: int = 24,
) -> DataFrame:
    """Count surface statistics of every whole text and decide by rules and perplexity bands.

    A text fails the base rules with fewer than `min_words` words or more than
    `max_repeat_percent` percent of them in repeated 8-word windows. Of the others those go whose
    bits a symbol under their language's model lie outside the language's band; perplexity is two
    to that power. The models count each distinct line of a language once, so neither copies, near
    copies nor passages that many texts share make themselves likely; the bands count each distinct
    text once. The models count texts that fail too. A text's lines are scored apart, as they were counted.

    A null text counts as empty: no words, so it fails. A null language is a language of its own.
    Every row, repeated ones too, is counted and judged by itself. Limits belong to the band. An empty
    table gives no rows. Only the three named columns are read. A worker holds models of
    `model_bytes` together, or a single one; that of a language follows its distinct 5-grams. 2**line_bits
    bits tell the lines that may occur again; fewer move more lines and change no result.

    Returns doc_id, the BASE counts, base_failed, kept, bits, bits_low, bits_high.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    model = train_models(rows.select("text", "lang"), langs, "text", "lang", line_bits)
    index = {v: i for i, v in enumerate(langs)}

    def score(batches):
        for batch in slices(batches, ("text",)):
            col, n = column(batch, "text"), batch.num_rows
            split = [t.split("\n") for t in texts(col)]
            code, line = grams([x for lines in split for x in lines])
            own = np.repeat(np.arange(n), [len(lines) for lines in split])[line]
            group = np.fromiter((index[v] for v in column(batch, "lang").to_pylist()), np.int32, n)
            of, cost = group[own], np.zeros(len(code))
            for g in np.unique(group).tolist():
                at = np.flatnonzero(of == g)
                if not len(at):  # empty texts only; their language may have no model
                    continue
                distinct, place = np.unique(code[at], return_inverse=True)
                cost[at] = load_model(model, g, model_bytes).bits(distinct)[place]
            mean = np.bincount(own, cost, n) / np.maximum(np.bincount(own, minlength=n), 1)
            names = ["doc_id", "lang", "text_hash", *(x.split()[0] for x in BASE.split(", ")), "bits"]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "lang"), column(batch, "text_hash"), *(pa.array(x.astype(np.int64)) for x in base_statistics(col)), pa.array(mean)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    path = scratch(spark, "quality-scores")
    keyed = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed.mapInArrow(score, f"doc_id {kind}, lang string, text_hash long, {BASE}, bits double").write.parquet(path)
    scored = spark.read.parquet(path)
    drop_path(spark, model)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    limits = bands(scored.where(~F.col("base_failed")), "lang", below, above, least).withColumnRenamed("lang", "band_lang")
    joined = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("band_lang")), "left")  # a row per language
    inside = F.col("bits").between(F.col("bits_low"), F.col("bits_high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", *(x.split()[0] for x in BASE.split(", ")), "base_failed", kept.alias("kept"), "bits", "bits_low", "bits_high")
