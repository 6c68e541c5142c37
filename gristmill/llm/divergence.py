"""How sources of a language differ in their words: exact divergences over integer-coded dictionaries."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import LOWER, column, slices, utf8, words, write_table

SCALE = 1_000_000_000
TERM = np.ones(256, bool)  # bytes that are in no term: all ASCII but letters
TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
PARTIAL = "lang string, source string, term string, n long, df long"
CHUNK = "lang string, terms array<string>, sources array<string>, totals array<long>, lengths array<int>, ids binary, counts binary"
FOUND = "lang string, source string, part string, item string, value long"
#: Groups whose totals are broadcast; beyond it they are joined by language, salted.
BROADCAST_GROUPS, SALTS = 100_000, 64
#: Cells of a dense block in memory.
CELLS = 1 << 21


# ------------------------------------------------------------------------ counting


def _partial(batches):
    """Counts and document frequencies of (group, term), pre-aggregated; memory follows distinct terms up to a bound."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    loose = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("df", "sum")]).rename_columns(["g", "term", "n", "df"])

    def named(table: pa.Table):
        langs, sources = (pa.array([k[i] for k in groups], pa.string()) for i in (0, 1))
        for part in table.to_batches(max_chunksize=20_000):
            g = part.column(0)
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), part.column(1).cast(pa.string()), part.column(2), part.column(3)], names=["lang", "source", "term", "n", "df"])

    for batch in slices(batches, ("text",), 2 << 20):
        of = np.fromiter((groups.setdefault(k, len(groups)) for k in zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(), strict=True)), np.int64, batch.num_rows)
        raw, off = utf8(column(batch, "text"))
        start, end, first = words(raw, off, ~TERM)
        if not len(start):
            continue
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        data = LOWER[raw][TERM[raw]]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        size = len(found.dictionary)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        each, n = np.unique(doc * size + found.indices.to_numpy(), return_counts=True)
        key, at = np.unique(of[each // size] * size + each % size, return_inverse=True)
        columns = (key // size, found.dictionary.take(pa.array(key % size)).cast(pa.large_string()), np.bincount(at, n).astype(np.int64), np.bincount(at))
        held.append(pa.table(dict(zip(("g", "term", "n", "df"), columns, strict=True))))
        loose += len(key)
        if loose > 500_000:
            whole = merged()
            if whole.num_rows > 300_000:
                yield from named(whole)
                held, loose = [], 0
            else:
                held, loose = [whole], whole.num_rows
    if held:
        yield from named(merged())
    if groups:  # a group is there even if it has no term
        zero = pa.array(np.zeros(len(groups), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in groups], pa.string()) for i in (0, 1)] + [pa.array([""] * len(groups)), zero, zero], names=["lang", "source", "term", "n", "df"])


def _chunks(min_docs: int, max_terms: int, max_entries: int):
    """Sorted rows (lang, term, source, n, df) to chunks of a language's kept terms.

    A chunk has its kept terms in order; a term's id is its place in it, found by searchsorted among the
    kept ones. Per source it has the ids and counts of the terms that occur there.
    """

    def chunk(lang: str, terms: pa.Array, source: np.ndarray, names: pa.Array, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, source))
        source, ids, n = source[order], ids[order], n[order]
        present, begin = np.unique(source, return_index=True)
        lengths, totals = np.diff(np.append(begin, len(source))), np.add.reduceat(n, begin)
        values = (lang, terms.to_pylist(), names.take(pa.array(present)).to_pylist(), totals.tolist(), lengths.tolist(), ids.astype("<i4").tobytes(), n.astype("<i8").tobytes())
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in CHUNK.split(", ")])

    def of_language(lang: str, rows: pa.Table):
        coded, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
        at, n = coded.indices.to_numpy(), rows.column("n").to_numpy()  # rows are sorted, so codes are ranks
        kept = np.flatnonzero(np.bincount(at, rows.column("df").to_numpy()) >= min_docs)
        inside = np.searchsorted(kept, at)
        real = (inside < len(kept)) & (kept[np.minimum(inside, len(kept) - 1)] == at) if len(kept) else np.zeros(len(at), bool)
        ids, n, source = inside[real], n[real], sources.indices.to_numpy()[real]
        ends = np.cumsum(np.bincount(ids, minlength=len(kept)))
        lo = 0
        while lo < len(kept):
            base = ends[lo - 1] if lo else 0
            hi = min(lo + max_terms, max(lo + 1, int(np.searchsorted(ends, base + max_entries, side="right"))))
            part = slice(int(base), int(ends[hi - 1]))
            yield chunk(lang, coded.dictionary.take(pa.array(kept[lo:hi])), source[part], sources.dictionary, ids[part] - lo, n[part])
            lo = hi

    def run(batches):
        held, size = [], 0

        def flush(rows: pa.Table):
            langs = rows.column("lang").combine_chunks().dictionary_encode()
            code = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                a, b = np.searchsorted(code, [k, k + 1])
                yield from of_language(lang, rows.slice(a, b - a))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 4 * max_entries:
                continue
            rows = pa.Table.from_batches(held)
            term, lang = column(batch, "term"), column(batch, "lang")
            last = batch.num_rows - 1
            t, g = term.dictionary_encode(), lang.dictionary_encode()
            tail = (t.indices.to_numpy() == t.indices[last].as_py()) & (g.indices.to_numpy() == g.indices[last].as_py())
            whole = rows.num_rows - int(tail.sum())  # the last term's rows may go on
            if tail.all():
                continue
            yield from flush(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            size = rows.num_rows - whole
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


# ------------------------------------------------------------------------- scoring


def scaled_shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly: three digits at a time, so no product overflows."""
    rest, out = counts + 1, np.zeros_like(counts)
    whole, rest = np.divmod(rest, total)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _best(values: np.ndarray, terms: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` largest values, equal ones in the terms' UTF-8 order."""
    if len(values) > top:
        some = np.flatnonzero(values >= np.partition(values, -top)[-top])  # and all that equal the last
        values, terms = values[some], terms[some]
    order = sorted(range(len(values)), key=lambda i: (-values[i], terms[i]))[:top]
    return values[order], terms[order]


def _scores(top: int):
    """Chunks with their language's totals to partial pair sums and each group's best terms so far."""

    def run(batches):
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        best: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        kept = 0

        def out():
            rows = []
            for lang, (names, sums) in pairs.items():
                for a, name in enumerate(names):
                    rows += [(lang, name, "pair", other, int(v)) for b, (other, v) in enumerate(zip(names, sums[a].tolist(), strict=True)) if b != a]
                    if len(rows) > 20_000:
                        yield batch_of(rows)
                        rows = []
            for (lang, name), (values, terms) in best.items():
                rows += [(lang, name, "term", t.decode(), int(v)) for v, t in zip(values.tolist(), terms.tolist(), strict=True)]
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
            pairs.clear()
            best.clear()

        for batch in batches:
            names = [f.name for f in batch.schema]
            for row in zip(*(column(batch, c).to_pylist() for c in names), strict=True):
                r = dict(zip(names, row, strict=True))
                lang, groups, size = r["lang"], [g["source"] for g in r["groups"]], len(r["terms"])
                place = {s: i for i, s in enumerate(groups)}
                total = np.asarray([g["total"] for g in r["groups"]], np.int64) + r["v"]
                terms = np.asarray([t.encode() for t in r["terms"]], object)
                rows_of = np.repeat([place[s] for s in r["sources"]], r["lengths"])
                ids, n = np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<i8")
                held = pairs.get(lang)
                sums = held[1] if held else np.zeros((len(groups), len(groups)), np.int64)
                width = max(1, CELLS // len(groups))
                for lo in range(0, size, width):
                    hi = min(size, lo + width)
                    here = (ids >= lo) & (ids < hi)
                    dense = np.zeros((len(groups), hi - lo), np.int64)
                    dense[rows_of[here], ids[here] - lo] = n[here]
                    p, every = scaled_shares(dense, total[:, None]), dense.sum(0)
                    q = scaled_shares(every, np.int64(total.sum() - (len(groups) - 1) * r["v"]))
                    for a, name in enumerate(groups):
                        d = p[a] - p
                        sums[a] += (d * d // p).sum(1)
                        more = np.flatnonzero((dense[a] > 0) & (p[a] > q))
                        if len(more):
                            value, mine = (p[a, more] - q[more]) ** 2 // q[more], terms[lo:hi][more]
                            if (lang, name) in best:
                                value, mine = (np.concatenate(x) for x in zip(best[lang, name], (value, mine), strict=True))
                                kept -= len(best[lang, name][0])
                            best[lang, name] = _best(value, mine, top)
                            kept += len(best[lang, name][0])
                pairs[lang] = groups, sums
                if kept > CELLS // 4 or sum(len(g) ** 2 for g, _ in pairs.values()) > CELLS:
                    yield from out()
                    kept = 0
        yield from out()

    return run


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, max_terms: int = 4096, max_entries: int = 1 << 17) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language stands from the others, and by which words.

    A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the
    terms of at least `min_docs` of its rows. A group's share of a term is 1 + floor(10**9 * (count + 1) /
    (its kept occurrences + kept terms)), and two shares diverge by floor((p - q)**2 / q), all in whole numbers.
    `pair` sums this over all kept terms for every other source of the language; `term` has a
    source's terms above the language's own share, the `top` largest.

    Tasks count distinct (language, source, term) rows, which Spark adds up and deals by ranges of
    (language, term). There kept terms get ids in UTF-8 order, in chunks; a chunk's counts become dense
    vectors per group, and all pairs of the language are compared vector by vector. A task holds one chunk, the
    language's pair sums and its groups' best terms; no group's rows meet in one task.

    Null text, language and source count as empty; equal values rank by item in UTF-8 order; a repeated row
    counts as often as it is there; a language without kept terms has pairs of value 0; a group alone
    in its language has no pair. An empty table gives no rows; other columns are not read. Texts of any length are read
    whole. The pairs of a language are as many as its sources squared, as is their result.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    partial = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(_partial, PARTIAL)
    counted, _ = write_table(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "divergence-terms")
    sorted_ = counted.where("term != ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    chunks, _ = write_table(sorted_.select("lang", "term", "source", "n", "df").mapInArrow(_chunks(min_docs, max_terms, max_entries), CHUNK), "divergence-chunks")
    groups = counted.where("term = ''").select("lang", "source")
    totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    shaped = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("g"))
    langs, _ = write_table(shaped.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups")).join(sizes, "lang", "left"), "divergence-groups")
    known = langs.where("v is not null")
    if (langs.agg(F.sum(F.size("groups"))).first()[0] or 0) <= BROADCAST_GROUPS:
        joined = chunks.join(F.broadcast(known), "lang")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = chunks.withColumn("salt", F.pmod(F.xxhash64("ids", "counts"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    scored = joined.mapInArrow(_scores(top), FOUND).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    none = langs.where("v is null").select("lang", F.explode("groups.source").alias("source"), F.col("groups.source").alias("others"))
    none = none.select("lang", "source", F.lit("pair").alias("part"), F.explode("others").alias("item"), F.lit(0).cast("long").alias("value")).where("item != source")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = scored.where("part = 'pair'").unionByName(none).withColumn("rank", F.row_number().over(order))
    terms = scored.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
