"""N-gram Jaccard join: a blocked, masked product of the document by n-gram incidence matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import LOWER, byte_table, column, drop_path, mix, range_hash, shuffle_partitions, slices, small_batches, utf8, window_hash, words, write_table
from gristmill.llm.components import components, spanning
from gristmill.llm.counting import PACKED, KeyCounts, packed_rows

CELL_BITS = 20  # of the table of weights
SALTS = 8  # parts of a run's members in joins
PROFILE = 256  # parts of a set whose sizes bound its overlaps
POSTINGS = "bucket int, size long, tokens binary, docs binary, sizes binary"


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles.

    Words are runs other than [\\x20\\x09-\\x0D], with A-Z lower-cased. A text of fewer than k
    words is one shingle of all of them; one without words has none.
    """
    raw, off = utf8(col)
    s, e, first = words(raw, off)
    h = range_hash(LOWER[raw], s, e, byte_table(2))
    grams = window_hash(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(window_hash(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(grams[:0])
    return out


def fingerprint(tokens: np.ndarray) -> int:
    """63 bits that name a set of n-grams; the node of all texts that have it."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def fingerprint2(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=1) >> 1


def profile(tokens: np.ndarray) -> bytes:
    """How many n-grams of a set fall in each of PROFILE parts, 255 standing for as many or more."""
    return np.minimum(np.bincount((tokens >> np.uint64(20)).astype(np.int64) % PROFILE, minlength=PROFILE), 255).astype(np.uint8).tobytes()


def may_link(pa_: np.ndarray, pb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes and profiles of two sets allow a link: the overlap is at most the sum of the
    smaller counts over the parts, where no count is cut."""
    most = np.minimum(pa_, pb).sum(axis=1, dtype=np.int64)
    cut = (pa_ == 255).any(axis=1) | (pb == 255).any(axis=1)
    sizes = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return sizes & (cut | (most * (100 + percent) >= percent * (na + nb)))


def profiles(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, PROFILE)


def min_overlap(n, percent: int):
    return -(-percent * n // 100)


def reachable(shared: np.ndarray, la: np.ndarray, lb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether an accumulated count allows a link.

    `shared` is the overlap of two prefixes over short runs; long runs, of which a set is in `la` or
    `lb`, add at most the smaller of these. Of the set whose prefix ends first all common n-grams
    up to there are in both prefixes, and beyond it there are min_overlap(size) - 1 more n-grams.
    """
    most = shared + np.minimum(la, lb) + np.maximum(min_overlap(na, percent), min_overlap(nb, percent)) - 1
    return most * (100 + percent) >= percent * (na + nb)


def bucket_bits(spark) -> int:
    """N-grams are dealt by so many of their top bits: four buckets or more for each shuffle partition."""
    return min(CELL_BITS, max(6, (4 * shuffle_partitions(spark) - 1).bit_length()))


# --------------------------------------------------------- weights: which n-grams are frequent


def _frequent(k: int, text_col: str, least: int, shift: int):
    """N-grams that `least` documents of this task or more have, packed."""

    def run(batches):
        held = KeyCounts()
        for batch in slices(batches, (text_col,)):
            sets = shingle_sets(column(batch, text_col), k)
            held.add(0, np.concatenate(sets) if sets else np.zeros(0, np.uint64))
        if held.parts:
            keys, counts = held.merged(0)
            some = KeyCounts()
            some.add_counts(0, keys[counts >= least], counts[counts >= least])
            if (counts >= least).any():
                yield from some.packed(shift)

    return run


def _weigh(bits: int):
    """Per bucket the largest log2 count, in quarters, in each of its cells."""

    def run(batches):
        held: dict[int, KeyCounts] = {}
        for batch in batches:
            for bucket, _, keys, counts in packed_rows(batch):
                held.setdefault(bucket, KeyCounts()).add_counts(0, keys, counts)
        for bucket, own in held.items():
            keys, counts = own.merged(0)
            cells = np.zeros(1 << CELL_BITS - bits, np.uint8)
            np.maximum.at(cells, _cell(keys) & (len(cells) - 1), np.minimum(np.log2(counts) * 4, 255).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["bucket", "cells"])

    return run


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def weights(docs: DataFrame, k: int, text_col: str, least: int = 3) -> np.ndarray:
    """A table of 2**20 one-byte weights that ranks frequent n-grams last.

    Any total order of the n-grams gives right results below; this one keeps what many documents
    share out of the prefixes. The table's size is fixed, whatever the corpus.
    """
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    spread = docs.select(text_col).mapInArrow(_frequent(k, text_col, least, 64 - bits), PACKED).repartition(shuffle_partitions(spark), "bucket")
    table = np.zeros((1 << bits, 1 << CELL_BITS - bits), np.uint8)
    for r in spread.mapInArrow(_weigh(bits), "bucket int, cells binary").collect():  # 2**20 bytes in all
        table[r["bucket"]] = np.frombuffer(r["cells"], np.uint8)
    return table.ravel()


# --------------------------------------------------------------------- sets and postings


def _describe(k: int, id_col: str, text_col: str):
    def run(batches):
        for batch in slices(batches, (text_col,)):
            sets = shingle_sets(column(batch, text_col), k)
            cols = [pa.array([len(t) for t in sets], pa.int64()), *(pa.array([f(t) if len(t) else None for t in sets], pa.int64()) for f in (fingerprint, fingerprint2))]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), *cols, pa.array([profile(t) for t in sets], pa.binary())], names=["doc_id", "n_shingles", "fp", "fp2", "profile"])

    return run


def _postings(k: int, text_col: str, percent: int, table, shift: int):
    """Each distinct set's rarest n-grams, enough of them that any partner shares one, packed by bucket."""

    def run(batches):
        weight, seen, parts, held = table.value, set(), [], 0

        def emit():
            tokens, docs, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(tokens)
            tokens, docs, sizes = tokens[order], docs[order], sizes[order]
            bucket = (tokens >> np.uint64(shift)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = [(int(bucket[a]), b - a, tokens[a:b].tobytes(), docs[a:b].tobytes(), sizes[a:b].tobytes()) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(tokens)], strict=True)]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in POSTINGS.split(", ")])

        for batch in slices(batches, (text_col,)):
            for tokens in shingle_sets(column(batch, text_col), k):
                n = len(tokens)
                if not n or (fp := fingerprint(tokens)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(fp)
                rank = weight[_cell(tokens)]
                size = n - min_overlap(n, percent) + 1
                pick = tokens[np.lexsort((tokens, rank))[:size]]
                parts.append((pick, np.full(size, fp, np.int64), np.full(size, n, np.uint32)))
                held += size
            if held > 1 << 20:
                yield emit()
                parts, held = [], 0
        if parts:
            yield emit()

    return run


def _runs(batches):
    """For each bucket its postings sorted by n-gram, one per n-gram and set, only n-grams of two sets or more."""
    parts: dict[int, list] = {}
    for batch in batches:
        for bucket, tokens, docs, sizes in zip(*(column(batch, c).to_pylist() for c in ("bucket", "tokens", "docs", "sizes")), strict=True):
            parts.setdefault(bucket, []).append((np.frombuffer(tokens, np.uint64), np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.uint32)))
    for bucket in sorted(parts):
        tokens, docs, sizes = (np.concatenate(x) for x in zip(*parts.pop(bucket), strict=True))
        order = np.lexsort((docs, tokens))
        tokens, docs, sizes = tokens[order], docs[order], sizes[order]
        once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])])
        tokens, docs, sizes = tokens[once], docs[once], sizes[once]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        length = np.diff(np.concatenate([first, [len(tokens)]]))
        yield bucket, tokens, docs, sizes.astype(np.int64), first, length


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller first, and how often each was there."""
    two = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    return np.unique(two, axis=0, return_counts=True)


PRODUCT = "run long, a long, b long, shared long"


def _products(percent: int, small: int, pivots: int):
    """The product of a block of n-grams: (run null, a, b, shared) with the overlap that the block
    adds to a pair, over all pairs of short runs; in long runs each set meets a few pivots, with nothing
    to add. Pairs whose sizes alone rule out a link are left out. The members of long runs follow
    as (run, set, size, null)."""

    def run(batches):
        for _, tokens, docs, sizes, first, length in _runs(batches):
            left, right, adds = [], [], []

            def add(a, b, by):
                lo, hi = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
                ok = 100 * lo >= percent * hi
                left.append(docs[a[ok]])
                right.append(docs[b[ok]])
                adds.append(np.full(int(ok.sum()), by, np.int64))

            for m in np.unique(length[(length > 1) & (length <= small)]).tolist():
                starts = first[length == m]
                i, j = np.triu_indices(m, 1)
                add((starts[:, None] + i).ravel(), (starts[:, None] + j).ravel(), 1)
            for at, m in zip(first[length > small].tolist(), length[length > small].tolist(), strict=True):
                members = np.arange(at, at + m)
                order = members[np.argsort(mix(docs[members].astype(np.uint64)))]
                for p in order[:pivots]:
                    others = members[members != p]
                    add(np.full(len(others), p), others, 0)
            if left:
                short = np.concatenate(adds) > 0
                a, b = np.concatenate(left), np.concatenate(right)
                for counted in (True, False):
                    pairs, n = _ordered(a[short == counted], b[short == counted])
                    n = n if counted else np.zeros_like(n)
                    for i in range(0, len(pairs), 1 << 16):
                        part = pairs[i : i + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(n[i : i + (1 << 16)])], names=["run", "a", "b", "shared"])
            long = np.repeat(length > small, length)
            if long.any():
                n = int(long.sum())
                yield pa.RecordBatch.from_arrays([pa.array(tokens[long].view(np.int64)), pa.array(docs[long]), pa.array(sizes[long]), pa.nulls(n, pa.int64())], names=["run", "a", "b", "shared"])

    return run


# ------------------------------------------------------------------------- overlap counts


def _sets(k: int, text_col: str, bits):
    """The sets that some candidate pair names, by a bit table of their fingerprints."""

    def run(batches):
        table, seen = bits.value, set()
        for batch in slices(batches, (text_col,)):
            rows = []
            for tokens in shingle_sets(column(batch, text_col), k):
                if not len(tokens):
                    continue
                fp = fingerprint(tokens)
                at = fp & (len(table) * 64 - 1)
                if int(table[at >> 6]) >> (at & 63) & 1 and fp not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(fp)
                    rows.append((fp, tokens.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["fp", "tokens"])

    return run


def _overlaps(percent: int):
    """Of a task's pairs those whose overlap over the whole sets reaches the bound, as a spanning forest."""

    def run(batches):
        left, right = [], []
        for batch in slices(batches, ("ta", "tb"), 4 << 20):
            keep = []
            for ta, tb in zip(column(batch, "ta").to_pylist(), column(batch, "tb").to_pylist(), strict=True):
                x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                keep.append(overlap * (100 + percent) >= percent * (len(x) + len(y)))
            left.append(column(batch, "a").to_numpy()[np.asarray(keep, bool)])
            right.append(column(batch, "b").to_numpy()[np.asarray(keep, bool)])
            if sum(map(len, left)) > 1 << 18:
                a, b = np.concatenate(left), np.concatenate(right)
                some = spanning(a, b)
                left, right = [a[some]], [b[some]]
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            some = spanning(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], names=["a", "b"])

    return run


def gather_sets(docs: DataFrame, ends: DataFrame, k: int, text_col: str, bit_words: int = 1 << 16) -> tuple[DataFrame, str]:
    """A table of the sets whose fingerprints `ends` has, each once.

    The table of 64 * bit_words bits only spares the shuffle sets that no pair needs.
    """
    spark = docs.sparkSession
    low = F.col("fp").bitwiseAND(bit_words * 64 - 1)
    found = ends.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits")).collect()  # bit_words at most
    table = np.zeros(bit_words, np.uint64)
    for r in found:
        table[r["w"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    sets = docs.select(text_col).mapInArrow(_sets(k, text_col, spark.sparkContext.broadcast(table)), "fp long, tokens binary")
    return write_table(sets.groupBy("fp").agg(F.first("tokens").alias("tokens")), "jaccard-sets")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what the pairs connect whose overlap count over the whole sets reaches the bound.

    A task gives back a spanning forest of its links, so their number follows the sets in it,
    not the square of a group."""
    joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("fp").alias("b"), F.col("tokens").alias("tb")), "b")
    return write_table(joined.select("a", "b", "ta", "tb").mapInArrow(_overlaps(percent), "a long, b long"), "jaccard-links")[0]


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose accumulated overlaps and profiles allow a link."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb, la, lb, shared = (column(batch, c).to_numpy() for c in ("na", "nb", "la", "lb", "shared"))
                mask = reachable(shared, la, lb, na, nb, percent)
                some = np.flatnonzero(mask)
                mask[some] = may_link(profiles(column(batch, "pa").take(pa.array(some))), profiles(column(batch, "pb").take(pa.array(some))), na[some], nb[some], percent)
                yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(mask)) for c in ("a", "b")], names=["a", "b"])

    one = nodes.select(F.col("fp").alias("a"), F.col("n_shingles").alias("na"), F.col("profile").alias("pa"), F.col("long_runs").alias("la"))
    two = nodes.select(F.col("fp").alias("b"), F.col("n_shingles").alias("nb"), F.col("profile").alias("pb"), F.col("long_runs").alias("lb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb", "la", "lb", "shared").mapInArrow(run, "a long, b long")


def _groups(batches, keys: tuple[str, ...]):
    """The runs of equal keys of sorted batches, whole, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([column(batch, k).to_numpy() for k in keys], axis=1)
        cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(cols[a])
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def cross_pairs(members: DataFrame, comps: DataFrame, nodes: DataFrame, percent: int, best: bool, block: int) -> DataFrame:
    """Pairs within the long runs whose ends are in different components so far and may yet link.

    Runs of one component have none, and of runs with the same members one is enough. A run is cut
    by size into classes, of which a set can link with its own and the next only, and these into
    blocks by set; a group of rows has two blocks, so no run gathers in one place, nor do its members
    where they meet their run's facts, which are there SALTS times. With `best` each
    set has one partner of each group at most, the likeliest by its profile; without, all pairs that
    their profiles allow.
    """
    width = max(math.log(100 / percent), 1e-9) * (1 + 1e-6)
    known = members.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    facts = [F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"), F.bit_xor("fp").alias("s1"), F.bit_xor(F.xxhash64("fp")).alias("s2")]
    open_runs = known.groupBy("run").agg(*facts).where("x <> y").groupBy("m", "s1", "s2").agg(F.min("run").alias("run")).select("run")
    rows = known.withColumns({"cls": F.floor(F.log("n") / width), "salt": F.pmod(F.xxhash64("fp", F.lit("salt")), F.lit(SALTS))})
    parts = rows.groupBy("run", "cls").agg(F.ceil(F.count("*") / block).alias("blocks")).join(open_runs, "run")
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = rows.join(salted, ["run", "cls", "salt"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))).drop("blocks")
    near = own.withColumn("other", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    meets = near.join(salted.select("run", F.col("cls").alias("other"), "salt", F.col("blocks").alias("theirs")), ["run", "other", "salt"])
    sides = meets.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("theirs") - 1)).alias("j"))
    first = F.when(F.col("cls") == F.col("other"), F.col("block") <= F.col("j")).otherwise(F.col("cls") < F.col("other"))
    i, k = F.when(first, F.col("block")).otherwise(F.col("j")), F.when(first, F.col("j")).otherwise(F.col("block"))
    keys = ("run", "lo", "hi", "i", "k")
    keyed = sides.select("run", F.least("cls", "other").alias("lo"), F.greatest("cls", "other").alias("hi"), i.alias("i"), k.alias("k"), first.cast("int").alias("left"), "fp", "n", "component")
    ordered = keyed.join(nodes.select("fp", "profile"), "fp").repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches):
        left, right, held = [], [], 0
        for (_, lo, hi, i, k), table in _groups(batches, keys):
            side, fp, n, comp = (table.column(c).to_numpy() for c in ("left", "fp", "n", "component"))
            prof, same = profiles(table.column("profile")), lo == hi and i == k
            p, q = (np.arange(len(fp)),) * 2 if same else (np.flatnonzero(side == 1), np.flatnonzero(side == 0))
            for x in p.tolist():
                y = q[comp[q] != comp[x]]
                if same:
                    y = y[y > x]
                y = y[may_link(prof[y], prof[x][None, :], n[y], n[x], percent)] if len(y) else y
                if best and len(y) > 1:
                    gap = n[y] + n[x] - 2 * np.minimum(prof[y], prof[x]).sum(axis=1, dtype=np.int64)
                    y = y[[int(np.argmin(gap))]]
                left.append(np.full(len(y), fp[x], np.int64))
                right.append(fp[y])
                held += len(y)
            if held > 1 << 19:
                pairs, _ = _ordered(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                left, right, held = [], [], 0
        if held:
            pairs, _ = _ordered(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


# -------------------------------------------------------------------------------- operator


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = 3, pivots: int = 2, block: int = 256) -> DataFrame:
    """Group documents by links of Jaccard similarity percent / 100 or more of their shingle sets.

    Equal sets are one node from the start, so copies are never paired. Of every other set the n -
    ceil(percent n / 100) + 1 rarest n-grams are kept: two linked sets share one of those. Postings
    are multiplied by blocks of n-grams; the blocks' counts of a pair add up to the overlap of its
    prefixes, and pairs that cannot reach the bound with what their sizes leave are discarded. For
    the others the count goes on over the whole sets. In runs of more than `small` sets every set first
    meets `pivots` common ones. What the links so far leave in different components then meets its
    likeliest partners, and what that leaves meets in full, block by block, so no link between
    components is missed. Pairs that sizes or profiles rule out are not counted.

    A null or wordless text has an empty set: n_shingles 0, linked with nothing. Rows without an id
    are counted but take no part in links; their component is null. Rows that share an id are one
    document that has each row's links. An empty table gives no rows. Only the two named columns
    are read.

    Returns doc_id, n_shingles, component_id: the smallest id reachable by links, its own included.
    """
    with small_batches(docs.sparkSession):
        return _jaccard_groups(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), k, percent, small, pivots, block)


def _jaccard_groups(rows: DataFrame, k: int, percent: int, small: int, pivots: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    described, _ = write_table(rows.mapInArrow(_describe(k, "doc_id", "text"), "doc_id long, n_shingles long, fp long, fp2 long, profile binary"), "jaccard-docs")
    known = rows.where("doc_id is not null")
    table = spark.sparkContext.broadcast(weights(known, k, "text"))
    spread = known.select("text").mapInArrow(_postings(k, "text", percent, table, 64 - bucket_bits(spark)), POSTINGS).repartition(shuffle_partitions(spark), "bucket")
    product, product_path = write_table(spread.mapInArrow(_products(percent, small, pivots), PRODUCT), "jaccard-product")
    members = product.where("run is not null").select("run", F.col("a").alias("fp"), F.col("b").alias("n"))
    own_runs = members.groupBy("fp").agg(F.count("*").alias("long_runs"))
    sets_of = described.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.first("n_shingles").alias("n_shingles"), F.first("profile").alias("profile"))
    nodes, nodes_path = write_table(sets_of.join(own_runs, "fp", "left").withColumn("long_runs", F.coalesce("long_runs", F.lit(0))), "jaccard-nodes")
    accumulated = product.where("run is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    candidates = plausible(accumulated, nodes, percent)
    links, tried, paths = None, None, [product_path, nodes_path]
    comps = spark.createDataFrame([], "node long, component long")
    for step in ("first", "best", "all"):
        if step != "first":
            if members.isEmpty():
                break
            candidates = cross_pairs(members, comps, nodes, percent, best=step == "best", block=block).join(tried, ["a", "b"], "left_anti")
        pairs, path = write_table(candidates, "jaccard-pairs")
        paths.append(path)
        tried = pairs if tried is None else tried.union(pairs)
        if not pairs.isEmpty():
            ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b"))
            sets, sets_path = gather_sets(known, ends, k, "text")
            new = verify(pairs, sets, percent)
            links = new if links is None else links.union(new)
            comps = components(links)
            drop_path(spark, sets_path)
    drop_path(spark, *paths)
    own = described.where("fp is not null and doc_id is not null")
    classes = own.groupBy("fp", "fp2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    by_id = own.select("fp", "doc_id")  # rows of one id are one document
    repeated = own.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    if not repeated.isEmpty():
        same = by_id.join(repeated, "doc_id")
        star = same.join(same.groupBy("doc_id").agg(F.min("fp").alias("b")), "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b")
        comps = components(star.union(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    labelled = classes.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    out = described.join(named, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
