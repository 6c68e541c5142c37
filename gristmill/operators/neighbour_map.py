"""Vectors laid out by their neighbours: an approximate neighbour graph, fuzzy weights, sampled gradient steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import topics
from gristmill.sources.storage import written

GRAPH = "id long, other long, distance double"
#: The curve 1 / (1 + A d**(2 B)) that falls like exp(-d), for a least distance of 0 and a spread of 1.
A, B = 1.9328, 0.7905


#: Middle vectors whose neighbours are compared in one group, and rows of a comparison.
MIDDLES, ASKING = 64, 512


def _stack(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _unit(col: pa.Array) -> np.ndarray:
    x = _stack(col)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    each = rows.repartition("id").groupBy("id", "other").agg(F.min("distance").alias("distance"))  # moved once
    return each.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def neighbour_graph(vectors: DataFrame, id_col: str, vector_col: str, k: int = 30, trees: int = 8, leaf: int = 256, rounds: int = 1, wide: int = 12, seed: int = 42) -> DataFrame:
    """id, other, distance: about the `k` nearest other vectors of each by cosine distance.

    Each of `trees` random partitions cuts space by as many random planes as leave some `leaf` vectors in a cell;
    inside cells all pairs are compared. Cells that hold more than twice as many, such as copies of a
    vector, are dealt to parts of that size by hash. Then, `rounds` times, each vector meets the `wide` nearest
    neighbours of its `wide` nearest. A larger `trees` or `leaf` raises the recall. Ids should be distinct; rows without an id or a vector take no part;
    a vector of zeros is at distance 1 from all.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null and v is not null")
    rows = written(rows, "graph-rows")
    total = rows.count()
    planes = max(0, math.ceil(math.log2(max(total, 1) / leaf)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1))
            for t in range(trees):
                normals = np.random.default_rng([seed, t]).standard_normal((x.shape[1], planes))
                code = ((x @ normals > 0) << np.arange(planes)).sum(axis=1) if planes else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t] * len(x), pa.int32()), pa.array(code.astype(np.int64))], names=["id", "v", "tree", "cell"])

    placed = rows.mapInArrow(cells, f"id long, v {kind}, tree int, cell long")
    sizes = placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "tree"), F.col("parts")).cast("int")
    dealt = placed.join(written(sizes, "graph-sizes"), ["tree", "cell"]).withColumn("part", part)

    def pairs(cell: pa.Table) -> pa.Table:
        ids, x = cell.column("id").to_numpy(), _unit(cell.column("v").combine_chunks())
        distance = 1 - x @ x.T
        np.fill_diagonal(distance, np.inf)
        n = min(k, len(ids) - 1)
        near = np.argpartition(distance, n - 1, axis=1)[:, :n] if n > 0 else np.zeros((len(ids), 0), np.int64)
        return pa.table({"id": np.repeat(ids, n), "other": ids[near].ravel(), "distance": np.take_along_axis(distance, near, 1).ravel()})

    def further(group: pa.Table) -> pa.Table:
        group = group.sort_by([("middle", "ascending"), ("id", "ascending"), ("bound", "descending")]).combine_chunks()  # one that does not ask has no bound: last
        middle, ids, bound, x = group.column("middle").to_numpy(), group.column("id").to_numpy(), group.column("bound").to_numpy(), _unit(group.column("v").combine_chunks())
        first = np.concatenate([[True], (middle[1:] != middle[:-1]) | (ids[1:] != ids[:-1])])
        middle, ids, bound, x = middle[first], ids[first], bound[first], x[first]
        ends, out = np.flatnonzero(np.concatenate([middle[1:] != middle[:-1], [True]])) + 1, []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            asking = lo + np.flatnonzero(bound[lo:hi] > -2)
            for at in (asking[i : i + ASKING] for i in range(0, len(asking), ASKING)):
                distance = 1 - x[at] @ x[lo:hi].T
                distance[np.arange(len(at)), at - lo] = np.inf
                if hi - lo > k:
                    least = np.partition(distance, k - 1, axis=1)[:, k - 1]
                    row, col = np.nonzero(distance <= np.minimum(least, bound[at])[:, None])
                else:
                    row, col = np.nonzero((distance <= bound[at][:, None]) & np.isfinite(distance))
                out.append((ids[at][row], ids[lo + col], distance[row, col]))
        made = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(dict(zip(("id", "other", "distance"), made, strict=True)))

    graph = written(_nearest(dealt.groupBy("tree", "cell", "part").applyInArrow(pairs, GRAPH), k), "graph")
    for _ in range(rounds):
        own = Window.partitionBy("id")
        rank = F.row_number().over(own.orderBy("distance", "other"))
        bound = F.when(F.count("*").over(own) < k, F.lit(4.0)).otherwise(F.max("distance").over(own))
        short = written(graph.withColumns({"_rank": rank, "bound": bound}).where(F.col("_rank") <= wide).select("id", "other", "bound"), "short")
        members = short.select(F.col("other").alias("middle"), "id", "bound").unionByName(short.select(F.col("id").alias("middle"), F.col("other").alias("id"), F.lit(-4.0).alias("bound")))
        met = members.join(rows, "id").withColumn("_group", F.pmod(F.xxhash64("middle"), F.lit(max(1, total // MIDDLES))))
        new = met.groupBy("_group").applyInArrow(further, GRAPH)
        graph = written(_nearest(graph.unionByName(new), k), "graph")
    return graph


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """id, other, w: how surely two vectors are neighbours, seen from both ends.

    From one end it is exp(-(d - nearest) / scale), with the scale at which a vector's weights add up to log2 of
    their number; both ends together give a + b - a b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others, weights = [], [], []
            for i, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = np.asarray([n["distance"] for n in near])
                away = np.maximum(d - d.min(), 0)
                lo, hi, want = 1e-12, max(float(away.max()), 1e-9) * 64, max(math.log2(len(d)), 1e-9)
                for _ in range(60):
                    mid = math.sqrt(lo * hi)
                    lo, hi = (lo, mid) if np.exp(-away / mid).sum() > want else (mid, hi)
                ids += [i] * len(near)
                others += [n["other"] for n in near]
                weights += np.exp(-away / hi).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(weights, pa.float64())], names=["id", "other", "w"])

    near = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))  # k a row
    one = near.select("id", "near").mapInArrow(run, "id long, other long, w double")
    back = one.select(F.col("other").alias("id"), F.col("id").alias("other"), F.col("w").alias("back"))
    both = one.join(back, ["id", "other"], "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    return written(both.select("id", "other", (F.col("w") + F.col("back") - F.col("w") * F.col("back")).alias("w")), "weights")


def _settle(dims: int, epochs: int, first: int, last: int, far: np.ndarray, negatives: int, seed: int):
    """Gradient steps on the nodes of a partition; neighbours elsewhere stand still meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("id")
        ids, y = table.column("id").to_numpy(), _stack(table.column("y").combine_chunks())
        near = table.column("near").to_pylist()
        at = np.repeat(np.arange(len(ids)), [len(n) for n in near])
        other = np.asarray([e["other"] for n in near for e in n], np.int64)
        w, there = np.asarray([e["w"] for n in near for e in n]), np.asarray([e["y"] for n in near for e in n]).reshape(-1, dims)
        inside = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        local = ids[inside] == other
        rnd = np.random.default_rng([seed, first, int(ids[0]) & 0x7FFFFFFF])
        for epoch in range(first, first + epochs):
            rate = 1.0 - epoch / last
            drawn = rnd.random(len(w)) < w
            i, j = at[drawn], inside[drawn]
            diff = y[i] - np.where(local[drawn][:, None], y[j], there[drawn])
            d2 = (diff * diff).sum(axis=1, keepdims=True)
            pull = np.clip(-2 * A * B * np.maximum(d2, 1e-9) ** (B - 1) / (1 + A * np.maximum(d2, 0) ** B) * diff, -4, 4)
            move = np.zeros_like(y)
            np.add.at(move, i, pull)
            m = len(i) * negatives
            who, pool = np.repeat(i, negatives), np.concatenate([far, y])
            diff = y[who] - pool[rnd.integers(0, len(pool), m)]
            d2 = (diff * diff).sum(axis=1, keepdims=True)
            push = np.clip(2 * B / ((1e-3 + d2) * (1 + A * d2**B)) * diff, -4, 4)
            np.add.at(move, who, push)
            y = y + rate * move / max(1.0, np.bincount(i, minlength=len(ids)).max() / 4)
        for lo in range(0, len(ids), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 4096]), pa.array(list(y[lo : lo + 4096]), pa.list_(pa.float64()))], names=["id", "y"])

    return run


def neighbour_map(vectors: DataFrame, id_col: str, vector_col: str, dims: int = 5, k: int = 30, rounds: int = 10, epochs: int = 20, part: int = 2000, sample: int = 1024, negatives: int = 5, seed: int = 42, **graph_options) -> DataFrame:
    """id, p: coordinates in which a vector's neighbours stay near it.

    It begins with principal components. In each of `rounds` the vectors are dealt by their place along a random
    direction, some `part` to a task, with their neighbours' present coordinates; a task makes `epochs` of
    steps on its own: edges drawn by weight pull, random others push, `sample` of them from everywhere. The
    outcome is written and is the next round's begin. The same seed and partitions give the same map. A vector's
    edges are its own k, so no vector has more.
    """
    spark = vectors.sparkSession
    graph = neighbour_graph(vectors, id_col, vector_col, k, seed=seed, **graph_options)
    edges = fuzzy_weights(graph)
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    total = known.count()
    if total <= dims:
        return known.select("id", F.array(*[F.lit(0.0)] * dims).alias("p")).withColumnRenamed("id", id_col)
    begin = topics.components(known, "id", "v", dims)
    size = begin.agg(F.max(F.array_max(F.transform("p", F.abs)))).first()[0] or 1.0
    places = written(begin.select("id", F.transform("p", lambda x: x * 10.0 / size).alias("y")), "places")
    parts, last = max(1, math.ceil(total / part)), rounds * epochs
    for r in range(rounds):
        direction = np.random.default_rng([seed, r]).standard_normal(dims)
        far = np.asarray([x["y"] for x in places.orderBy(F.xxhash64("id", F.lit(r))).limit(sample).collect()]).reshape(-1, dims)
        near = edges.join(places.select(F.col("id").alias("other"), "y"), "other").groupBy("id").agg(F.collect_list(F.struct("other", "w", "y")).alias("near"))
        along = F.aggregate(F.zip_with("y", F.array(*map(F.lit, direction.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        nodes = places.join(near, "id").withColumn("_along", along).repartitionByRange(parts, "_along").select("id", "y", "near")
        places = written(nodes.mapInArrow(_settle(dims, epochs, r * epochs, last, far, negatives, seed), "id long, y array<double>"), "places")
    return places.select(F.col("id").alias(id_col), F.col("y").alias("p"))
