"""Merkle trees over grouped tables: roots, and every row's authentication path by traversal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from gristmill.llm.common import column, shuffle_partitions, write_table

WIDTH = 32  # bytes of a digest
PACKED = "grp string, block long, total long, ids array<long>, nodes binary, others binary, root binary"
PATHS = "grp string, idx long, path binary, subroot binary, root binary"
PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a small table that is broadcast: at most a few kilobytes each.
BROADCAST_ROWS = 10_000


# ------------------------------------------------------------------------- one block


def parent(run: Sequence[bytes]) -> bytes:
    """The node over a run: sha256 of its digests as lowercase hex text, end to end."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in run)).digest()


class TreeHash:
    """Nodes of one height from leaves that come one by one; a stack holds less than a run for each level."""

    def __init__(self, arity: int, height: int):
        self.arity, self.stack, self.done = arity, [[] for _ in range(height)], []

    def _up(self, level: int, node: bytes) -> None:
        if level == len(self.stack):
            self.done.append(node)
            return
        self.stack[level].append(node)
        if len(self.stack[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.stack[level] = self.stack[level], []
        self._up(level + 1, parent(run))

    def push(self, leaf: bytes) -> None:
        self._up(0, leaf)

    def finish(self) -> list[bytes]:
        """Close the runs that the last leaves leave open, and hand over the nodes."""
        for level in range(len(self.stack)):
            if self.stack[level]:
                self._close(level)
        return self.done


def height(n: int, arity: int) -> int:
    """Levels until one node is left over n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def block_root(nodes: Sequence[bytes], arity: int, levels: int) -> bytes:
    if not levels:
        return nodes[0]
    tree = TreeHash(arity, levels)
    for x in nodes:
        tree.push(x)
    return tree.finish()[0]


def paths(nodes: Sequence[bytes], arity: int, levels: int) -> Iterator[bytes]:
    """Each leaf's authentication path inside its block, leaf by leaf.

    Every level keeps the run that the present leaf's ancestor stands in. While that is in use, the
    level's own stack makes the next one, a leaf a step, so it is ready when the traversal gets
    there. A path is, level by level, the ancestor's position, the number of siblings and these.
    """
    n, spans = len(nodes), [arity**h for h in range(levels + 1)]

    def made(h: int, run: int, upto: int) -> TreeHash:
        tree = TreeHash(arity, h)
        for i in range(run * spans[h + 1], min(n, upto)):
            tree.push(nodes[i])
        return tree

    now = [made(h, 0, spans[h + 1]).finish() for h in range(levels)]
    coming = [TreeHash(arity, h) for h in range(levels)]
    parts = [b""] * levels
    for i in range(n):
        for h in range(levels):
            if i % spans[h] == 0:  # another ancestor, or its next run
                if i and i % spans[h + 1] == 0:
                    now[h], coming[h] = coming[h].finish(), TreeHash(arity, h)
                at = i // spans[h] % arity
                siblings = now[h][:at] + now[h][at + 1 :]
                parts[h] = bytes((at, len(siblings))) + b"".join(siblings)
            if i + spans[h + 1] < n:
                coming[h].push(nodes[i + spans[h + 1]])
        yield b"".join(parts)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The positions and siblings that a path consists of."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        at += 2
        yield place, [path[at + WIDTH * k : at + WIDTH * (k + 1)] for k in range(n)]
        at += WIDTH * n


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for place, siblings in steps(path):
        leaf = parent([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def path_digest(path: bytes) -> str:
    """sha256 of all siblings of a path as hex text, bottom to top, left to right."""
    return hashlib.sha256("".join(x.hex() for _, run in steps(path) for x in run).encode()).hexdigest()


def cut(data: bytes) -> list[bytes]:
    return [data[i : i + WIDTH] for i in range(0, len(data), WIDTH)]


# --------------------------------------------------------------------------- the tree


def field(value: Column) -> Column:
    """A value in a leaf: its UTF-8 length, a colon and itself; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add idx, each row's place in its group from 0, and total, the group's rows.

    Rows are dealt by ranges of (grp, order), numbered inside each range and written; a range's first
    place is then the sum of what the ranges before it hold. `order` should end with a unique column, so that no
    group and no repeated key is too large for a range.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            groups, at = column(batch, "grp").dictionary_encode(), []
            names = groups.dictionary.to_pylist()
            for g in groups.indices.to_pylist():
                if names[g] != last:
                    last, n = names[g], 0
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=schema.names)

    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    written, _ = write_table(ranged.mapInArrow(count, schema), name)
    sizes = written.groupBy("grp", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("grp", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"), F.sum("size").over(Window.partitionBy("grp")).alias("total"))
    starts, _ = write_table(starts, f"{name}-starts")
    small = starts.count() <= BROADCAST_ROWS
    return written.join(F.broadcast(starts) if small else starts, ["grp", "part"]).withColumn("idx", F.col("first") + F.col("n")).drop("part", "n", "first")


def _pack(rows: DataFrame, arity: int, levels: int, name: str) -> DataFrame:
    """Aligned blocks of arity**levels nodes as one row each, with the node over the block.

    A group's only block is reduced to one node, others by `levels` each, however few nodes the last has.
    """
    width = arity**levels

    def one(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        nodes, others = block.column("node").to_pylist(), block.column("other").to_pylist()
        grp, total, idx = (block.column(c)[0].as_py() for c in ("grp", "total", "idx"))
        up = height(total, arity) if total <= width else levels
        changed = b"".join(o or x for x, o in zip(nodes, others, strict=True)) if any(others) else None
        row = {"grp": grp, "block": idx // width, "total": total, "ids": block.column("id").to_pylist(), "nodes": b"".join(nodes), "others": changed, "root": block_root(nodes, arity, up)}
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds, strict=True)})

    keyed = rows.select("grp", "idx", "total", "id", "node", "other", F.expr(f"idx div {width}").alias("block"))
    return write_table(keyed.groupBy("grp", "block").applyInArrow(one, PACKED), name)[0]


def _tree(rows: DataFrame, arity: int, levels: int, name: str) -> tuple[list[DataFrame], list[int]]:
    """Tables of blocks, from the leaves to one block a group, and the number of blocks in each."""
    width, out, counts = arity**levels, [_pack(rows, arity, levels, f"{name}-0")], []
    while True:
        most, blocks = out[-1].agg(F.max("total"), F.count("*")).first()
        counts.append(blocks)
        if (most or 0) <= width:
            return out, counts
        nodes = out[-1].select("grp", F.col("block").alias("idx"), F.expr(f"(total + {width - 1}) div {width}").alias("total"), F.lit(None).cast("long").alias("id"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("other"))
        out.append(_pack(nodes, arity, levels, f"{name}-{len(out)}"))


def _joined(blocks: DataFrame, upper: DataFrame, count: int) -> DataFrame:
    small = F.broadcast(upper) if count <= BROADCAST_ROWS else upper
    return blocks.join(small.withColumnRenamed("idx", "block").withColumnRenamed("root", "top"), ["grp", "block"])


def _levels(total: int, arity: int, levels: int) -> int:
    return height(total, arity) if total <= arity**levels else levels


def _descend(blocks: DataFrame, upper: DataFrame, count: int, arity: int, levels: int) -> DataFrame:
    """The whole path of each node of the blocks, from those of the blocks themselves."""
    width = arity**levels

    def run(batches):
        for batch in batches:
            for grp, block, total, nodes, path, subroot, top in zip(*(column(batch, c).to_pylist() for c in ("grp", "block", "total", "nodes", "path", "subroot", "top")), strict=True):
                made = [p + path for p in paths(cut(nodes), arity, _levels(total, arity, levels))]
                n = len(made)
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(([grp] * n, range(block * width, block * width + n), made, [subroot] * n, [top] * n), kinds, strict=True)], names=[x.split()[0] for x in PATHS.split(", ")])

    return _joined(blocks.select("grp", "block", "total", "nodes"), upper, count).mapInArrow(run, PATHS)


def _proofs(blocks: DataFrame, upper: DataFrame, count: int, arity: int, levels: int, with_path: bool) -> DataFrame:
    def run(batches):
        names = [x.split()[0] for x in PROOFS.split(", ")] + ["path"] * with_path
        for batch in batches:
            for ids, total, nodes, others, path, subroot, top in zip(*(column(batch, c).to_pylist() for c in ("ids", "total", "nodes", "others", "path", "subroot", "top")), strict=True):
                leaves, root, rows = cut(nodes), top.hex(), []
                given = cut(others) if others else leaves
                for key, leaf, own, inner in zip(ids, leaves, given, paths(leaves, arity, _levels(total, arity, levels)), strict=True):
                    whole = inner + path
                    folded = fold(own, whole)
                    rows.append((key, leaf.hex(), subroot.hex(), root, path_digest(whole), folded.hex(), folded == top, *[whole] * with_path))
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.binary()] * with_path)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _joined(blocks.select("grp", "block", "total", "ids", "nodes", "others"), upper, count).mapInArrow(run, PROOFS + ", path binary" * with_path)


def _rows(docs: DataFrame, columns: Sequence[str], id_col: str, group_col: str, altered: dict[str, Column] | None, when: Column | None) -> DataFrame:
    """The numbered leaves. Texts are read and hashed once; what follows moves digests only."""
    other = F.lit(None).cast("binary")
    if altered:
        other = F.when(F.lit(True) if when is None else when, leaf_digest([altered.get(c, F.col(c)) for c in columns]))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null before all others
    rows = docs.select(group.alias("grp"), F.col(id_col).cast("long").alias("id"), leaf_digest([F.col(c) for c in columns]).alias("node"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    return _numbered(write_table(rows, "merkle-leaves")[0], ("id", "node", "row"), "merkle-numbered")


def _shared(tops: DataFrame, arity: int, levels: int) -> tuple[DataFrame, list[DataFrame], list[int]]:
    """The groups in order, and the tree over their roots."""
    nodes = tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"), F.col("total").alias("size"))
    groups = _numbered(nodes, ("name",), "merkle-groups")
    leaves = groups.select("grp", "idx", "total", F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("binary").alias("other"))
    return groups, *_tree(leaves, arity, levels, "merkle-roots")


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", arity: int = 8, block_levels: int = 3) -> DataFrame:
    """group, rows, subroot, root: what has to be published so that any row can be verified later.

    The tree is that of `merkle_proofs`, and so are the cases of nulls, ties and empty tables.
    """
    own, _ = _tree(_rows(docs, columns, id_col, group_col, None, None), arity, block_levels, "merkle-blocks")
    leaves = own[0].groupBy("grp").agg(F.max("total").alias("rows"))
    groups, tops, _ = _shared(own[-1], arity, block_levels)
    root = F.broadcast(tops[-1].select(F.lower(F.hex("root")).alias("root")))  # one row
    named = groups.select(F.col("name").alias("grp"), F.lower(F.hex("node")).alias("subroot")).join(leaves, "grp")
    return named.join(root, F.lit(True), "left").select(F.expr("if(grp = '', null, substr(grp, 2))").alias("group"), "rows", "subroot", "root")


def merkle_proofs(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    altered: dict[str, Column] | None = None,
    when: Column | None = None,
    arity: int = 8,
    block_levels: int = 3,
    with_path: bool = False,
) -> DataFrame:
    """Every row's leaf, its group's root, the root of all, and the proof that leads there.

    A leaf is the digest of the named columns. In a group, leaves stand by id, nulls first, equal ids by
    digest; runs of `arity` nodes become their parent until one is left; the groups' roots, by the
    group's name in UTF-8 order, null first, likewise. `altered` replaces columns of the rows
    where `when` holds, and folded_root is what such a row and the original siblings lead to.

    Digests are numbered by ranges, then cut into aligned blocks of arity**block_levels leaves. Blocks are
    reduced to their roots, these again in blocks, until one is left. Then the paths of the
    upper blocks go down, and in each block a traversal moves the path from leaf to leaf: a task holds a block's
    digests and stacks of less than `arity` nodes a level. No group or tree is held as a whole.

    A repeated row is a leaf of its own. A group of one row has that row's leaf as its root. A null id
    stays null; a null in any other column is a dash in the leaf. An empty table gives no rows. Columns
    that are not named don't matter. With `with_path` the siblings are returned as well (see `steps`).
    """
    own, counts = _tree(_rows(docs, columns, id_col, group_col, altered, when), arity, block_levels, "merkle-blocks")
    groups, tops, top_counts = _shared(own[-1], arity, block_levels)
    upper = tops[-1].select("grp", F.col("block").alias("idx"), F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), "root")
    for blocks, n in zip(reversed(tops), reversed(top_counts), strict=True):
        upper = _descend(blocks, upper, n, arity, block_levels)
    named = groups.select("idx", F.col("name").alias("_name"), F.col("node").alias("_node"))
    upper = upper.join(named, "idx").select(F.col("_name").alias("grp"), F.lit(0).cast("long").alias("idx"), "path", F.col("_node").alias("subroot"), "root")
    for blocks, n in zip(reversed(own[1:]), reversed(counts[1:]), strict=True):
        upper = _descend(blocks, upper, n, arity, block_levels)
    return _proofs(own[0], upper, counts[0], arity, block_levels, with_path).withColumnRenamed("id", id_col)
