"""Relational building blocks: lookups, ordinals, batches, samples, validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same table, or an error that names the missing columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# ---------------------------------------------------------------------------- lookups


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def lookup(values: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """A literal map as a first-match expression; a miss gives the default."""
    if not values:
        return default if default is not None else F.lit(None).cast("string")
    out = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]
    return out if default is None else F.coalesce(out, default)


def two_sided(edges: DataFrame, dim: DataFrame, key: str, value: str, left: str, right: str, left_out: str, right_out: str) -> DataFrame:
    """Join one dimension in two roles; keys without an entry give null."""
    one = dim.select(F.col(key).alias(left), F.col(value).alias(left_out))
    two = dim.select(F.col(key).alias(right), F.col(value).alias(right_out))
    return edges.join(one, left, "left").join(two, right, "left")


def rule_scope(a: Column, b: Column) -> Column:
    """First of five outcomes that the classes of a rule's two sides give."""
    home, ctx, unknown = "smart_home", "context", "unknown"
    return (
        F.when((a == home) & (b == home), "core_smart_home")
        .when(((a == home) & (b == ctx)) | ((a == ctx) & (b == home)), "context_aware_smart_home")
        .when((a == home) | (b == home), "smart_home_related")
        .when((a == unknown) | (b == unknown), "review")
        .otherwise("out_of_scope")
    )


def one_to_one_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails while it runs where either side repeats a key."""

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{side} repeats key "), F.col(key).cast("string")))).otherwise(True)).drop("_n")

    return checked(left, "left").join(checked(right, "right"), key, "left")


@dataclass(frozen=True)
class JoinReport:
    """What a join has seen, once it has run: rows, unmatched, left_repeats, right_repeats."""

    left: Observation
    right: Observation

    @property
    def get(self) -> dict[str, int]:
        return self.left.get | self.right.get


def reported_left(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, JoinReport]:
    """A left join on a key that should be unique on both sides, and its report, which the query fills as it runs.

    Of a repeated key of the right side one row is joined, so the left side's rows come out once each. The
    report counts left rows, those without a partner, and on each side the rows whose key has others there. Each
    side is moved once, for its counts and the join alike; nothing is counted in a query of its own. A null key
    matches nothing and repeats nothing, and its rows are not moved.
    """
    n, m, at = (free_column(c, left, right) for c in ("_left_n", "_right_n", "_right_at"))
    own, known = Window.partitionBy(key), F.col(key).isNotNull()
    report = JoinReport(Observation(), Observation())
    counted = right.where(known).withColumns({m: F.count("*").over(own), at: F.row_number().over(own.orderBy(key))})
    rights = counted.observe(report.right, F.count_if(F.col(m) > 1).alias("right_repeats")).where(F.col(at) == 1).drop(at)
    joined = left.where(known).withColumn(n, F.count("*").over(own)).join(rights, key, "left")
    alone = left.where(~known).withColumn(n, F.lit(1).cast("long"))
    every = joined.unionByName(alone, allowMissingColumns=True)
    seen = every.observe(report.left, F.count("*").alias("rows"), F.count_if(F.col(m).isNull()).alias("unmatched"), F.count_if(F.col(n) > 1).alias("left_repeats"))
    return seen.drop(n, m), report


def free_column(name: str, *tables: DataFrame) -> str:
    """A name that no column of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --------------------------------------------------------------- ordinals and batches


def topic_code(topic: Column) -> Column:
    return F.when(topic == -1, "T_OUTLIER").otherwise(F.format_string("T%03d", topic))


def number_in_group(df: DataFrame, group: str, key: str, name: str = "rn", block: int = 4096) -> DataFrame:
    """Number the rows of each group from 1 by a unique whole-number key.

    Rows are numbered inside blocks of `block` keys, and a block begins after the rows of those
    before it, so a group that has most of the rows is still spread over many tasks.
    """
    rows = df.withColumn("_block", F.expr(f"{key} div {block}"))
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(key))
    return rows.withColumn("_in", inside).join(starts, [group, "_block"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_block", "_before", "_in")


def assign_batches(df: DataFrame, group: str, key: str, size: int = 100) -> DataFrame:
    """rn and batch_id: batches of at most `size` rows in each group."""
    return number_in_group(df, group, key).withColumn("batch_id", F.expr(f"(rn - 1) div {size} + 1"))


def manifest(batched: DataFrame, group: str, order: str) -> DataFrame:
    """A row per group and batch: its rows, the group's batches, the first row's key."""
    per_batch = batched.groupBy(group, "batch_id").agg(F.count("*").alias("n_samples"), F.min(order).alias("first_key"))
    return per_batch.withColumn("n_batches", F.max("batch_id").over(Window.partitionBy(group)))


# ----------------------------------------------------------------------------- samples


def hash_rank(seed: int, key: Column) -> Column:
    """A value that orders rows at random but alike on every engine and run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def quota_sample(df: DataFrame, group: str, part: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """`n` rows of each group, spread over its parts.

    Each part gives n div parts rows, the first parts by name one more for the remainder, as far
    as it has them; what is missing is filled by the parts' next rows, rank by rank. Smaller groups
    are taken whole. Only the first n rows of a part can be chosen, which keeps windows short.
    """
    by_part = Window.partitionBy(group, part).orderBy(hash_rank(seed, F.col(key)), key)
    rows = df.withColumn("_rank", F.row_number().over(by_part)).where(F.col("_rank") <= n)
    parts = df.select(group, part).distinct()
    parts = parts.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(part))).withColumn("_parts", F.count("*").over(Window.partitionBy(group)))
    quota = F.expr(f"{n} div _parts + if(_at <= {n} % _parts, 1, 0)")
    fill = Window.partitionBy(group).orderBy(F.col("_rank") > quota, "_rank", part)
    return rows.join(parts, [group, part]).withColumn("_fill", F.row_number().over(fill)).where(F.col("_fill") <= n).drop("_rank", "_at", "_parts", "_fill")


# --------------------------------------------------------------------------- selection


def parse_selection(args: Sequence[str]) -> set[int] | None:
    """Topics named on a command line: numbers, `a-b` ranges, `outlier`, `-1`; `all` is None."""
    words = [w for a in args for w in a.replace(",", " ").split()]
    if not words:
        raise ValueError("nothing selected")
    out: set[int] = set()
    for w in words:
        low = w.lower()
        if low == "all":
            return None
        if low in ("outlier", "outliers", "-1"):
            out.add(-1)
            continue
        a, dash, b = w.partition("-")
        if not a.isdigit() or dash and not b.isdigit():
            raise ValueError(f"not a topic or range: {w}")
        lo, hi = int(a), int(b) if dash else int(a)
        if lo > hi:
            raise ValueError(f"range {w} runs backwards")
        out.update(range(lo, hi + 1))
    return out


def select_topics(df: DataFrame, topic: str, wanted: set[int] | None) -> DataFrame:
    """The rows of the topics asked for; an error names those that the table lacks."""
    if wanted is None:
        return df
    found = {r[0] for r in df.where(F.col(topic).isin(*wanted)).select(topic).distinct().collect()}  # as many as were asked for
    if missing := sorted(wanted - found):
        raise ValueError(f"no such topics: {missing}")
    return df.where(F.col(topic).isin(*wanted))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Input rows whose result is not there yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
