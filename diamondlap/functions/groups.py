"""Group helpers that stay whole and parallel when one group is huge.

Group statistics are aggregated (partial sums before the shuffle) and joined
back, never computed by a window that would pull a whole group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondlap.functions.scalars import ColumnOrName, as_col
from diamondlap.sources.staging import stage


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def laid(df: DataFrame, tasks: int | None, *keys) -> DataFrame:
    """df by keys in so many tasks, which Spark does not gather again; as it is without a number. What follows groups and
    joins by these keys (grouping: also by more) where the rows lie, so a task sorts no more rows however many there are."""
    return df.repartition(tasks, *keys) if tasks else df


def join_back(df: DataFrame, stats: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Left join of per-group rows; a NULL key is a group like any other. Groups
    within games are small but as many as there are games, so these are never broadcast."""
    by = _names(by)
    if not by:
        return df.join(F.broadcast(stats))  # one row: an aggregate without keys
    right = stats.select(
        *[F.col(k).alias(f"__{k}") for k in by],
        *[c for c in stats.columns if c not in by],
    )
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    if "game_pk" in by:
        right = right.hint("merge")
    return df.join(right, on, "left").drop(*[f"__{k}" for k in by])


def attach_group_stats(df: DataFrame, by, col: str, mean="group_mean", count="group_count") -> DataFrame:
    stats = df.groupBy(*_names(by)).agg(
        F.avg(col).alias(mean), F.count(col).cast("bigint").alias(count)
    )
    return join_back(df, stats, by)


def field_stats(df: DataFrame, by, col: str, best="field_best", size="field_size") -> DataFrame:
    stats = df.groupBy(*_names(by)).agg(
        F.max(col).alias(best), F.count(F.lit(1)).cast("bigint").alias(size)
    )
    return join_back(df, stats, by)


def share(df: DataFrame, by, col: str, out="share") -> DataFrame:
    total = df.groupBy(*_names(by)).agg(F.sum(col).cast("double").alias("__total"))
    return (
        join_back(df, total, by)
        .withColumn(out, F.col(col) / F.nullif(F.col("__total"), F.lit(0.0)))
        .drop("__total")
    )


def index_to_max(df: DataFrame, col: str, by=(), out="pct_of_max") -> DataFrame:
    top = df.groupBy(*_names(by)).agg(
        F.max(F.coalesce(F.col(col), F.lit(0.0))).cast("double").alias("__top")
    )
    return (
        join_back(df, top, by)
        .withColumn(out, F.coalesce(F.col(col), F.lit(0.0)) / F.nullif(F.col("__top"), F.lit(0.0)) * 100)
        .drop("__top")
    )


def top_k_per_group(df: DataFrame, by, order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """First k rows per group. Spark cuts each group to k rows before the
    shuffle (WindowGroupLimit), so a huge group costs k rows per input task."""
    rn = "__rn" if out is None else out
    w = Window.partitionBy(*_names(by)).orderBy(*order)
    picked = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return picked.drop(rn) if out is None else picked


def first_per_key(df: DataFrame, key, order: Sequence[Column]) -> DataFrame:
    return top_k_per_group(df, key, order, 1)


def latest(df: DataFrame, by, ts: str) -> DataFrame:
    """All rows carrying the group's newest timestamp."""
    by = _names(by)
    newest = df.groupBy(*by).agg(F.max(ts).alias(ts))
    return df.join(newest, [*by, ts], "left_semi")


def rank_in_group(df: DataFrame, by, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Exact row_number per group, of any size.

    All rows are sorted by range into slices, whatever groups they belong to,
    and written once with the number of their slice: the bounds of a range
    partitioning come from a sample, so a second one could cut elsewhere. From
    the files each group is numbered within each slice, and the rows it has in
    the slices before are added. Groups bounded by nature (a race field) are
    better numbered by a plain window.
    """
    by = _names(by)
    placed = stage(df.repartitionByRange(*by, *order).withColumn("__slice", F.spark_partition_id()), "slices")
    sizes = placed.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__m"))
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__slice", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__slice").orderBy(*order)
    numbered = placed.withColumn("__in", F.row_number().over(inside))
    return (
        join_back(numbered, offsets, [*by, "__slice"])
        .withColumn(out, (F.col("__before") + F.col("__in")).cast("int"))
        .drop("__slice", "__before", "__in")
    )


def with_order(df: DataFrame, array_col: str, item="item", position="position") -> DataFrame:
    """One row per array element, numbered from 1."""
    rest = [c for c in df.columns if c != array_col]
    return df.select(*rest, F.posexplode(array_col).alias("__pos", item)).select(
        *rest, item, (F.col("__pos") + 1).alias(position)
    )


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """Left join by key; the listed columns take their default when the row or
    the value is missing or zero. Table keys are unique."""
    found = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in defaults])
    out = df.join(found, list(keys), "left")
    for name, default in defaults.items():
        value = F.coalesce(F.nullif(F.col(f"__{name}").cast("double"), F.lit(0.0)), as_default(default))
        out = out.withColumn(name, value).drop(f"__{name}")
    return out


def as_default(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("double")


def lookup_fallback(df: DataFrame, first: DataFrame, second: DataFrame, key1: str, key2: str, cols: Sequence[str]) -> DataFrame:
    """Values by key1, and where no key1 row exists, by key2."""
    a = first.select(key1, F.struct(*cols).alias("__a"))
    b = second.select(key2, F.struct(*cols).alias("__b"))
    out = df.join(a, key1, "left").join(b, key2, "left")
    hit = F.coalesce("__a", "__b")
    for c in cols:
        out = out.withColumn(c, hit[c])
    return out.drop("__a", "__b")


def missing_keys(df: DataFrame, ref: DataFrame, key) -> DataFrame:
    """Distinct keys of df that ref does not hold."""
    key = _names(key)
    return df.select(*key).dropna().distinct().join(ref.select(*key), key, "left_anti")


def with_keys(df: DataFrame, ref: DataFrame, key) -> DataFrame:
    """Rows of df whose key occurs in ref."""
    key = _names(key)
    return df.join(ref.select(*key), key, "left_semi")
