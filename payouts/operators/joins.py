"""Joins and de-duplication that hold when one key owns a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["attach_row", "first_per_key", "lookup_join", "lookup_joins", "merge_by_key"]


def lookup_join(rows: DataFrame, dim: DataFrame, on: Sequence[str], flag: str | None = None) -> DataFrame:
    """Left join to a table that has one row per key; every input row comes back once.

    One join at every size: Spark broadcasts the table where it is small. Otherwise both
    sides are shuffled by key, and where a key, or the rows without one, fill a partition
    of ``rows``, adaptive execution splits that partition over several tasks, which a left
    join allows. Keep spark.sql.adaptive.enabled and .skewJoin.enabled on. ``flag`` names
    an optional column telling whether a row matched.
    """
    values = [c for c in dim.columns if c not in on]
    marked = dim.withColumn(flag, F.lit(True)) if flag else dim
    hit = [F.coalesce(F.col(flag), F.lit(False)).alias(flag)] if flag else []
    return rows.join(marked, list(on), "left").select(*rows.columns, *values, *hit)


def lookup_joins(rows: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str], str | None]]) -> DataFrame:
    """Several lookups in a row, as (table, key columns, flag)."""
    for dim, on, flag in lookups:
        rows = lookup_join(rows, dim, on, flag=flag)
    return rows


def attach_row(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a frame that has one row (an aggregate without keys)."""
    single = F.broadcast(one_row.withColumn("_one", F.lit(True)))
    return rows.withColumn("_one", F.lit(True)).join(single, "_one", "left").drop("_one")


def merge_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of two tables with one row per key side by side, for every key of either.

    One aggregation over their union: the same rows as a full outer join, with a size
    estimate that stays the sum of both.
    """
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(key).agg(*[F.max(c).alias(c) for c in both.columns if c != key])


def first_per_key(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under an explicit order.

    Spark prunes each map task to its own first row per key before the shuffle, so a hot
    key sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
