"""Positions in a total order and list ranking, without a task that holds all rows.

`positions` deals the rows by range over the order, numbers them inside each part, and adds the number of rows of the
parts before (one row a part, so the offsets are bounded by the number of parts). `list_ranked` follows successor
pointers by pointer jumping: each round joins the list with itself, so that every pointer skips twice as far, and adds
the weights it skips; after ceil(log2(length)) rounds every element holds the sums of the weights from itself to the
end of its list. Both cut their lineage to the shared folder, so that a lost executor costs one step, not the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payouts.llm.common import cut, fresh


def positions(frame: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The frame with `name`, 0-based and dense, in `order`; the order must be total (ties get an arbitrary order).

    An empty frame gives an empty frame. A key that holds many rows is split over several parts by the range.
    """
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, inside, count, before = fresh(frame, "_part", "_inside", "_count", "_before")
    spread = cut(frame.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn(part, F.spark_partition_id()).withColumn(inside, F.monotonically_increasing_id()))
    counts = spread.groupBy(part).agg(F.count(F.lit(1)).alias(count))
    offsets = counts.select(part, F.coalesce(F.sum(count).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    placed = spread.join(F.broadcast(offsets), part)  # one row a part
    local = F.col(inside) - F.shiftleft(F.col(part).cast("long"), 33)
    return placed.withColumn(name, F.col(before) + local).drop(part, inside, before)


def list_ranked(arcs: DataFrame, node: str, successor: str, weights: list[str]) -> DataFrame:
    """For every element of singly linked lists, the sums of `weights` from it (included) to the end of its list.

    `arcs` has one row per element: its identifier `node` (unique, not null), its `successor` (null at the end of a
    list) and long weights. Returns (node, sums under the weights' names, `steps`: elements from it to the end).
    Cycles never end their pointers and raise after 64 rounds. An empty frame gives an empty frame.
    """
    steps = fresh(arcs, "steps")[0]
    nxt, sums = fresh(arcs, "_next")[0], fresh(arcs, *[f"_{w}" for w in weights])
    state = cut(arcs.select(F.col(node), F.col(successor).alias(nxt), *[F.col(w).cast("long").alias(s) for w, s in zip(weights, sums)], F.lit(1).cast("long").alias(steps)))
    for _ in range(64):
        if state.filter(F.col(nxt).isNotNull()).limit(1).count() == 0:
            break
        ahead = state.select(F.col(node).alias("_ahead"), F.col(nxt).alias("_ahead_next"), *[F.col(s).alias(f"_ahead{s}") for s in sums], F.col(steps).alias("_ahead_steps"))
        joined = state.join(ahead, F.col(nxt) == F.col("_ahead"), "left")
        state = cut(joined.select(
            F.col(node), F.col("_ahead_next").alias(nxt),
            *[(F.col(s) + F.coalesce(F.col(f"_ahead{s}"), F.lit(0))).alias(s) for s in sums],
            (F.col(steps) + F.coalesce(F.col("_ahead_steps"), F.lit(0))).alias(steps)))
    else:
        raise ValueError("the successors form a cycle")
    return state.select(F.col(node), *[F.col(s).alias(w) for w, s in zip(weights, sums)], F.col(steps))
