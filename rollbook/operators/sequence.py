"""Numbering, ranking and carry-forward without putting a whole table or group in one task.

A window over one hot group sorts that group in a single task.  The operators here cut the
order into blocks of bounded size, work inside the blocks in parallel, and link the blocks
through a table that has one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook.session import checkpointed

#: Width of a block of row numbers, and so the most rows one window group can hold.
BLOCK = 1 << 20


def _before(table: DataFrame, order: str, count: str) -> Column:
    """Rows in all earlier blocks; ``table`` has one row per block."""
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal to each other."""
    named = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_r_{key}")) for key in keys])
    return left.join(named, same).drop(*[f"_r_{key}" for key in keys])


def sequence(
    df: DataFrame, order: str, into: str, fmt: str | None = None, start: Column | int = 1, block: int = BLOCK
) -> DataFrame:
    """Number rows ``start, start+1, ...`` by a unique LONG column.

    A block holds at most ``block`` rows because ``order`` is unique, and the table of block
    sizes has one row per block, so no task sees more than a bounded share of the rows.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_block", _before(sizes, "_block", "_size").alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    first = F.lit(start) if isinstance(start, int) else start
    number = (first + F.col("_offset") + inside - 1).cast("bigint")
    return (
        _beside(blocked, offsets, ["_block"])
        .withColumn(into, number if fmt is None else F.format_string(fmt, number))
        .drop("_block", "_offset")
    )


def number_first_seen(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    into: str = "n",
    fmt: str | None = None,
    start: Column | int = 1,
) -> DataFrame:
    """One row per key with its number in order of first appearance.

    ``order`` is any comparable column, also a struct.  Keys are ranked over range partitions,
    so the spacing of the order does not matter.
    """
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("first_seen"))
    ranked = global_rank(firsts, [F.col("first_seen").asc(), *[F.col(key).asc() for key in keys]], "_rank")
    number = ((F.lit(start) if isinstance(start, int) else start) + F.col("_rank") - 1).cast("bigint")
    return ranked.withColumn(into, number if fmt is None else F.format_string(fmt, number)).drop("_rank")


def global_rank(df: DataFrame, order: Sequence[Column], into: str = "rank", parts: int | None = None) -> DataFrame:
    """Position of every row in a total order, 1 first.

    The order must end in a unique key, so that equal values spread over range partitions.
    Range limits come from a sample and may differ between runs of a plan, therefore the
    placed rows are checkpointed before their partitions are counted.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", _before(sizes, "_part", "_size").alias("_offset"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")  # at most ``parts`` rows
        .withColumn(into, (F.col("_offset") + within + 1).cast("bigint"))
        .drop("_place", "_part", "_offset")
    )


def group_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "rank", parts: int | None = None
) -> DataFrame:
    """Position of every row among the rows with the same keys, 1 first.

    The rows are ranked over all groups at once and every group's ranks are then shifted to
    start at 1, so a group of any size is spread over all partitions.  ``order`` ends in a
    unique key.
    """
    ranked = global_rank(df, [F.col(c).asc() for c in (*keys, *order)], "_overall", parts)
    starts = ranked.groupBy(*keys).agg(F.min("_overall").alias("_start"))
    return (
        _beside(ranked, starts, keys)
        .withColumn(into, (F.col("_overall") - F.col("_start") + 1).cast("bigint"))
        .drop("_overall", "_start")
    )


def carry_forward(
    rows: DataFrame, part: Sequence[str], order: str, value: str, into: str | None = None, block: int = BLOCK
) -> DataFrame:
    """Fill ``value`` from the last row of the same part that has one.

    ``order`` is a unique LONG per part.  Each block inherits the last value of the blocks
    before it, so a part of any length is filled block by block in parallel.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    lasts = blocked.groupBy(*part, "_block").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
    )
    earlier = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inherited = lasts.select(*part, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_inherited"))
    inside = Window.partitionBy(*part, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_inherited"))
    return _beside(blocked, inherited, [*part, "_block"]).withColumn(into or value, filled).drop("_block", "_inherited")


def first_candidate(candidates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The lowest row of every key by ``order``, by an aggregate that combines before the shuffle."""
    others = [c for c in candidates.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("_best")
    return candidates.groupBy(*keys).agg(best).select(*keys, "_best.*")
