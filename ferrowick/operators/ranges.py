"""Running sums and rows before, over a whole table or groups of any size, without a window that one task would hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowick.operators.lineage import written


def running(df: DataFrame, order: list[str], *, group: list[str] | None = None, sums: Mapping[str, Column] | None = None, before: Mapping[str, str] | None = None) -> DataFrame:
    """df with, in the ``order`` of each ``group`` (or of the whole table): for each name in ``sums`` the sum over all rows before, 0 for
    the first; for each name in ``before`` that column of the row just before, null for the first.

    The rows are cut into ranges of (group, order). Each range of a group is summed on its own and written, once, with
    its range's number; what the ranges before add is a row for each range, and for groups only of those that a cut
    divides, two for each range at most. So a group that holds most of the table is spread as any other. Group columns must not be
    null; rows equal in all of (group, order) come in any order."""
    group, sums, before = group or [], dict(sums or {}), dict(before or {})
    own = Window.partitionBy("part_", *group).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    # the number is part of what is written: a plan evaluated twice could cut its ranges elsewhere
    cut = df.withColumns({f"{n}_own_": v for n, v in sums.items()}).repartitionByRange(*group, *order).withColumn("part_", F.spark_partition_id())
    columns = {n: F.coalesce(F.sum(f"{n}_own_").over(upto), F.lit(0)) for n in sums} | {n: F.lag(c).over(own) for n, c in before.items()}
    held = written(cut.withColumns(columns))
    some = held
    if group:
        ends = held.groupBy("part_").agg(F.min(F.struct(*group)).alias("a"), F.max(F.struct(*group)).alias("z"))
        divided = ends.select("part_", F.explode(F.array_distinct(F.array("a", "z"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g.*")
        some = held.join(F.broadcast(divided), group, "left_semi")  # at most two groups for each range
    totals = some.groupBy("part_", *group).agg(F.count(F.lit(1)).alias("rows_"), *[F.sum(f"{n}_own_").alias(f"{n}_all_") for n in sums], *[F.max_by(c, F.struct(*order)).alias(f"{n}_last_") for n, c in before.items()])
    ranges = Window.partitionBy(*group).orderBy("part_")
    carried = totals.select(
        "part_", *group, *[F.sum(f"{n}_all_").over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{n}_carry_") for n in sums], *[F.lag(f"{n}_last_").over(ranges).alias(f"{n}_carry_") for n in before]
    )
    found = held.join(F.broadcast(carried), ["part_", *group], "left")  # as few rows
    found = found.withColumns({n: F.col(n) + F.coalesce(f"{n}_carry_", F.lit(0)) for n in sums} | {n: F.coalesce(n, f"{n}_carry_") for n in before})
    return found.select(*df.columns, *sums, *before)


def running_before(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """The sum of ``value`` over all rows of the table before."""
    return running(df, order, sums={name: F.col(value)})
