"""Running totals and numbering that no single hot group can slow down.

A window over one group runs in one task. Here rows are range partitioned by
(group, order) first, so a large group is spread over many slices; every slice
computes its own running totals and adds what the group had before the slice.
At most one group continues into a slice, hence the table of carried totals
has no more rows than there are slices and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.session import cut_lineage, read_back, scratch_path, write_counted

SLICE = "_slice"
POSITION = "position"
# Rows of a group that one task numbers; it sorts them, on disk if need be.
HEAVY_ROWS = 1_000_000


def sliced(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], label: str = "sliced", at: str | None = None
) -> DataFrame:
    """Add the number of the slice a row falls in; `order` is unique in a group.

    The result is a written table, because slice numbers must stay the same
    for every later pass over it. Under the name `at` a row keeps a number that
    rises with `order` in its group: later passes need not carry what gave the order.
    """
    ranged = df.repartitionByRange(*group, *order)
    if at:
        ranged = ranged.sortWithinPartitions(*group, *order).withColumn(at, F.monotonically_increasing_id())
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()), label)


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], **totals: tuple[str, str]) -> DataFrame:
    """Add running totals to a sliced table: `name=("sum" | "max", column)`.

    Totals include the row itself. A running `max` skips NULL.
    """
    combine = {"sum": F.sum, "max": F.max}
    key = [SLICE, *group]
    upto_row = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select("*", *[combine[how](column).over(upto_row).alias(name) for name, (how, column) in totals.items()])

    per_slice = df.groupBy(*key).agg(*[combine[how](column).alias(name) for name, (how, column) in totals.items()])
    by_group = Window.partitionBy(*(group or [F.lit(0)])).orderBy(SLICE)
    earlier = by_group.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_slice.select(
            *key,
            F.row_number().over(by_group).alias("_slice_nth"),
            *[combine[how](name).over(earlier).alias(f"_{name}") for name, (how, _) in totals.items()],
        )
        .where("_slice_nth > 1")
        .drop("_slice_nth")
    )
    joined = local.join(F.broadcast(carried), key, "left")
    merged = {
        name: (
            F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0))
            if how == "sum"
            else F.greatest(F.col(name), F.col(f"_{name}"))
        )
        for name, (how, _) in totals.items()
    }
    return joined.withColumns(merged).drop(*[f"_{name}" for name in totals])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, label: str = "numbered") -> DataFrame:
    """Number all rows from 1 in the given unique order, without one global task."""
    one = f"_{name}_one"
    rows = sliced(df.withColumn(one, F.lit(1).cast("bigint")), [], order, label)
    return running(rows, [], order, **{name: ("sum", one)}).drop(SLICE, one)


def placed(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    label: str = "placed",
    total: str | None = None,
    heavy_rows: int | None = None,
) -> DataFrame:
    """Add `position`, from 0 within each group, and under the name `total` the size of the group.

    One pass counts the groups. Those with up to `heavy_rows` rows (`HEAVY_ROWS` unless
    given) are numbered where one shuffle on the group brings them, which a join on the
    group can use again; larger ones by slices. A group is the values of its columns, none NULL.
    """
    limit = HEAVY_ROWS if heavy_rows is None else heavy_rows
    heavy = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit)
    heavy = cut_lineage(heavy, f"{label}-heavy")
    few = heavy.isEmpty()
    light = df if few else df.join(heavy, [*group], "left_anti")
    same = Window.partitionBy(*group)
    numbers = {POSITION: (F.row_number().over(same.orderBy(*order)) - 1).cast("bigint")}
    if total:
        numbers[total] = F.count(F.lit(1)).over(same)
    light = light.withColumns(numbers)
    if few:
        return light
    ones = df.join(heavy, [*group]).withColumn("_one", F.lit(1).cast("bigint"))
    rows = running(sliced(ones.select(*df.columns, "_size", "_one"), group, order, label), group, order, _upto=("sum", "_one"))
    rows = rows.withColumn(POSITION, F.col("_upto") - 1).withColumnRenamed("_size", total or "_size")
    return light.unionByName(rows.select(*light.columns))
