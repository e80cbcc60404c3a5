"""Joins and running totals for groups of any size.

A window over a whole group sorts that group in one task, and a plain join sends all rows of a
key to one task. Both fail when a group holds a third of a large table. The shapes below split
such groups and still give exact results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import durable

BLOCK_BITS = 16
PAGES_PER_BLOCK = 1 << BLOCK_BITS
#: Keys that are cut into slices at most, which bounds what is broadcast; every other key owns less
#: than one part in so many of the rows.
HEAVY_KEYS = 10_000
#: Rows of a slice: a key with more of them gets as many slices as it takes.
SLICE_ROWS = 4096


def page_block(page_no: Column) -> Column:
    """Block of a page number; with the document it makes a join key of bounded size.

    Never NULL, so that no filter is inferred for one use of a shared shuffle and not the other.
    """
    return F.coalesce(F.shiftright(page_no - 1, BLOCK_BITS), F.lit(0))


def spread_join(
    many: DataFrame,
    few: DataFrame,
    on: list[str],
    spread_by: list[str],
    rows: str | None = None,
) -> DataFrame:
    """Inner join where some keys may own much of ``many``.

    The heaviest keys of ``many`` come from a pre-aggregated count, or from the column ``rows``
    of ``few`` when that already holds it. Their rows are cut into slices of about ``SLICE_ROWS``
    and the matching rows of ``few`` are repeated per slice, so that no task gets more than a
    slice of a key, however many rows it has; all other rows join as usual.
    """
    if rows is None:
        counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        counts = few.select(*on, F.col(rows).alias("_rows"))
    heavy = (
        counts.filter(F.col("_rows") > SLICE_ROWS)
        .orderBy(F.desc("_rows"))
        .limit(HEAVY_KEYS)
        .select(*on, F.ceil(F.col("_rows") / SLICE_ROWS).cast("int").alias("_slices"))
    )
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    slice_no = F.pmod(F.xxhash64(*spread_by), slices).cast("int")
    sliced = many.join(F.broadcast(heavy), on, "left").withColumn("_slice", slice_no)
    repeated = few.join(F.broadcast(heavy), on, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return sliced.drop("_slices").join(repeated.drop("_slices"), [*on, "_slice"]).drop("_slice")


def running_totals(
    df: DataFrame, group: str, order: list[str], value: str | None = None
) -> DataFrame:
    """Adds the position of each row in its group and running totals, without a group in one task.

    New columns: ``_position`` (1-based), ``_group_size`` and, when ``value`` is given,
    ``_before`` (sum of ``value`` over the earlier rows of the group).

    Rows are range partitioned by group and order, which gives partitions of similar size also
    inside one large group. Positions are counted within a partition, and the totals of the
    earlier partitions, one row per group and partition, are added. ``order`` must be unique
    within the group. The partition number is fixed by a checkpoint before both uses.
    """
    amount = F.col(value) if value else F.lit(0)
    placed = durable(
        df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    )

    inside = Window.partitionBy("_part", group).orderBy(*order)
    local = placed.withColumn("_position", F.row_number().over(inside))
    if value:
        local = local.withColumn(
            "_before",
            F.coalesce(
                F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )

    sizes = placed.groupBy("_part", group).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_amount")
    )
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        group,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_amount_before"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("_group_size"),
    )

    # a NULL group is a group like any other
    found = offsets.withColumnsRenamed({"_part": "_of_part", group: "_of_group"})
    same = (F.col("_part") == F.col("_of_part")) & F.col(group).eqNullSafe(F.col("_of_group"))
    joined = local.join(found, same).drop("_of_part", "_of_group").withColumn(
        "_position", F.col("_position") + F.col("_rows_before")
    )
    if value:
        joined = joined.withColumn("_before", F.col("_before") + F.col("_amount_before"))
    return joined.drop("_part", "_rows_before", "_amount_before")
