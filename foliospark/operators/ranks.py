"""Places in sorted groups of any size: prefix sums over range partitions.

A window over a group puts the group into one task. Here rows are cut into ranges by group
and order, so that a group of any size lies in many partitions; sums are taken within the
ranges, and what the ranges before hold of a group is added. Only rows that agree in group
and order stay together: where many may, aggregate them to one row with a weight first.

The ranges are written under ``spark.checkpoint.dir``, since the number of a range must be
the same when it is read twice, also after an executor was lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.writers import stored


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_sums(rows: DataFrame, by: tuple[str, ...], order: tuple[str | Column, ...], weight: Column | None = None, before: str = "before", total: str | None = None) -> DataFrame:
    """``rows`` with the sum of the weights (one each by default) of the rows before them in
    their group, and with ``total`` that of the whole group. Groups with null keys count."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    order = tuple(_col(c) for c in order)
    cut = rows.withColumn("_w", w).repartitionByRange(*[F.col(c) for c in by], *order)
    held = stored(cut.withColumn("_part", F.spark_partition_id()), "ranges")
    inner = F.sum("_w").over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w")
    # a row for each range that a group has rows in: few, whatever the size of the group
    sums = held.groupBy("_part", *by).agg(F.sum("_w").alias("_s"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = sums.withColumn("_ahead", F.sum("_s").over(group.orderBy("_part")) - F.col("_s")).withColumn("_all", F.sum("_s").over(group))
    ahead = ahead.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "_ahead", "_all")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    out = held.withColumn("_inner", inner).join(ahead, same)
    return out.select(*[F.col(c) for c in rows.columns], (F.col("_inner") + F.col("_ahead")).alias(before), *([F.col("_all").alias(total)] if total else []))


def order_statistics(rows: DataFrame, by: tuple[str, ...], value: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at places of each group's sorted values: name -> place, from 1 on, of the number of values.

    Nulls are no values; a group without any is left out. Equal values are counted before
    the shuffle, and no list is built.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    at = prefix_sums(counts, by, (value,), F.col("_n"), "_before", "_total")
    found = {k: place(F.col("_total")) for k, place in picks.items()}
    groups = at.groupBy(*by) if by else at.groupBy(F.lit(0).alias("_g"))
    out = groups.agg(*[F.max(F.when((F.col("_before") < p) & (p <= F.col("_before") + F.col("_n")), F.col(value))).alias(k) for k, p in found.items()])
    return out if by else out.drop("_g")


def smallest(rows: DataFrame, by: tuple[str, ...], quota: DataFrame, order: tuple[str | Column, ...], rank: str = "rank") -> DataFrame:
    """Of each group the first ``quota`` rows in order; ``quota`` has the group's keys and a number."""
    at = prefix_sums(rows, by, order, before="_k")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_q{i}"))
    limits = quota.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(by)], "quota")
    return at.join(limits, same).where("_k < quota").select(*rows.columns, (F.col("_k") + 1).alias(rank))
