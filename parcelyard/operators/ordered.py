"""Running totals and neighbours over a global order without one task for all rows.

Rows are dealt by ranges of the order and written once; each range works alone,
and only a few numbers per range are combined across ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_table

PART = "_part"


def by_path(path: str = "path") -> list[Column]:
    """Path order that ignores case: folded to upper case, then the path itself for ties."""
    return [F.upper(F.col(path)), F.col(path)]


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` cut into ranges of the order, with the range's number in ``_part``; kept as a table so that the cuts are fixed."""
    return shared_table(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def within(order: list[Column]):
    return W.partitionBy(PART).orderBy(*order)


def carried(totals: DataFrame, names: list[str]) -> DataFrame:
    """For each range, the sum of the earlier ranges' totals: a row per range, however many rows those have."""
    w = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(PART, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_c_{n}") for n in names])


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """``df`` with the running total of each expression over the order, before (or with) the row itself. Ties must be broken by the order."""
    names = list(sums)
    rows = ranged(df.withColumns({f"_v_{n}": e for n, e in sums.items()}), order)
    totals = rows.groupBy(PART).agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    frame = within(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0)) for n in names})
    out = local.join(carried(totals, names), PART)
    return out.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in names])


def previous(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the value of the row before in the order, null for the first."""
    rows = ranged(df.withColumn("_v", value), order)
    local = rows.withColumn("_lag", F.lag("_v").over(within(order))).withColumn("_first", F.row_number().over(within(order)) == 1)
    last = rows.groupBy(PART).agg(F.max_by("_v", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias("_last"))
    before = last.select(PART, F.lag("_last").over(W.orderBy(PART)).alias("_before"))
    out = local.join(before, PART, "left")
    return out.select(*df.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")).alias(name))


def take_while(df: DataFrame, order: list[Column], size: Column, limit: int) -> DataFrame:
    """Rows from the start of the order while the running size stays within ``limit`` (F6). Sizes are not negative."""
    return running(df, order, {"_sum": size}, inclusive=True).filter(F.col("_sum") <= limit).select(*df.columns)
