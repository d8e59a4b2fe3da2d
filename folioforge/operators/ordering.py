"""Places in a global order, with running sums, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import work_folder


def numbered(df: DataFrame, order: list[Column], place: str, sums: dict[str, str] | None = None, one_task: bool = False) -> DataFrame:
    """Add the place of each row from 1 in the order, and for {column: name} the sum of a column up to the row.

    Rows are dealt by ranges of the order and written; a range's first place and sums come from the
    totals of the ranges before it, one row a range. Rows that are equal in the order go to one range,
    and which of them comes first is not defined. `one_task` is for tables known to be small.
    """
    sums = sums or {}
    if one_task:
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({place: F.row_number().over(Window.orderBy(*order)).cast("long")} | {name: F.sum(c).over(whole) for c, name in sums.items()})
    work_folder(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for c, name in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ["_n", *(f"_sum_{name}" for name in sums.values())]])
    own = Window.partitionBy("_range").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(firsts), "_range")  # a row for each partition
    out = out.withColumns({place: (F.row_number().over(own) + F.col("_before_n")).cast("long")} | {name: F.sum(c).over(upto) + F.col(f"_before_sum_{name}") for c, name in sums.items()})
    return out.drop("_range", "_before_n", *(f"_before_sum_{name}" for name in sums.values()))
