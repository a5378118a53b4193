"""Totals of all rows before a row, in an order over the whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut


def running_before(rows: DataFrame, value: str, order: list[str | Column], name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows that come before in ``order``, which tells all rows apart; a NULL adds nothing.

    The table is dealt by ranges of the order and written, with the number of the range of each row. Each range is summed where it lies, so only
    one number for each range meets in one place; rows are then added up within their range.
    """
    spark, part = rows.sparkSession, "evigraph_range"
    dealt = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sums = sorted((r[0], r[1] or 0) for r in dealt.groupBy(part).agg(F.sum(value)).collect())
    kind = dealt.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    starts = spark.createDataFrame(list(zip((p for p, _ in sums), accumulate((s for _, s in sums), initial=0))), f"{part} int, evigraph_start {kind}")
    inside = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.withColumn("evigraph_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), part).select(*rows.columns, (F.col("evigraph_start") + F.col("evigraph_inside")).alias(name))
