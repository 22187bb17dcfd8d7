"""Running sums over ordered keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import durable


def running_sums(df: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """df with the sums of the `values` over the key's rows up to this one, in `order` (unique within a key).

    Rows are range-partitioned by (key, order), summed within each range, and the ranges' totals (one row per key and range)
    are added; so a key that holds a third of all rows is spread over many tasks. Null values count as 0.
    """
    own = df.withColumns({name: F.coalesce(v.cast("bigint"), F.lit(0)) for name, v in values.items()})
    ranged = durable(own.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(key, "_range").agg(*[F.sum(name).alias(name) for name in values])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_range", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in values])
    local = ranged.withColumns({name: F.sum(name).over(Window.partitionBy("_range", key).orderBy(order)) for name in values})
    whole = local.join(totals, [key, "_range"]).withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in values})
    return whole.drop("_range", *[f"_before_{name}" for name in values])


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """running_sums() of one value."""
    return running_sums(df, key, order, {name: value})
