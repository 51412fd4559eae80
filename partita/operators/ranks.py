"""Global order without a global sort in one task: places, running totals, smallest rows and exact quantiles.

Rows are range-partitioned once and written with their partition number; a row's place is its place in its partition
plus what lies in the partitions before. The partitioned table is written because a second evaluation would sample
other bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.sources.scratch import stored


def running_total(df: DataFrame, order: Sequence[str], amount: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """df with `before`: the sum of `amount` (1 each by default) over the rows before, within `by`. Order ties must not matter or be broken by `order`."""
    one = df if amount else df.withColumn("_one", F.lit(1))
    name = amount or "_one"
    ranged = stored(one.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    above = lambda w: F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per partition and group in it: partitions are ranges, so about as many as partitions and groups
    sizes = ranged.groupBy("_part", *by).agg(F.sum(name).alias(name))
    base = sizes.withColumn("_base", above(Window.partitionBy(*by).orderBy("_part"))).drop(name)
    placed = ranged.withColumn("_within", above(Window.partitionBy("_part", *by).orderBy(*order)))
    out = placed.join(base, ["_part", *by]).withColumn("before", F.col("_base") + F.col("_within"))
    return out.select(*df.columns, "before")


def smallest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n first rows in an order that leaves no ties, for any n: nothing is gathered in one task."""
    return running_total(df, order).filter(F.col("before") < n).drop("before")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column per entry of probs): exact quantiles with linear interpolation, nulls left out. Values are counted before they are ordered."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    places = running_total(counts, [value], "_n", by)
    totals = places.groupBy(*by).agg(F.sum("_n").alias("_total"))
    both = places.join(totals, list(by)) if by else places.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k")
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("_n")), F.col(value)))
    aggs = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("_total") - 1)
        aggs += [at(F.floor(place)).alias(f"_l_{name}"), at(F.ceil(place)).alias(f"_h_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")]
    out = both.groupBy(*by).agg(*aggs)
    mixed = [(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs]
    return out.select(*by, *mixed)
