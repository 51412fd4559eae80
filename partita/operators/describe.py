"""Descriptive aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.ranks import quantiles


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "attribute", value: str = "value") -> DataFrame:
    """Long form: one row per row and column."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keys, F.inline(cells))


def describe_table(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, minimum, median and maximum of each column."""
    r = lambda c: F.round(c, digits)
    long = unpivot(df, columns)
    one = long.groupBy("attribute").agg(
        F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("sd"), r(F.min("value")).alias("low"), r(F.max("value")).alias("high")
    )
    middle = quantiles(long, "value", {"median": 0.5}, ["attribute"])
    return one.join(middle, "attribute", "left").select("attribute", "n", "mean", "sd", "low", r(F.col("median")).alias("median"), "high")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) below the diagonal; rows that lack either value are left out of the pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    one = df.agg(*[F.corr(a, b).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("r")) for i, (a, b) in enumerate(pairs)])))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, missing, present), most missing first."""
    one = df.agg(*[F.count(c).alias(c) for c in columns], F.count("*").alias("_n"))
    cells = [F.struct(F.lit(c).alias("attribute"), (F.col("_n") - F.col(c)).alias("missing"), F.col(c).alias("present")) for c in columns]
    return one.select(F.inline(F.array(*cells))).orderBy(F.desc("missing"), "attribute")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def group_mean_std(df: DataFrame, group: str, value: str, digits: int = 2) -> DataFrame:
    """Mean and sample deviation of a covariate per group."""
    return df.groupBy(group).agg(F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("sd"))


def category_share(df: DataFrame, group: str, category: str, digits: int = 2) -> DataFrame:
    """Each category's count per group, as a share of the category and of the group, in per cent."""
    counts = df.groupBy(group, category).agg(F.count("*").alias("n"))
    share = lambda by: F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(by)), digits)
    return counts.select(group, category, "n", share(category).alias("of_category"), share(group).alias("of_group"))


def boxplot_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, mean and whisker ends (the last values within 1.5 interquartile ranges) per group.

    The second pass joins the quartiles of the groups back to the rows; hot groups split like any skewed join.
    """
    means = df.groupBy(group).agg(F.avg(value).alias("mean"))
    q = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group]).join(means, group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.select(group, value).join(q, group).filter((F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach))
    return inside.groupBy(group, "q1", "median", "q3", "mean").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def contingency_table(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, category, n) for every pair of occurring values, zeros filled, aligned by value. Rows with a null in either are left out.

    The pairs come from the two small sets of values, each row carrying the array of all categories.
    """
    counts = df.filter(F.col(group).isNotNull() & F.col(category).isNotNull()).groupBy(group, category).agg(F.count("*").alias("n"))
    every = counts.groupBy().agg(F.collect_set(category).alias("_all"))
    have = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(category, "n"))).alias("_n"))
    both = have.withColumn("_one", F.lit(1)).join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one")  # a single row
    return both.select(group, F.explode("_all").alias(category), "_n").select(group, category, F.coalesce(F.col("_n")[F.col(category)], F.lit(0)).alias("n"))
