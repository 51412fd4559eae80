"""Projection, recoding, sampling and weighting of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.operators.ranks import running_total, smallest


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in the given order; a missing one is an error that names it."""
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(absent)}")
    return df.select(*columns)


def select_by_pattern(df: DataFrame, starts: str, not_ends: Sequence[str] = ()) -> DataFrame:
    """Columns whose name starts so and does not end in one of `not_ends`."""
    return df.select(*[c for c in df.columns if c.startswith(starts) and not c.endswith(tuple(not_ends) or ("\0",))])


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Casts to double; what is no number becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns})


def composite_score(items: Sequence[str], most: float | None = None) -> Column:
    """Sum of items, null if any item is; divided by the theoretical maximum if given."""
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    return total if most is None else total / F.lit(float(most))


def recode(df: DataFrame, column: str, labels: Mapping[str, str], into: str) -> DataFrame:
    """Category codes to labels, and their rank in the mapping's order; unknown codes get null."""
    lookup = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, i)])
    key = F.col(column).cast("string")
    return df.withColumns({into: lookup[key], f"{into}_rank": ranks[key]})


def attach(left: DataFrame, right: DataFrame, key: str, check: bool = False) -> DataFrame:
    """Tables of the same rows side by side, by row key. With check, unequal row counts are an error."""
    joined = left.join(right, key)
    if check:
        a, b, c = left.count(), right.count(), joined.count()
        if not a == b == c:
            raise ValueError(f"the keys do not pair up: {a} and {b} rows, {c} joined")
    return joined


def attribute_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, low, high) in one pass."""
    one = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in columns for n, f in (("l", F.min), ("h", F.max))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"{c}_l").alias("low"), F.col(f"{c}_h").alias("high")) for c in columns])))


def with_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df whose column metadata holds the bounds."""
    bounds = {r["attribute"]: [r["low"], r["high"]] for r in attribute_bounds(df, columns).collect()}
    return df.select(*[F.col(c).alias(c, metadata={"bounds": bounds[c]}) if c in bounds else F.col(c) for c in df.columns])


def compact_weighted(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Equal rows merged, their weights (1 each by default) added."""
    return df.groupBy(*columns).agg((F.sum(weight) if weight else F.count("*")).alias("weight"))


def _order(key: str, seed: int) -> Column:
    """A random-looking order that any engine can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def bottom_k_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k uniform rows: those with the smallest seeded digest of the key. A top-k by partition, no full sort."""
    return df.orderBy(_order(key, seed), key).limit(k)


def sample_for_budget(df: DataFrame, key: str, gigabytes: float, seed: int = 0) -> DataFrame:
    """As many rows as doubles of that width fit nine tenths of the budget."""
    return bottom_k_sample(df, key, int(0.9 * gigabytes * 1e9 / (8 * max(1, len(df.columns)))), seed)


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A seeded permutation of the rows."""
    return df.orderBy(_order(key, seed), key)


def split_weighted(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): n cases drawn without replacement in proportion to integer weights, and the rest, with their weights."""
    cases = df.select("*", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))).alias("_case")).filter(F.col(weight) >= 1)
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("_case").cast("string"), F.lit(str(seed))).cast("binary"))
    drawn = smallest(cases.select(key, "_case", digest.alias("_digest")), ["_digest", key, "_case"], n).groupBy(key).agg(F.count("*").alias("_drawn"))
    both = df.join(drawn, key, "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    train = both.filter("_drawn > 0").withColumn(weight, F.col("_drawn")).drop("_drawn")
    rest = F.col(weight) - F.col("_drawn")
    return train, both.filter(rest > 0).withColumn(weight, rest).drop("_drawn")


def fixed_batches(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with the number (from 0) of its batch of n rows in the order of a unique key; no task sorts the whole table."""
    return running_total(df, [key]).withColumn("batch", F.floor(F.col("before") / n)).drop("before")


def weighted_moments(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """(a, b, mean_a, mean_b, covariance): weighted, each pair over the rows that hold both, population divisor.

    Means are of all present values of a column; a pair without common rows has covariance 0. Values are centred
    before they are multiplied, so large offsets cost no digits.
    """
    w = F.col(weight)
    mean = lambda c: F.sum(F.when(F.col(c).isNotNull(), w * F.col(c))) / F.sum(F.when(F.col(c).isNotNull(), w))
    means = df.agg(*[F.coalesce(mean(c), F.lit(0.0)).alias(c) for c in columns]).first()
    centred = {c: F.col(c) - F.lit(means[c]) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[F.coalesce(F.sum(F.when(both(a, b), w * centred[a] * centred[b])) / F.sum(F.when(both(a, b), w)), F.lit(0.0)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(means[a]).alias("mean_a"), F.lit(means[b]).alias("mean_b"), F.col(str(i)).alias("covariance")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*rows)))
