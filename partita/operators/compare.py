"""Cohort comparison: rank, variance and contingency tests as Spark jobs; tails of the few results in NumPy."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.functions import special
from partita.operators.describe import contingency_table
from partita.operators.ranks import running_total
from partita.sources.scratch import stored


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, ties, rank) per distinct value: the mean rank of its rows. Values are counted before they are ranked."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    ranked = running_total(counts, [value], "ties", by)
    return ranked.withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2).drop("before")


def rank_sums(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: n, rank_sum; and of the whole test: total, tie_term = sum of t^3 - t.

    Counts per group and value are joined with the ranks of the values; the ranks come from range partitions.
    """
    cells = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("n"))
    ties = cells.groupBy(*by, value).agg(F.sum("n").alias("ties"))
    ranks = running_total(ties, [value], "ties", by).withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2)
    t = F.col("ties").cast("double")
    whole = ranks.groupBy(*by).agg(F.sum("ties").alias("total"), F.sum(t * t * t - t).alias("tie_term"))
    sums = cells.join(ranks, [*by, value]).groupBy(*by, group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))
    keys = by or ["_one"]
    one = {} if by else {"_one": F.lit(1)}
    return sums.withColumns(one).join(F.broadcast(whole.withColumns(one)), list(keys)).drop("_one")  # one row per test


def mann_whitney_stat(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """One row: n1, n2, u (of the first group), z with continuity and tie correction."""
    sums = rank_sums(df.filter(F.col(group).isin(first, second)), group, value)
    pick = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    wide = sums.agg(pick(first, "n").alias("n1"), pick(second, "n").alias("n2"), pick(first, "rank_sum").alias("r1"), F.max("total").alias("n"), F.max("tie_term").alias("tie"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    half = F.col("n1") * F.col("n2") / 2
    var = F.col("n1") * F.col("n2") / 12 * ((F.col("n") + 1) - F.col("tie") / (F.col("n") * (F.col("n") - 1)))
    z = F.greatest(F.abs(u - half) - 0.5, F.lit(0.0)) / F.nullif(F.sqrt(var), F.lit(0.0))  # null where all values are equal
    return wide.select("n1", "n2", u.alias("u"), z.alias("z"))


def mann_whitney(df: DataFrame, group: str, value: str, first, second) -> dict:
    r = mann_whitney_stat(df, group, value, first, second).first()
    return {"u": r["u"], "p": special.normal_two_sided(r["z"]) if r["z"] is not None else None}


def kruskal_wallis_stat(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per test: groups, total, h (tie-corrected)."""
    sums = rank_sums(df, group, value, by)
    n = F.max("total").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    return sums.groupBy(*by).agg(F.count("*").alias("groups"), F.max("total").alias("total"), (h / F.nullif(1 - F.max("tie_term") / F.nullif(n * n * n - n, F.lit(0.0)), F.lit(0.0))).alias("h"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> dict:
    r = kruskal_wallis_stat(df, group, value).first()
    return {"h": r["h"], "p": special.chi2_tail(r["h"], r["groups"] - 1)}


def tukey_stat(df: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, difference, q) for all pairs of groups, with groups and dof. The pairs are of group summaries."""
    present = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    parts = present.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("ss"))
    pooled = Window.partitionBy()
    parts = parts.withColumns({"groups": F.count("*").over(pooled), "dof": F.sum("n").over(pooled) - F.count("*").over(pooled)})
    parts = parts.withColumn("mse", F.sum("ss").over(pooled) / F.nullif(F.col("dof"), F.lit(0)))
    everyone = parts.groupBy("groups", "dof", "mse").agg(F.collect_list(F.struct(group, "n", "mean")).alias("all"))
    one, two = F.explode("all").alias("x"), F.explode("all").alias("y")
    pairs = everyone.select("groups", "dof", "mse", "all", one).select("groups", "dof", "mse", "x", two).filter(F.col("x")[group] < F.col("y")[group])
    gap = F.col("y.mean") - F.col("x.mean")
    q = F.abs(gap) / F.nullif(F.sqrt(F.col("mse") / 2 * (1 / F.col("x.n") + 1 / F.col("y.n"))), F.lit(0.0))
    return pairs.select(F.col("x")[group].alias("a"), F.col("y")[group].alias("b"), gap.alias("difference"), q.alias("q"), "groups", "dof")


def tukey_hsd(df: DataFrame, group: str, value: str, alpha: float = 0.01) -> pd.DataFrame:
    """All pairs of groups with the adjusted p and whether it rejects; the half-width of the interval is at that alpha."""
    out = tukey_stat(df, group, value).toPandas()  # a row per pair of groups
    if not len(out):
        return out.assign(p=[], reject=[], low=[], high=[])
    k, dof = int(out["groups"].iloc[0]), float(out["dof"].iloc[0])
    low, high = 0.0, 200.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if special.studentised_range_tail(mid, k, dof) > alpha else (low, mid)
    half = high * out["difference"].abs() / out["q"].where(out["q"] > 0)
    p = out["q"].map(lambda q: special.studentised_range_tail(q, k, dof))
    return out.assign(p=p, reject=p < alpha, low=out["difference"] - half, high=out["difference"] + half)


def chi2_independence_stat(df: DataFrame, group: str, category: str) -> DataFrame:
    """One row: dof, chi2; with one degree of freedom differences shrink by up to a half (Yates)."""
    cells = contingency_table(df.filter(F.col(group).isNotNull() & F.col(category).isNotNull()), group, category)
    total = F.sum("n").over(Window.partitionBy())
    cells = cells.withColumn("expected", F.sum("n").over(Window.partitionBy(group)) * F.sum("n").over(Window.partitionBy(category)) / total)
    # dof = (rows - 1)(columns - 1), from the grid's size and its distinct rows
    sized = cells.withColumns({"rows": F.size(F.collect_set(group).over(Window.partitionBy())), "cols": F.size(F.collect_set(category).over(Window.partitionBy()))})
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    gap = F.abs(F.col("n") - F.col("expected"))
    shrunk = gap - F.when(dof == 1, F.least(F.lit(0.5), gap)).otherwise(0.0)
    return sized.withColumns({"dof": dof, "term": shrunk * shrunk / F.col("expected")}).agg(F.max("dof").alias("dof"), F.sum("term").alias("chi2"))


def chi2_independence(df: DataFrame, group: str, category: str) -> dict:
    r = chi2_independence_stat(df, group, category).first()
    return {"chi2": r["chi2"], "dof": r["dof"], "p": special.chi2_tail(r["chi2"], r["dof"]) if r["dof"] else None}


def chi2_pairwise_stat(df: DataFrame, group: str, category: str) -> DataFrame:
    """(a, b, dof, chi2) of the independence test for every pair of groups: rows are counted once, then the counts of pairs meet by category.

    A pair's table has the categories that one of the two has. Null groups and categories are left out.
    """
    cells = df.filter(F.col(group).isNotNull() & F.col(category).isNotNull()).groupBy(F.col(group).alias("g"), F.col(category).alias("c")).agg(F.count("*").alias("n"))
    cells = stored(cells, "pair-cells")
    everyone = cells.groupBy("g").agg(F.sum("n").alias("t")).groupBy().agg(F.collect_list(F.struct("g", "t")).alias("all"))  # an entry per group
    pairs = everyone.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).filter("x.g < y.g").select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), F.col("x.t").alias("ta"), F.col("y.t").alias("tb"))
    side = lambda own, other, mine: cells.select(F.col("g").alias(own), "c", F.col("n").alias(mine)).join(pairs.select("a", "b"), own)
    left, right = side("a", "b", "na"), side("b", "a", "nb")
    table = left.join(right, ["a", "b", "c"], "full").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("na", "nb")}).join(pairs, ["a", "b"])
    dof = F.count("*").over(Window.partitionBy("a", "b")) - 1
    table = table.withColumn("dof", dof)
    terms = []
    for n, t in (("na", "ta"), ("nb", "tb")):
        expected = F.col(t) * (F.col("na") + F.col("nb")) / (F.col("ta") + F.col("tb"))
        gap = F.abs(F.col(n) - expected)
        terms.append((gap - F.when(F.col("dof") == 1, F.least(F.lit(0.5), gap)).otherwise(0.0)) ** 2 / expected)
    return table.groupBy("a", "b").agg(F.max("dof").alias("dof"), F.sum(terms[0] + terms[1]).alias("chi2"))


def chi2_pairwise(df: DataFrame, group: str, category: str) -> list[dict]:
    """The independence test for every pair of groups, one job for all of them."""
    rows = chi2_pairwise_stat(df, group, category).orderBy("a", "b").collect()  # a row per pair
    return [{"a": r["a"], "b": r["b"], "chi2": r["chi2"], "dof": r["dof"], "p": special.chi2_tail(r["chi2"], r["dof"]) if r["dof"] else None} for r in rows]


def chi2_goodness_of_fit_stat(df: DataFrame, group: str, category: str, observed, expected) -> DataFrame:
    """One row: categories, chi2 of one group's shares (in per cent) against another's."""
    cells = contingency_table(df.filter(F.col(group).isin(observed, expected)), group, category)
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy(group))
    wide = cells.withColumn("share", share).groupBy(category).agg(
        F.sum(F.when(F.col(group) == observed, F.col("share"))).alias("o"), F.sum(F.when(F.col(group) == expected, F.col("share"))).alias("e")
    )
    return wide.agg(F.count("*").alias("categories"), F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"))


def _rank_tests(df: DataFrame, partitions: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    by = ["partition", "covariate"]
    cells = F.array(*[F.struct(F.lit(p).alias("partition"), F.col(p).cast("string").alias("label")) for p in partitions])
    values = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value")) for c in numeric])
    long = df.select(F.inline(cells), values.alias("_v")).select("partition", "label", F.inline("_v")).filter("label is not null and value is not null")
    moments = long.groupBy(*by, "label").agg(F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("ss"))
    test = Window.partitionBy(*by)  # a row per group from here on
    parts = rank_sums(long, "label", "value", by).join(moments, [*by, "label"])
    parts = parts.withColumns({"groups": F.count("*").over(test), "mse": F.sum("ss").over(test) / F.nullif(F.max("total").over(test) - F.count("*").over(test), F.lit(0))})
    n = F.max("total").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    h = h / F.nullif(1 - F.max("tie_term") / F.nullif(n * n * n - n, F.lit(0.0)), F.lit(0.0))
    none = F.lit(None)
    kruskal = parts.filter("groups > 2").groupBy(*by, "groups").agg(h.alias("statistic"))
    kruskal = kruskal.select(*by, F.lit("kruskal_wallis").alias("test"), none.cast("string").alias("a"), none.cast("string").alias("b"), "statistic", none.cast("double").alias("z"), "groups", (F.col("groups") - 1).alias("dof"))
    x, y = parts.alias("x"), parts.alias("y")
    pairs = x.join(y, (F.col("x.partition") == F.col("y.partition")) & (F.col("x.covariate") == F.col("y.covariate")) & (F.col("x.label") < F.col("y.label")))
    n1, n2, total = F.col("x.n"), F.col("y.n"), F.col("x.total")
    u = F.col("x.rank_sum") - n1 * (n1 + 1) / 2
    spread = n1 * n2 / 12 * ((total + 1) - F.col("x.tie_term") / F.nullif(total * (total - 1), F.lit(0)))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.nullif(F.sqrt(spread), F.lit(0.0))
    q = F.abs(F.col("y.mean") - F.col("x.mean")) / F.nullif(F.sqrt(F.col("x.mse") / 2 * (1 / n1 + 1 / n2)), F.lit(0.0))
    two = F.col("x.groups") == 2
    pairs = pairs.select(
        "x.partition", "x.covariate", F.when(two, "mann_whitney").otherwise("tukey").alias("test"), F.col("x.label").alias("a"), F.col("y.label").alias("b"),
        F.when(two, u).otherwise(q).alias("statistic"), F.when(two, z).alias("z"), "x.groups", F.when(two, 1).otherwise(total - F.col("x.groups")).alias("dof"),
    )
    return kruskal.unionByName(pairs)


def _category_tests(df: DataFrame, partitions: Sequence[str], discrete: Sequence[str]) -> DataFrame:
    by = ["partition", "covariate"]
    cells = F.array(*[F.struct(F.lit(p).alias("partition"), F.col(p).cast("string").alias("label")) for p in partitions])
    values = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("category")) for c in discrete])
    long = df.select(F.inline(cells), values.alias("_v")).select("partition", "label", F.inline("_v")).filter("label is not null and category is not null")
    counts = long.groupBy(*by, "label", "category").agg(F.count("*").alias("n"))
    rows = counts.groupBy(*by, "label").agg(F.sum("n").alias("row"))
    columns = counts.groupBy(*by, "category").agg(F.sum("n").alias("column"))
    grid = rows.join(columns, by).join(counts, [*by, "label", "category"], "left")  # labels by categories of each test
    test = Window.partitionBy(*by)
    shape = {"labels": F.size(F.collect_set("label").over(test)), "categories": F.size(F.collect_set("category").over(test)), "total": F.sum(F.coalesce("n", F.lit(0))).over(test)}
    dof = (F.col("labels") - 1) * (F.col("categories") - 1)
    expected = F.col("row") * F.col("column") / F.col("total")
    gap = F.abs(F.coalesce("n", F.lit(0)) - expected)
    shrunk = gap - F.when(dof == 1, F.least(F.lit(0.5), gap)).otherwise(0.0)
    out = grid.withColumns(shape).withColumns({"dof": dof, "term": shrunk * shrunk / expected}).groupBy(*by).agg(F.sum("term").alias("statistic"), F.max("labels").alias("groups"), F.max("dof").alias("dof"))
    none = F.lit(None)
    return out.select(*by, F.lit("chi2").alias("test"), none.cast("string").alias("a"), none.cast("string").alias("b"), "statistic", none.cast("double").alias("z"), F.col("groups").cast("long"), F.col("dof").cast("long"))


def compare_partitions(df: DataFrame, partitions: Sequence[str], numeric: Sequence[str] = (), discrete: Sequence[str] = ()) -> DataFrame:
    """(partition, covariate, test, a, b, statistic, z, groups, dof): every partition against every covariate.

    Numeric covariates: for two groups mann_whitney (U of group a, and its z with continuity and tie correction), for more
    kruskal_wallis (H) and tukey (q of each pair of groups). Discrete ones: chi2 (with Yates' correction at one degree of
    freedom). All ranks come from one counting shuffle, all contingency tables from another, whatever the number of
    tests; rows without a label or a value are left out. A statistic without spread is null.
    """
    parts = ([_rank_tests(df, partitions, numeric)] if numeric else []) + ([_category_tests(df, partitions, discrete)] if discrete else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_p(results: DataFrame, alpha: float = 0.01) -> pd.DataFrame:
    """compare_partitions() results (a row per test) with p-values, and whether each rejects at `alpha`."""
    out = results.toPandas()

    def tail(r) -> float | None:
        x = r["z"] if r["test"] == "mann_whitney" else r["statistic"]
        if x is None or x != x:
            return None
        if r["test"] == "mann_whitney":
            return special.normal_two_sided(x)
        if r["test"] == "tukey":
            return special.studentised_range_tail(x, int(r["groups"]), float(r["dof"]))
        return special.chi2_tail(x, int(r["dof"])) if r["dof"] else None

    p = [tail(r) for r in out.to_dict("records")]
    return out.assign(p=p, reject=[x is not None and x < alpha for x in p])
