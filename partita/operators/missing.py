"""Hiding, locating, imputing and judging missing cells. Null is the one missing marker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.functions.draws import uniform

from partita.operators.describe import unpivot
from partita.operators.ranks import smallest


def locate_missing(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, missing) for rows that lack a cell: the names of the columns, in the given order."""
    names = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(key, names.alias("missing")).filter(F.size("missing") > 0)


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def hide_cells(df: DataFrame, key: str, columns: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """(key, attribute) of int(rows * columns * share) distinct cells: those with the smallest seeded digest.

    While a column would lose every cell the seed grows by one, so the choice ends.
    """
    rows = df.count()
    n = int(rows * len(columns) * share)
    cells = df.select(key, F.explode(F.array(*[F.lit(c) for c in columns])).alias("attribute"))
    for s in range(seed, seed + 100):
        digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), "attribute", F.lit(str(s))).cast("binary"))
        chosen = smallest(cells.withColumn("_digest", digest), ["_digest", key, "attribute"], n).drop("_digest")
        if n < rows or chosen.groupBy("attribute").count().filter(F.col("count") >= rows).isEmpty():
            return chosen
    raise ValueError("a column loses every cell under every seed tried")


def apply_mask(df: DataFrame, key: str, columns: Sequence[str], mask: DataFrame) -> DataFrame:
    """df with the cells of mask (key, attribute) set to null."""
    lost = mask.groupBy(key).agg(F.collect_set("attribute").alias("_lost"))
    gone = lambda c: F.coalesce(F.array_contains("_lost", c), F.lit(False))
    return df.join(lost, key, "left").withColumns({c: F.when(~gone(c), F.col(c)) for c in columns}).drop("_lost")


def state_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """(state as text, count) of each discrete column, in the order of states, from one job. A row per state reaches the driver."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("state")) for c in columns])
    counts = df.select(F.inline(cells)).filter("state is not null").groupBy("attribute", "state").agg(F.count("*").alias("n"))
    out: dict[str, list] = {c: [] for c in columns}
    for r in counts.collect():
        out[r["attribute"]].append((r["state"], r["n"]))
    return {c: sorted(v) for c, v in out.items()}


def impute_expected(df: DataFrame, numeric: Sequence[str] = (), discrete: Sequence[str] = ()) -> DataFrame:
    """Nulls become the column's mean or most frequent state (the smallest of equals, as text). Two jobs, whatever the columns."""
    fill = {c: F.lit(v) for c, v in (df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict() if numeric else {}).items() if v is not None}
    for c, counts in state_counts(df, discrete).items():
        if counts:
            top = min(counts, key=lambda x: (-x[1], x[0]))[0]
            fill[c] = F.lit(top).cast(df.schema[c].dataType)
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def impute_marginal(df: DataFrame, key: str, numeric: Sequence[str] = (), discrete: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Nulls become draws: from the column's normal, or from its states with add-one weights. Seeded by row key; two jobs."""
    draw_of = lambda c, s: uniform(F.col(key), F.lit(c), F.lit(seed + s))
    out = {}
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numeric else {}
    for c in numeric:
        if moments[f"m_{c}"] is not None:
            draw = F.sqrt(-2 * F.log(draw_of(c, 0))) * F.cos(2 * F.pi() * draw_of(c, 1))
            out[c] = F.coalesce(F.col(c).cast("double"), F.lit(moments[f"m_{c}"]) + F.lit(moments[f"s_{c}"] or 0.0) * draw)
    for c, counts in state_counts(df, discrete).items():
        kind, total, reached, pick = df.schema[c].dataType, sum(n + 1 for _, n in counts), 0, None
        for state, n in counts[:-1]:
            reached += n + 1
            test, value = draw_of(c, 0) < reached / total, F.lit(state).cast(kind)
            pick = F.when(test, value) if pick is None else pick.when(test, value)
        if counts:
            last = F.lit(counts[-1][0]).cast(kind)
            out[c] = F.coalesce(F.col(c), last if pick is None else pick.otherwise(last))
    return df.withColumns(out)


def _cells(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: str, columns: Sequence[str], text: bool) -> DataFrame:
    def long(df: DataFrame, value: str) -> DataFrame:
        kind = "string" if text else "double"
        return df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast(kind).alias(value)) for c in columns])))

    hidden = mask.filter(F.col("attribute").isin(*columns))
    return hidden.join(long(truth, "truth"), [key, "attribute"]).join(long(imputed, "guess"), [key, "attribute"])


def impute_accuracy(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """accuracy: the share of hidden discrete cells restored; 1 if none is hidden."""
    hit = F.col("truth").eqNullSafe(F.col("guess")).cast("double")
    return _cells(truth, imputed, mask, key, columns, True).agg(F.coalesce(F.avg(hit), F.lit(1.0)).alias("accuracy"))


def impute_mse(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """mse over hidden continuous cells; 0 if none is hidden."""
    gap = F.col("truth") - F.col("guess")
    return _cells(truth, imputed, mask, key, columns, False).agg(F.coalesce(F.avg(gap * gap), F.lit(0.0)).alias("mse"))


def _nrmse(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(attribute, error): root mean squared error over the true range; 0 for a column without hidden cells."""
    gap = F.col("truth") - F.col("guess")
    each = _cells(truth, imputed, mask, key, columns, False).groupBy("attribute").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
    spans = unpivot(truth, columns).groupBy("attribute").agg((F.max("value") - F.min("value")).alias("span"))
    return spans.join(each, "attribute", "left").select("attribute", F.coalesce(F.col("rmse") / F.nullif(F.col("span"), F.lit(0.0)), F.lit(0.0)).alias("error"))


def impute_nrmse(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """nrmse averaged over all continuous columns."""
    return _nrmse(truth, imputed, mask, key, columns).agg(F.avg("error").alias("nrmse"))


def impute_avg_error(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: str, numeric: Sequence[str], discrete: Sequence[str]) -> DataFrame:
    """avg_error: normalised errors of continuous columns and error shares of discrete ones, averaged over all columns."""
    wrong = (~F.col("truth").eqNullSafe(F.col("guess"))).cast("double")
    shares = _cells(truth, imputed, mask, key, discrete, True).groupBy("attribute").agg(F.avg(wrong).alias("error"))
    both = _nrmse(truth, imputed, mask, key, numeric).unionByName(shares)
    return both.agg((F.sum("error") / F.lit(len(numeric) + len(discrete))).alias("avg_error"))
