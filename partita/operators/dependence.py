"""Dependence, information and neighbours."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.functions.draws import normal
from partita.functions.special import digamma
from partita.operators.neighbours import knn_join
from partita.operators.ranks import running_total
from partita.sources.scratch import stored


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two numeric arrays of the same length."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if metric == "euclidean":
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))
    if metric == "manhattan":
        return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    if metric == "chebyshev":
        return F.aggregate(gaps, F.lit(0.0), lambda s, x: F.greatest(s, x))
    raise ValueError(f"no such metric: {metric}")


def joint_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(a, b, x, y, n): counts of every pair of discrete columns in one shuffle; pairs with a null are left out. weight: a column of how many rows a row stands for."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in itertools.combinations(columns, 2)])
    cells = df.select(F.col(weight).alias("_w") if weight else F.lit(1).alias("_w"), F.inline(pairs)).filter("x is not null and y is not null")
    return cells.groupBy("a", "b", "x", "y").agg(F.sum("_w").alias("n"))


def entropies(counts: DataFrame, sets: dict[str, Sequence[str]], n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """(by, a column per entry of sets): the entropy, in nats, of each set of columns from joint counts or weights.

    ln N - sum n ln n / N needs sums alone: no column is ranked or gathered, however many values it has.
    """
    out, keys = None, list(by) or ["_one"]
    cells = counts.filter(F.col(n) > 0)
    for name, columns in sets.items():
        sums = cells.groupBy(*by, *columns).agg(F.sum(n).cast("double").alias("_s")).groupBy(*by).agg(F.sum("_s").alias("_t"), F.sum(F.col("_s") * F.ln("_s")).alias("_q"))
        one = sums.withColumns({} if by else {"_one": F.lit(1)}).select(*keys, (F.ln("_t") - F.col("_q") / F.col("_t")).alias(name))
        out = one if out is None else out.join(one, keys)
    return out.drop("_one")


def entropy_family(counts: DataFrame, x: str = "x", y: str = "y", n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """From joint counts or weights, in nats: h_x, h_y, h_xy, h_x_given_y, mi, nmi = mi / sqrt(h_x h_y), nmi_x = mi / h_x."""
    h = entropies(counts, {"h_x": [x], "h_y": [y], "h_xy": [x, y]}, n, by)
    mi = F.col("h_x") + F.col("h_y") - F.col("h_xy")
    return h.withColumns(
        {
            "h_x_given_y": F.col("h_xy") - F.col("h_y"),
            "mi": mi,
            "nmi": mi / F.nullif(F.sqrt(F.col("h_x") * F.col("h_y")), F.lit(0.0)),
            "nmi_x": mi / F.nullif(F.col("h_x"), F.lit(0.0)),
        }
    )


def conditional_mutual_info(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """cmi = h(x, z) + h(y, z) - h(x, y, z) - h(z)."""
    cells = df.dropna(subset=[x, y, z]).groupBy(x, y, z).agg(F.count("*").alias("n"))
    h = entropies(cells, {"xz": [x, z], "yz": [y, z], "xyz": [x, y, z], "z": [z]})
    return h.select((F.col("xz") + F.col("yz") - F.col("xyz") - F.col("z")).alias("cmi"))


def kl_divergence(p: DataFrame, q: DataFrame, state: str, weight: str) -> DataFrame:
    """kl of two weighted state tables; states without weight in p are skipped, those that q lacks make it infinite."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = F.broadcast(df.agg(F.sum(weight).alias("_t")).withColumn("_one", F.lit(1)))  # a single row
        return df.withColumn("_one", F.lit(1)).join(total, "_one").select(state, (F.col(weight) / F.col("_t")).alias(name))

    a, b = shares(p, "_p").filter("_p > 0"), shares(q, "_q")
    ratio = F.when(F.coalesce("_q", F.lit(0.0)) > 0, F.ln(F.col("_p") / F.col("_q"))).otherwise(float("inf"))
    return a.join(b, state, "left").agg(F.sum(F.col("_p") * ratio).alias("kl"))


def mutual_info_matrix(df: DataFrame, columns: Sequence[str], normalise: bool = False, weight: str | None = None) -> DataFrame:
    """(a, b, mi) of all pairs of discrete columns; normalised by the smaller entropy if asked."""
    h = entropy_family(joint_counts(df, columns, weight), by=["a", "b"])
    mi = F.col("mi") / F.nullif(F.least("h_x", "h_y"), F.lit(0.0)) if normalise else F.col("mi")
    return h.select("a", "b", mi.alias("mi"))


def mutual_info_discrete(df: DataFrame, x: str, y: str, normalise: bool = False) -> DataFrame:
    return mutual_info_matrix(df, [x, y], normalise)


def top_pairs(matrix: DataFrame, n: int) -> DataFrame:
    """The n pairs of highest mutual information, ties by name."""
    return matrix.orderBy(F.desc("mi"), "a", "b").limit(n)


def group_linkage(matrix: DataFrame, groups: DataFrame, old_divisor: bool = False) -> DataFrame:
    """(gx, gy, single, complete, average) of attribute groups (attribute, grp): largest, smallest and mean pair value."""
    both = matrix.unionByName(matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), "mi"))
    g = groups.select("attribute", "grp")
    joined = both.join(g.select(F.col("attribute").alias("a"), F.col("grp").alias("gx")), "a").join(g.select(F.col("attribute").alias("b"), F.col("grp").alias("gy")), "b").filter("gx < gy")
    n = F.countDistinct("a") + F.countDistinct("b")
    average = F.sum("mi") / (n * n) if old_divisor else F.avg("mi")
    return joined.groupBy("gx", "gy").agg(F.max("mi").alias("single"), F.min("mi").alias("complete"), average.alias("average"))


def partition_nmi(posteriors: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """mi and nmi of two soft partitions given as probability arrays of each row: from sum of r_a r_b."""
    cells = posteriors.select(F.posexplode(a).alias("x", "_p"), F.col(b).alias("_b")).select("x", "_p", F.posexplode("_b").alias("y", "_q"))
    joint = cells.groupBy("x", "y").agg(F.sum(F.col("_p") * F.col("_q")).alias("n"))
    return entropy_family(joint).select("mi", "nmi")


#: Keys that one row of radius_pairs() holds at most, until a table has more than this many times LISTS rows.
KEYS, LISTS = 1024, 100_000


def _key_lists(df: DataFrame, key: str, columns: Sequence[str], radius: float) -> DataFrame:
    """(keys, v, c0, c1, ...): distinct finite vectors with their cells and their keys, those of a vector with many keys in several rows."""
    x = [F.col(c).cast("double") for c in columns]
    cells = [F.floor(F.col("v")[i] / radius).cast("long").alias(f"c{i}") for i in range(len(columns))]
    rows = df.select(F.col(key).alias("key"), F.array(*x).alias("v")).filter(F.col("key").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    sizes = stored(rows.groupBy("v").agg(F.count("*").alias("n")), "radius-sizes")
    most = max(KEYS, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // LISTS))
    many = F.broadcast(sizes.filter(F.col("n") > most).select("v", F.ceil(F.col("n") / most).alias("lists")))  # LISTS vectors at most
    dealt = rows.join(many, "v", "left").withColumn("list", F.coalesce(F.pmod(F.xxhash64("key"), F.col("lists")), F.lit(0)))
    return dealt.groupBy("v", "list").agg(F.collect_list("key").alias("keys")).select("keys", "v", *cells)


def radius_pairs(queries: DataFrame, base: DataFrame, key: str, columns: Sequence[str], radius: float, metric: str = "euclidean") -> DataFrame:
    """(keys_q, keys, distance): pairs of distinct vectors within the radius (> 0), each with lists of the rows that have them; all_pairs() gives the pairs of rows.

    Vectors fall into cells as wide as the radius; a query visits its own and the neighbouring cells, an equi-join. A vector meets
    itself, and so does a row.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    on = [f"c{i}" for i in range(len(columns))]
    q = _key_lists(queries, key, columns, radius).withColumnsRenamed({"keys": "keys_q", "v": "vq"})
    for c in on:
        q = q.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    joined = q.join(_key_lists(base, key, columns, radius), on)
    return joined.select("keys_q", "keys", distance(F.col("vq"), F.col("v"), metric).alias("distance")).filter(F.col("distance") <= radius)


def all_pairs(pairs: DataFrame) -> DataFrame:
    """(key_q, key, distance): pairs of rows of different keys from radius_pairs(), whose rows are dealt evenly first, so that neither a cell nor a vector with many rows fills a task."""
    even = pairs.repartition(8 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = even.select(F.explode("keys_q").alias("key_q"), "keys", "distance").select("key_q", F.explode("keys").alias("key"), "distance")
    return each.filter("key_q <> key")


def radius_join(queries: DataFrame, base: DataFrame, key: str, columns: Sequence[str], radius: float, metric: str = "euclidean") -> DataFrame:
    """(key_q, key, distance): all rows of base within the radius (> 0) of each query row, itself excluded.

    Distances are those of distinct vectors; rows without a key or with a null or non-finite value are left out.
    """
    return all_pairs(radius_pairs(queries, base, key, columns, radius, metric))


def counts_within(points: DataFrame, axis: DataFrame) -> DataFrame:
    """points (id, x, eps) with m: how many values of axis (x, n) lie strictly within eps of x, the point itself left out; 0 at least.

    The points' two bounds are sorted among the values by range partitions, and what lies before each comes from
    running totals: no task and not the driver holds an axis. At a tie the upper bound comes before the values, the lower one after.
    """
    nothing = F.lit(0).cast("long").alias("n")
    bounds = [points.select((F.col("x") + F.lit(s) * F.col("eps")).alias("v"), F.lit(kind).alias("kind"), nothing, "id") for s, kind in ((1, 0), (-1, 2))]
    values = axis.select(F.col("x").alias("v"), F.lit(1).alias("kind"), F.col("n").cast("long").alias("n"), F.lit(None).cast(points.schema["id"].dataType).alias("id"))
    placed = running_total(values.unionByName(bounds[0]).unionByName(bounds[1]), ["v", "kind"], "n").filter("kind <> 1")
    m = F.sum(F.when(F.col("kind") == 0, F.col("before")).otherwise(-F.col("before"))) - 1
    return placed.groupBy("id").agg(F.greatest(m, F.lit(0)).alias("m"))


def _with_psi(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the digamma of a column of whole numbers."""

    @F.pandas_udf("double")
    def psi(m: pd.Series) -> pd.Series:
        return pd.Series(digamma(m.to_numpy(float)))

    return df.withColumn(name, psi(F.col(column)))


def jittered(df: DataFrame, key: str, columns: Sequence[str], size: float = 1e-10, seed: int = 0) -> DataFrame:
    """df whose columns have a little normal noise each, in units of max(1, mean magnitude of the column), drawn from key, column and seed.

    Neighbour estimates take tied values (as scores of questionnaires have them) for exact repeats and overrate what they
    share; with noise ties fall in a random order, the same in every run.
    """
    means = df.agg(*[F.avg(F.abs(F.col(c).cast("double"))).alias(str(i)) for i, c in enumerate(columns)]).first()
    noise = {c: F.col(c).cast("double") + size * max(1.0, means[str(i)] or 0.0) * normal(F.col(key), F.lit(c), F.lit(seed)) for i, c in enumerate(columns)}
    return df.withColumns(noise)


def mutual_info_continuous(df: DataFrame, key: str, x: str, y: str, k: int = 3, jitter: float = 0.0, seed: int = 0) -> float:
    """Nearest-neighbour estimate of mutual information in nats, not below 0: Chebyshev k-th neighbours, then strict counts on each axis.

    Keys are unique. jitter: noise that parts ties, see jittered(); without it tied values make the estimate far too high.
    """
    if jitter:
        df = jittered(df, key, [x, y], jitter, seed)
    rows = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rows = stored(rows, "mi-rows")  # noise is drawn once, the rows are read six times
    n = rows.count()
    if n <= k:
        raise ValueError(f"{n} rows: more than k are needed")
    vectors = rows.withColumn("v", F.array("x", "y"))
    near = knn_join(vectors, vectors, "key", "v", k, "chebyshev").filter(F.col("rank") == k).select(F.col("key_q").alias("key"), F.col("distance").alias("eps"))
    points = stored(rows.join(near, "key"), "mi-points")
    total = 0.0
    for c in ("x", "y"):
        axis = rows.groupBy(F.col(c).alias("x")).agg(F.count("*").alias("n"))
        counts = counts_within(points.select(F.col("key").alias("id"), F.col(c).alias("x"), "eps"), axis).groupBy((F.col("m") + 1).alias("m")).agg(F.count("*").alias("n"))
        total += _with_psi(counts, "m", "psi").agg(F.sum(F.col("psi") * F.col("n"))).first()[0] / n
    return max(0.0, float(digamma(float(n)) + digamma(float(k)) - total))


def mutual_info_mixed(df: DataFrame, state: str, x: str, k: int = 3) -> DataFrame:
    """mi of a discrete and a continuous column: k-th neighbour within the state, counts on the whole axis.

    In one dimension the k-th neighbour is within k places of the sorted distinct values of a state: each value goes to
    the k places on either side, by place numbers from range partitions, so a state with most rows is spread too. States with
    k distinct values or fewer add nothing but still count in the divisor.
    """
    rows = df.select(F.col(state).cast("string").alias("g"), F.col(x).cast("double").alias("x")).dropna()
    values = rows.groupBy("g", "x").agg(F.count("*").alias("n"))
    placed = stored(running_total(values, ["x"], by=["g"]).withColumnRenamed("before", "place"), "mi-places")
    sent = placed.select("g", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("_o"), "place", "x").filter("_o <> 0").select("g", (F.col("place") + F.col("_o")).alias("place"), F.col("x").alias("_x"))
    gaps = F.array_sort(F.collect_list(F.abs(F.col("_x") - F.col("x"))))  # 2 k at most
    near = placed.join(sent, ["g", "place"]).groupBy("g", "place", "x", "n").agg(F.get(gaps, F.lit(k - 1)).alias("eps"))
    distinct = placed.groupBy("g").agg(F.count("*").alias("distinct"))
    points = stored(near.join(distinct, "g").filter(F.col("distinct") > k).withColumn("id", F.struct("g", "place")), "mi-points")
    axis = rows.groupBy("x").agg(F.count("*").alias("n"))
    counts = counts_within(points.select("id", "x", "eps"), axis)
    each = points.join(counts, "id").groupBy("distinct", (F.col("m") + 1).alias("m")).agg(F.sum("n").alias("n"))
    each = _with_psi(_with_psi(each, "distinct", "psi_d"), "m", "psi_m")
    total = axis.agg(F.sum("n")).first()[0] or 0
    s, at_k, at_n = F.sum(F.col("n") * (F.col("psi_d") + F.col("psi_m"))), float(digamma(float(k))), float(digamma(float(max(total, 1))))
    some = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(F.greatest(F.lit(0.0), (some * F.lit(at_k + at_n) - F.coalesce(s, F.lit(0.0))) / F.lit(float(max(total, 1)))).alias("mi"))


def mutual_info_by_type(df: DataFrame, key: str, discrete: Sequence[str] = (), numeric: Sequence[str] = (), k: int = 3, jitter: float = 0.0, seed: int = 0) -> list[tuple[str, str, float]]:
    """(a, b, mi) of all pairs of columns by their types: counts for two discrete ones, neighbour estimates for two numeric ones or a mixed pair. jitter: noise that parts tied numbers, see jittered()."""
    if jitter and numeric:
        df = stored(jittered(df, key, numeric, jitter, seed).select(key, *discrete, *numeric), "jittered")
    out = [(r["a"], r["b"], r["mi"]) for r in mutual_info_matrix(df, discrete).collect()] if len(discrete) > 1 else []
    out += [(a, b, mutual_info_mixed(df, a, b, k).first()["mi"]) for a in discrete for b in numeric]
    return out + [(a, b, mutual_info_continuous(df, key, a, b, k)) for a, b in itertools.combinations(numeric, 2)]


def robinson_foulds(trees: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of trees (model, parent, child): half the partitions that one of them lacks.

    A partition is a parent with its set of children. Names of latent parents should be passed as null if they are to
    be ignored.
    """
    parts = trees.groupBy("model", "parent").agg(F.sort_array(F.collect_set(F.col("child").cast("string"))).alias("children"))
    parts = parts.select("model", F.struct("parent", "children").alias("part")).distinct()
    sizes = parts.groupBy("model").agg(F.count("*").alias("n"))
    everyone = sizes.groupBy().agg(F.collect_list(F.struct("model", "n")).alias("all"))
    pairs = everyone.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).filter("x.model < y.model")
    shared = parts.alias("p").join(parts.alias("q"), "part").filter("p.model < q.model").groupBy(F.col("p.model").alias("a"), F.col("q.model").alias("b")).agg(F.count("*").alias("same"))
    out = pairs.select(F.col("x.model").alias("a"), F.col("y.model").alias("b"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")).join(shared, ["a", "b"], "left")
    same = F.coalesce("same", F.lit(0))
    return out.select("a", "b", ((F.col("nx") - same + F.col("ny") - same) / 2.0).alias("distance"))
