"""Structure search: candidates on the driver, every score an aggregate over the data, a round's candidates in one pass."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.functions.special import lgamma
from partita.operators.dependence import mutual_info_matrix
from partita.operators import forest
from partita.operators.parameters import LatentClass, fit_latent_class, fit_mixture, fit_mixtures, select_cardinality
from partita.operators.scoring import hard_assign

Family = tuple[str, frozenset]


def _there(columns: Iterable[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _exploded(df: DataFrame, cells: list[Column]) -> DataFrame:
    return df.select(F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull())))


def _named(scores: DataFrame, families: Sequence[Family]) -> DataFrame:
    """Scores by number of the family with its child and parents (by name, joined by commas); families without a complete row have none."""
    names = F.array(*[F.struct(F.lit(c).alias("child"), F.lit(",".join(sorted(p))).alias("parents")) for c, p in families])
    return scores.withColumn("_f", F.element_at(names, F.col("family") + 1)).select("family", "_f.*", *[c for c in scores.columns if c != "family"])


def discrete_family_scores(df: DataFrame, families: Sequence[Family], weight: str | None = None) -> DataFrame:
    """(family, child, parents, n, log_likelihood, dim, bic) of discrete families, over the n rows without a null in the family.

    All families are counted in one shuffle: each row gives one cell per family. The dimension counts occurring
    states: (states of the child - 1) times configurations of the parents. Families without such a row are not listed.
    weight: a column of how many rows a row stands for.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.array().cast("array<string>")
    cells = [
        F.when(_there([child, *parents]), F.struct(F.lit(i).alias("family"), (F.col(weight) if weight else F.lit(1)).alias("w"), text(child).alias("x"), (F.array(*map(text, sorted(parents))) if parents else none).alias("config")))
        for i, (child, parents) in enumerate(families)
    ]
    counts = _exploded(df, cells).groupBy("family", "x", "config").agg(F.sum("w").alias("n"))
    configs = counts.groupBy("family", "config").agg(F.sum("n").alias("nc"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    states = counts.groupBy("family").agg(F.countDistinct("x").alias("states"))
    ll = F.sum(F.col("s") - F.col("nc") * F.ln("nc"))
    out = configs.groupBy("family").agg(ll.alias("log_likelihood"), F.count("*").alias("configs"), F.sum("nc").alias("n")).join(states, "family")
    dim = (F.col("states") - 1) * F.col("configs")
    return _named(out.select("family", "n", "log_likelihood", dim.alias("dim"), (F.col("log_likelihood") - dim * F.ln("n") / 2).alias("bic")), families)


def _residual(n: float, sums: np.ndarray, products: np.ndarray) -> float:
    """The variance that is left of the first column after regression on the others, from sums and sums of products."""
    cov = products / n - np.outer(sums, sums) / n**2
    left = cov[0, 0]
    if len(sums) > 1:
        left -= float(cov[0, 1:] @ np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0])
    return max(left, 1e-12)


def family_moments(df: DataFrame, families: Sequence[Family], centre: Mapping[str, float], gaps: set[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(rows, sums, products) of the centred numeric columns of every family, child first and parents by name, over the rows that are complete in it.

    One pass: families whose columns with nulls are the same share a matrix of products in every task, and a task returns those matrices alone.
    """
    groups: dict[tuple, list[str]] = {}
    for child, parents in families:
        holes = tuple(sorted(c for c in (child, *parents) if c in gaps))
        groups.setdefault(holes, [])
        groups[holes] += [c for c in (child, *sorted(parents)) if c not in groups[holes]]
    columns = sorted({c for some in groups.values() for c in some})
    place = {c: i for i, c in enumerate(columns)}
    plan = [([place[c] for c in holes], [place[c] for c in some]) for holes, some in groups.items()]

    def run(batches):
        totals = [np.zeros((len(some) + 1, len(some) + 1)) for _, some in plan]
        for b in batches:
            x = b.to_numpy(float)
            there = ~np.isnan(x)
            for total, (holes, some) in zip(totals, plan, strict=True):
                part = x[there[:, holes].all(axis=1)][:, some] if holes else x[:, some]
                part = np.hstack([np.ones((len(part), 1)), part])
                total += part.T @ part
        for g, total in enumerate(totals):
            yield pd.DataFrame({"g": g, "i": np.arange(total.size), "v": total.ravel()})

    rows = df.select(*[(F.col(c).cast("double") - F.lit(float(centre[c]))).alias(c) for c in columns])
    got = rows.mapInPandas(run, "g int, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).toPandas()
    whole = {}
    for g, (holes, some) in enumerate(groups.items()):
        flat = got[got["g"] == g].sort_values("i")["v"].to_numpy()
        whole[holes] = (some, flat.reshape(len(some) + 1, -1) if len(flat) else np.zeros((len(some) + 1,) * 2))
    out = []
    for child, parents in families:
        some, total = whole[tuple(sorted(c for c in (child, *parents) if c in gaps))]
        at = [1 + some.index(c) for c in (child, *sorted(parents))]
        out.append((total[0, 0], total[0, at], total[np.ix_(at, at)]))
    return out


def _column_moments(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], dict[str, float], set[str]]:
    """Mean and variance of each numeric column, and the columns that have nulls."""
    parts = [f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("m", F.avg), ("v", F.var_pop), ("c", F.count))]
    one = df.agg(F.count("*").alias("n"), *parts).first()
    mean, variance = ({c: float(one[f"{k}{i}"] or 0.0) for i, c in enumerate(columns)} for k in "mv")
    return mean, variance, {c for i, c in enumerate(columns) if one[f"c{i}"] < one["n"]}


def gaussian_family_scores(df: DataFrame, families: Sequence[Family]) -> list[dict]:
    """The same figures (a dict per family) of linear-Gaussian families with numeric parents, each over its own complete rows. Two passes serve all of them."""
    columns = sorted({c for child, parents in families for c in (child, *parents)})
    mean, _, gaps = _column_moments(df, columns)
    out = []
    for i, ((child, parents), (n, sums, products)) in enumerate(zip(families, family_moments(df, families, mean, gaps), strict=True)):
        if n:
            ll = -n / 2 * (math.log(2 * math.pi * _residual(n, sums, products)) + 1)
            out.append({"family": i, "child": child, "parents": ",".join(sorted(parents)), "n": int(n), "log_likelihood": ll, "dim": len(sums) + 1, "bic": ll - (len(sums) + 1) * math.log(n) / 2})
    return out


def regression_evidence(n: float, sums: np.ndarray, products: np.ndarray, variances: Sequence[float], n0: float = 1.0) -> float:
    """Log evidence of a linear regression of the first column on the others, from sums and products of columns centred about the table's means.

    Conjugate priors worth n0 rows: the intercept about the child's mean, slopes about 0 with the precision n0 times
    the parent's variance (so units do not matter), the noise about the child's variance. Without parents it is gaussian_evidence().
    """
    precision = n0 * np.array([1.0, *(max(v, 1e-12) for v in variances[1:])])
    xx = np.block([[np.array([[n]]), sums[None, 1:]], [sums[1:, None], products[1:, 1:]]]) + np.diag(precision)
    xy = np.array([sums[0], *products[1:, 0]])
    a0, b0 = n0 / 2, max(n0 * variances[0] / 2, 1e-12)
    a, b = a0 + n / 2, max(b0 + 0.5 * (products[0, 0] - xy @ np.linalg.solve(xx, xy)), 1e-300)
    gamma = float(lgamma(np.array(a)) - lgamma(np.array(a0)))
    return float(-n / 2 * math.log(2 * math.pi) + 0.5 * (np.log(precision).sum() - np.linalg.slogdet(xx)[1]) + a0 * math.log(b0) - a * math.log(b) + gamma)


def evidence_family_scores(df: DataFrame, families: Sequence[Family], discrete: Iterable[str], n0: float = 1.0) -> DataFrame:
    """(family, child, parents, n, log_evidence, alone) of families of all kinds, each over its own complete rows: the marginal likelihood under conjugate priors worth n0 rows.

    alone: the evidence of the child without parents over the same rows, so that what the parents add can be told from which rows are complete.

    Discrete children (whose parents are discrete): Dirichlet evidence in each configuration of the parents, with prior shares n0 (count + 1) / (N + states) from
    all rows that have the child. Numeric children: regression_evidence() on the numeric parents in each configuration of the discrete ones, whose
    cross products Spark adds up. Families without a complete row are not listed.
    """
    kinds, spark = set(discrete), df.sparkSession
    numbered = list(enumerate(families))
    parts = []
    if some := [(i, f) for i, f in numbered if f[0] in kinds]:
        parts.append(_dirichlet_scores(df, some, n0))
    if plain := [(i, f) for i, f in numbered if f[0] not in kinds and not f[1] & kinds]:
        mean, variance, gaps = _column_moments(df, sorted({c for _, (child, parents) in plain for c in (child, *parents)}))
        moments = family_moments(df, [f for _, f in plain], mean, gaps)
        of = lambda n, s, p, columns: regression_evidence(n, s[: len(columns)], p[: len(columns), : len(columns)], [variance[c] for c in columns], n0)
        rows = [(i, int(n), of(n, s, p, [child, *sorted(parents)]), of(n, s, p, [child])) for (i, (child, parents)), (n, s, p) in zip(plain, moments, strict=True) if n]
        parts.append(spark.createDataFrame(rows, "family int, n long, log_evidence double, alone double"))
    if mixed := [(i, f) for i, f in numbered if f[0] not in kinds and f[1] & kinds]:
        mean, variance, _ = _column_moments(df, sorted({c for _, (child, parents) in mixed for c in (child, *parents) if c not in kinds}))
        stats, linear = _configuration_products(df, [f for _, f in mixed], kinds, mean)
        score = lambda family, n, sums, products: regression_evidence(n, sums, products, [variance[c] for c in linear[family]], n0)
        numbers = F.array(*[F.lit(i) for i, _ in mixed])
        each = _each_configuration(stats, [len(x) for x in linear], score).groupBy("family").agg(F.sum("n").alias("n"), F.sum("ll").alias("log_evidence"))
        pooled = stats.groupBy("family").agg(F.lit(0).alias("config"), *[F.sum(c).alias(c) for c in ("n", "s0", "p0_0")])
        simple = lambda family, n, sums, products: regression_evidence(n, sums, products, [variance[linear[family][0]]], n0)
        alone = _each_configuration(pooled, [1] * len(linear), simple).select("family", F.col("ll").alias("alone"))
        parts.append(each.join(F.broadcast(alone), "family").withColumn("family", F.element_at(numbers, F.col("family") + 1)))  # a row per family
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _named(out, families)


def _dirichlet_scores(df: DataFrame, numbered: Sequence[tuple[int, Family]], n0: float) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    none = F.array().cast("array<string>")
    cells = [F.when(_there([c, *ps]), F.struct(F.lit(i).alias("family"), F.lit(c).alias("child"), text(c).alias("x"), (F.array(*map(text, sorted(ps))) if ps else none).alias("config"))) for i, (c, ps) in numbered]
    counts = _exploded(df, cells).groupBy("family", "child", "x", "config").agg(F.count("*").alias("n"))
    children = sorted({c for _, (c, _) in numbered})
    values = _exploded(df, [F.when(_there([c]), F.struct(F.lit(c).alias("child"), text(c).alias("x"))) for c in children]).groupBy("child", "x").agg(F.count("*").alias("c"))
    totals = values.groupBy("child").agg(F.sum("c").alias("all"), F.count("*").alias("states"))
    alphas = values.join(F.broadcast(totals), "child").select("child", "x", (n0 * (F.col("c") + 1) / (F.col("all") + F.col("states"))).alias("alpha"))  # totals: a row per column

    @F.pandas_udf("double")
    def rise(alpha: pd.Series, n: pd.Series) -> pd.Series:
        """ln of the rising factorial of alpha, n steps."""
        return pd.Series(lgamma((alpha + n).to_numpy(float)) - lgamma(alpha.to_numpy(float)))

    each = counts.join(alphas, ["child", "x"]).withColumn("r", rise("alpha", F.col("n").cast("double"))).groupBy("family", "config").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    total = lambda n: rise(F.lit(float(n0)), F.col(n).cast("double"))
    scores = each.withColumn("r", F.col("r") - total("n")).groupBy("family").agg(F.sum("n").alias("n"), F.sum("r").alias("log_evidence"))
    pooled = counts.groupBy("family", "child", "x").agg(F.sum("n").alias("n")).join(alphas, ["child", "x"]).withColumn("r", rise("alpha", F.col("n").cast("double")))
    alone = pooled.groupBy("family").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).select("family", (F.col("r") - total("n")).alias("alone"))
    return scores.join(alone, "family")


def _configuration_products(df: DataFrame, families: Sequence[Family], kinds: set[str], centre: Mapping[str, float]) -> tuple[DataFrame, list[list[str]]]:
    """(family, config, n, s<i>, p<i>_<j>): sums and products of the centred numeric columns of each family (child first) per occurring configuration of its discrete parents; and those columns."""
    linear = [[child, *sorted(p for p in parents if p not in kinds)] for child, parents in families]
    width, cells = max(map(len, linear)), []
    for i, (child, parents) in enumerate(families):
        values = F.array(*[F.col(c).cast("double") - F.lit(float(centre[c])) for c in linear[i]])
        some = sorted(p for p in parents if p in kinds)
        config = F.array(*[F.col(p).cast("string") for p in some]) if some else F.array().cast("array<string>")
        cells.append(F.when(_there([child, *parents]), F.struct(F.lit(i).alias("family"), config.alias("config"), values.alias("v"))))
    v = [F.get("v", F.lit(k)) for k in range(width)]
    sums = [F.sum(v[k]).alias(f"s{k}") for k in range(width)]
    products = [F.sum(v[k] * v[m]).alias(f"p{k}_{m}") for k in range(width) for m in range(k, width)]
    return _exploded(df, cells).groupBy("family", "config").agg(F.count("*").alias("n"), *sums, *products), linear


def _each_configuration(stats: DataFrame, sizes: Sequence[int], score: Callable) -> DataFrame:
    """(family, n, ll) of every configuration: score(family, n, sums, products), a small solve in the tasks."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = sizes[r.family]
                p = np.array([[getattr(r, f"p{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)])
                out.append(score(r.family, r.n, np.array([getattr(r, f"s{i}") for i in range(k)]), p))
            yield pd.DataFrame({"family": b["family"], "n": b["n"], "ll": out})

    return stats.drop("config").mapInPandas(run, "family int, n long, ll double")


def conditional_family_scores(df: DataFrame, families: Sequence[Family], discrete: Iterable[str]) -> DataFrame:
    """The same figures of numeric children with discrete parents and, linearly in each configuration of those, numeric ones.

    A shuffle for all families adds sums and products per occurring configuration, whose residual variance is a small
    solve in the tasks. Columns are centred about their means first, so sums of squares keep their digits.
    """
    kinds = set(discrete)
    numbers = sorted({c for child, parents in families for c in (child, *parents) if c not in kinds})
    means = df.agg(*[F.avg(c).alias(c) for c in numbers]).first()
    stats, linear = _configuration_products(df, families, kinds, {c: means[c] or 0.0 for c in numbers})
    sizes = [len(x) for x in linear]
    each = _each_configuration(stats, sizes, lambda family, n, sums, products: -n / 2 * (math.log(2 * math.pi * _residual(n, sums, products)) + 1))
    out = each.groupBy("family").agg(F.sum("n").alias("n"), F.sum("ll").alias("log_likelihood"), F.count("*").alias("configs"))
    dim = F.element_at(F.array(*[F.lit(k + 1) for k in sizes]), F.col("family") + 1) * F.col("configs")
    return _named(out.select("family", "n", "log_likelihood", dim.alias("dim"), (F.col("log_likelihood") - dim * F.ln("n") / 2).alias("bic")), families)


class FamilyScores:
    """Scores remembered by family; a call scores all unknown families of a round in one job of each kind.

    Families of a child are compared over the rows that have the child: the log-likelihood of a family's complete rows is
    scaled up to them, as if parents were missing at random. A family without a complete row scores minus infinity, one without
    parents 0. score: bic, or evidence: what the parents add to the evidence of the child alone on a family's complete rows,
    scaled up likewise, is added to the evidence of the child alone on all its rows.
    """

    def __init__(self, df: DataFrame, discrete: Iterable[str], numeric: Iterable[str], score: str = "bic", weight: str | None = None) -> None:
        if score not in ("bic", "evidence"):
            raise ValueError(f"no such score: {score}")
        if weight and (score != "bic" or numeric):
            raise ValueError("rows that stand for several have discrete columns, scored by bic")
        self.score, self.weight = score, weight
        self.df, self.discrete, self.numeric, self.known = df, set(discrete), set(numeric), {}
        self.present: dict[str, int] | None = None

    def __call__(self, families: Iterable[Family]) -> dict[Family, float]:
        families = list(dict.fromkeys(families))
        new = [f for f in families if f not in self.known]
        if new and self.present is None:
            names = [*self.discrete, *self.numeric]
            many = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col(self.weight))), F.lit(0)) if self.weight else F.count(c)
            one = self.df.agg(*[many(c).alias(str(i)) for i, c in enumerate(names)]).first()
            self.present = {c: one[str(i)] for i, c in enumerate(names)}
        for f in new:
            self.known[f] = -math.inf if f[1] else 0.0
        if self.score == "evidence":
            new = list(dict.fromkeys([*new, *((f[0], frozenset()) for f in new if (f[0], frozenset()) not in self.known)]))
            found = [(new[r["family"]], r) for r in evidence_family_scores(self.df, new, self.discrete).collect()] if new else []  # a row per family
            self.known |= {f: r["log_evidence"] for f, r in found if not f[1]}
            self.known |= {f: self.known[f[0], frozenset()] + (r["log_evidence"] - r["alone"]) * self.present[f[0]] / r["n"] for f, r in found if f[1]}
            return {f: self.known[f] for f in families}
        kinds = (
            ([f for f in new if f[0] in self.discrete], lambda fs: discrete_family_scores(self.df, fs, self.weight).collect()),
            ([f for f in new if f[0] in self.numeric and f[1] & self.discrete], lambda fs: conditional_family_scores(self.df, fs, self.discrete).collect()),
            ([f for f in new if f[0] in self.numeric and not f[1] & self.discrete], lambda fs: gaussian_family_scores(self.df, fs)),
        )
        for some, score in kinds:
            for r in score(some) if some else ():
                child, rows = some[r["family"]][0], self.present[some[r["family"]][0]]
                assert child == r["child"]
                self.known[some[r["family"]]] = r["log_likelihood"] * rows / r["n"] - r["dim"] * math.log(rows) / 2
        return {f: self.known[f] for f in families}


def _cyclic(parents: Mapping[str, frozenset]) -> bool:
    left = {c: set(p) for c, p in parents.items()}
    while free := [c for c, p in left.items() if not p]:
        for c in free:
            del left[c]
        for p in left.values():
            p.difference_update(free)
    return bool(left)


def hill_climb(
    df: DataFrame, discrete: Sequence[str] = (), numeric: Sequence[str] = (), most_parents: int = 3, threshold: float = 1e-6, steps: int = 100,
    forbidden: Iterable[tuple[str, str]] = (), fixed: Iterable[tuple[str, str]] = (), mixed: bool = False, score: str = "bic", weight: str | None = None,
) -> tuple[dict[str, frozenset], float]:
    """(parents of each node, score): the best of adding, removing or turning an arc until none gains.

    Arcs stay acyclic and join columns of a kind, or with `mixed` also lead from discrete to numeric ones (which may have parents of both kinds); forbidden
    arcs (parent, child) are left out, fixed ones are there from the start, stay, and do not count as parents. score: bic, or
    evidence, the marginal likelihood under conjugate priors. weight: a column of how many rows a row stands for, for discrete columns and bic.
    """
    nodes = [*discrete, *numeric]
    kind = {**dict.fromkeys(discrete, "d"), **dict.fromkeys(numeric, "n")}
    barred, held, scores = set(forbidden), set(fixed), FamilyScores(df, discrete, numeric, score, weight)
    graph = {v: frozenset(p for p, c in held if c == v) for v in nodes}
    room = {v: most_parents + len(graph[v]) for v in nodes}

    def allowed(a: str, b: str) -> bool:
        """Whether a may become a parent of b beside its present ones."""
        return kind[a] == kind[b] or (mixed and kind[a] == "d")

    for _ in range(steps):
        moves = []
        for a, b in itertools.permutations(nodes, 2):
            if a in graph[b]:
                if (a, b) in held:
                    continue
                moves.append({b: graph[b] - {a}})
                if (b, a) not in barred and len(graph[a]) < room[a] and allowed(b, a):
                    moves.append({b: graph[b] - {a}, a: graph[a] | {b}})
            elif (a, b) not in barred and len(graph[b]) < room[b] and b not in graph[a] and allowed(a, b):
                moves.append({b: graph[b] | {a}})
        moves = [m for m in moves if not _cyclic(graph | m)]
        got = scores([*((v, p) for v, p in graph.items()), *((v, p) for m in moves for v, p in m.items())])
        gains = [sum(got[v, p] - got[v, graph[v]] if got[v, p] > -math.inf else -math.inf for v, p in m.items()) for m in moves]
        if not moves or max(gains) <= threshold:
            break
        graph = graph | moves[int(np.argmax(gains))]
    final = scores((v, p) for v, p in graph.items())
    return graph, sum(final.values())


def group_attributes(df: DataFrame, domains: Mapping[str, Sequence[str]] | None = None, numeric: Sequence[str] = (), candidates: int = 3, steps: int = 30, most_states: int = 4, seed: int = 0) -> tuple[list[list[str]], list[LatentClass]]:
    """Islands: groups of discrete and numeric attributes, each explained by one latent, and their models.

    A group starts with the pair of highest dependence (forest.pair_dependence) and takes the closest attribute while one latent over
    all explains them better than the group's latent beside a separate newcomer. All starts of both share each pass; the
    bound of the separate newcomer is exact from one pass over all attributes, that of the group is kept from when it was formed.
    """
    domains, numeric = dict(domains or {}), list(numeric)
    names, rng = [*domains, *numeric], np.random.default_rng(seed)
    rows = df.select(*names).persist()  # every pass reads it
    try:
        found = forest.pair_dependence(rows, numeric, domains)
        mi = lambda a, b: found.get((a, b), found.get((b, a), 0.0))
        base = forest.class_prior(rows, 1, numeric, domains)
        free = forest.forest_prior(base, forest.Structure({}, {}, dict.fromkeys(names, forest.ALONE)))
        alone = forest.forest_e_step(rows, [free], numeric, domains)[0]
        single = {c: forest.node_evidence(alone, free, c) for c in names}

        def together(groups: Sequence[Sequence[str]]) -> list[float]:
            """The best bound of one latent over each group, the other attributes of all of them separate, which adds nothing that differs."""
            every = sorted({c for g in groups for c in g}, key=names.index)
            num, dom = [c for c in every if c in numeric], {c: domains[c] for c in every if c in domains}
            prior_of = {c: base.gaussian[c] for c in num}, {c: base.discrete[c] for c in dom}
            small = LatentClass(np.ones(1), *prior_of, dict(dom))
            priors = [forest.forest_prior(small, forest.Structure({"z": 2}, {}, {c: "z" if c in g else forest.ALONE for c in every})) for g in groups]
            starts = [forest.forest_start(p, rng) for p in priors for _ in range(candidates)]
            fits = forest.fit_forests(rows.select(*every), starts, [p for p in priors for _ in range(candidates)], num, dom, steps)
            best = [max(f.elbo for f in fits[i * candidates : (i + 1) * candidates]) for i in range(len(groups))]
            return [b - sum(single[c] for c in every if c not in g) for b, g in zip(best, groups, strict=True)]

        left, groups = list(names), []
        while len(left) > 2:
            group, bound = list(max(itertools.combinations(left, 2), key=lambda p: mi(*p))), None
            while rest := [c for c in left if c not in group]:
                near = max(rest, key=lambda c: max(mi(c, g) for g in group))
                if bound is None:
                    bound, more = together([group, [*group, near]])
                else:
                    more = together([[*group, near]])[0]
                if more <= bound + single[near]:
                    break
                group, bound = [*group, near], more
            groups.append(group)
            left = [c for c in left if c not in group]
        if len(left) == 1 and groups:
            max(groups, key=lambda g: max(mi(left[0], c) for c in g)).append(left[0])
        elif left:
            groups.append(left)
        models = [select_cardinality(rows, [c for c in g if c in numeric], {c: domains[c] for c in g if c in domains}, most=most_states, candidates=candidates, steps=steps, seed=seed) for g in groups]
    finally:
        rows.unpersist()
    return groups, models


def augmented_latent_class(df: DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], states: int = 2, most_parents: int = 3, **options) -> tuple[dict[str, frozenset], float]:
    """One latent parent of all attributes, and up to `most_parents` discrete or numeric parents among them.

    The latent's labels complete the table; its arcs are fixed, others are climbed.
    """
    model = fit_latent_class(df, states, numeric, domains, **options)[states].expected("latent")
    whole = hard_assign(df, model).withColumn("latent", F.col("latent").cast("string"))
    names = [*domains, *numeric]
    return hill_climb(whole, ["latent", *domains], numeric, most_parents, forbidden=[(c, "latent") for c in names], fixed=[("latent", c) for c in names], mixed=True)


def select_augmented(df: DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], start: int = 2, most: int = 6, most_parents: int = 3, **options) -> tuple[dict[str, frozenset], float, int]:
    """augmented_latent_class() with `start`, `start` + 1, ... states until the score does not rise: (parents, score, states).

    The latent class models of all numbers of states share their passes. The score is the evidence of the table that the latent's labels complete, which
    no more states than are told apart can raise.
    """
    fits = fit_latent_class(df, range(start, most + 1), numeric, domains, **options)
    names, best = [*domains, *numeric], None
    for k in range(start, most + 1):
        model = fits[k].expected("latent")
        whole = hard_assign(df, model).withColumn("latent", F.col("latent").cast("string")).select("latent", *names).persist()
        try:
            graph, score = hill_climb(whole, ["latent", *domains], numeric, most_parents, forbidden=[(c, "latent") for c in names], fixed=[("latent", c) for c in names], mixed=True, score="evidence")
        finally:
            whole.unpersist()
        if best and score <= best[1]:
            break
        best = graph, score, k
    return best


def structural_em(df: DataFrame, start: forest.Forest, key: str, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], rounds: int = 5, steps: int = 20, seed: int = 0, weight: str | None = None) -> forest.Forest:
    """Complete the latents, climb the structure on the completed table, fit it again, until the bound does not rise.

    In the completed table latents may become the parent of attributes and of each other; the result is a forest. Without numeric attributes combinations of values
    are completed, not rows. weight: the column of a df that is forest.counted() already.
    """
    if not numeric and not weight:
        df, weight = forest.counted(df, numeric, domains)
    df = df.select(key, *numeric, *domains).persist() if not weight else df.persist()  # every pass reads it
    try:
        return _structural_em(df, start, key, numeric, domains, rounds, steps, seed, weight)
    finally:
        df.unpersist()


def _structural_em(df, start, key, numeric, domains, rounds, steps, seed, weight) -> forest.Forest:
    rng, best = np.random.default_rng(seed), start
    base = parameters_prior(df, numeric, domains, weight)
    for _ in range(rounds):
        latents = list(best.structure.cards)
        whole = forest.labelled(df, best, numeric, domains, [*domains, weight]) if weight else df.join(forest.assign(df, best, numeric, domains, key), key)
        whole = whole.withColumns({z: F.col(z).cast("string") for z in latents}).persist()
        names = [*domains, *numeric]
        try:
            graph, _ = hill_climb(whole, [*latents, *domains], numeric, 1, forbidden=[(a, b) for a in names for b in [*names, *latents] if a != b], mixed=True, weight=weight)
        finally:
            whole.unpersist()
        up = {z: next(iter(graph[z])) for z in latents if graph[z]}
        structure = forest.Structure(best.structure.cards, up, {c: next(iter(graph[c]), forest.ALONE) for c in names})
        kept = {z: k for z, k in structure.cards.items() if structure.children(z)}
        structure = forest.Structure(kept, {z: p for z, p in up.items() if z in kept and p in kept}, structure.of)
        prior = forest.forest_prior(base, structure)
        new = forest.fit_forests(df, [forest.forest_start(prior, rng, best)], [prior], numeric, domains, steps, weight=weight)[0]
        if new.elbo <= best.elbo + 0.01:
            break
        best = new
    return best


def parameters_prior(df: DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], weight: str | None = None) -> LatentClass:
    return forest.class_prior(df, 1, numeric, domains, weight=weight)


def learn_binary_forest(df: DataFrame, key: str, domains: Mapping[str, Sequence[str]], linkage: str = "average", rounds: int = 10, steps: int = 20, seed: int = 0) -> forest.Forest:
    """Binary trees over discrete attributes: each round puts a latent over the two roots of highest dependence.

    The dependence of a new latent is the average, smallest (complete) or largest (single) of its parts', or with
    linkage `labels` measured on its hard labels. Stops when the bound does not rise. Combinations of values are counted first, and labelled.
    """
    rows, weight = forest.counted(df, (), domains)
    rows = rows.persist()
    try:
        return _learn_binary_forest(rows, domains, linkage, rounds, steps, seed, weight)
    finally:
        rows.unpersist()


def _learn_binary_forest(df, domains, linkage, rounds, steps, seed, weight) -> forest.Forest:
    rng = np.random.default_rng(seed)
    base = parameters_prior(df, (), domains, weight)
    mi = {frozenset((r["a"], r["b"])): r["mi"] for r in mutual_info_matrix(df, list(domains), weight=weight).collect()}
    now = forest.Structure({}, {}, dict.fromkeys(domains, forest.ALONE))
    prior = forest.forest_prior(base, now)
    best = forest.fit_forests(df, [prior], [prior], (), domains, 2, weight=weight)[0]
    roots = list(domains)
    for _ in range(rounds):
        if len(roots) < 2:
            break
        a, b = max(itertools.combinations(roots, 2), key=lambda p: mi.get(frozenset(p), 0.0))
        structure = forest.add_latents(best.structure, [(a, b)])[0]
        prior = forest.forest_prior(base, structure)
        new = max(forest.fit_forests(df, [forest.forest_start(prior, rng, best) for _ in range(2)], [prior] * 2, (), domains, steps, weight=weight), key=lambda m: m.elbo)
        if new.elbo <= best.elbo + 0.01:
            break
        best, z = new, next(x for x in new.structure.cards if x not in best.structure.cards)
        roots = [r for r in roots if r not in (a, b)]
        if linkage == "labels":
            labels = forest.labelled(df, best, (), domains, [*domains, weight])
            found = mutual_info_matrix(labels, [z, *roots], weight=weight).filter(F.col("a") == z).collect() if roots else []
            mi |= {frozenset((z, r["b"])): r["mi"] for r in found}
        else:
            pick = {"average": lambda x, y: (x + y) / 2, "complete": min, "single": max}[linkage]
            mi |= {frozenset((z, r)): pick(mi.get(frozenset((a, r)), 0.0), mi.get(frozenset((b, r)), 0.0)) for r in roots}
        roots.append(z)
    return best


def refine_and_rewire(df: DataFrame, key: str, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], start: forest.Forest | None = None, rounds: int = 4, **options) -> forest.Forest:
    """forest.learn_partitions(strategy refine), each time followed by structural_em(), until neither raises the bound."""
    weight = None
    if not numeric:
        df, weight = forest.counted(df, numeric, domains)
    df = df.persist()
    try:
        return _refine_and_rewire(df, key, numeric, domains, start, rounds, weight, options)
    finally:
        df.unpersist()


def _refine_and_rewire(df, key, numeric, domains, start, rounds, weight, options) -> forest.Forest:
    best = start
    for _ in range(rounds):
        new = forest.learn_partitions(df, numeric, domains, "refine", start=best, weight=weight, **options)
        if best is not None and new.elbo <= best.elbo + 0.01:
            break
        best = new
        if new.structure.cards:
            best = structural_em(df, new, key, numeric, domains, weight=weight)
        if best is new:
            break
    return best


def search_pouches(df: DataFrame, numeric: Sequence[str], most_states: int = 5, rounds: int = 6, screen: int = 6, steps: int = 30, moves: Sequence[str] = ("more", "less", "combine", "separate"), seed: int = 0) -> dict:
    """A Gaussian mixture whose leaves are joint groups of attributes, by BIC: states added or dropped, groups joined or parted.

    All candidates of a round are screened in shared passes of few steps, the best is fitted on; stops when BIC does not rise. Fewer moves give
    the plainer learners: `more` alone a mixture with independent leaves, `combine` a multi-leaf mixture.
    """
    best = {"states": 1, "blocks": [[c] for c in numeric]}
    best |= fit_mixture(df, 1, numeric, blocks=best["blocks"], candidates=1, steps=2, seed=seed)
    for _ in range(rounds):
        k, blocks = best["states"], best["blocks"]
        options = []
        if "more" in moves and k < most_states:
            options.append((k + 1, blocks))
        if "less" in moves and k > 1:
            options.append((k - 1, blocks))
        if "combine" in moves:
            options += [(k, [b for b in blocks if b not in (x, y)] + [x + y]) for x, y in itertools.combinations(blocks, 2)]
        if "separate" in moves:
            options += [(k, [b for b in blocks if b is not x] + [[c], [d for d in x if d != c]]) for x in blocks if len(x) > 1 for c in x]
        if not options:
            break
        tried = fit_mixtures(df, numeric, options, candidates=2, steps=screen, seed=seed)
        s, b = options[int(np.argmax([t["bic"] for t in tried]))]
        new = {"states": s, "blocks": b} | fit_mixture(df, s, numeric, blocks=b, candidates=3, steps=steps, seed=seed)
        if new["bic"] <= best["bic"]:
            break
        best = new
    return best
