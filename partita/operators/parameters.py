"""Sufficient statistics and distributed parameter learning."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.special import digamma, lgamma
from partita.operators.scoring import MixtureModel


def sufficient_stats(df: DataFrame, child: str, parents: Sequence[str] = (), numeric: bool = True) -> DataFrame:
    """Per parent configuration: n, sum_x, sum_xx of a numeric child, or n per value of a discrete one. Rows that lack a part are left out."""
    rows = df.dropna(subset=[child, *parents])
    if numeric:
        x = F.col(child).cast("double")
        return rows.groupBy(*parents).agg(F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_xx"))
    return rows.groupBy(*parents, F.col(child).alias("value")).agg(F.count("*").alias("n"))


def cross_stats(df: DataFrame, columns: Sequence[str], parents: Sequence[str] = ()) -> DataFrame:
    """Per configuration: n, sums and sums of products of all numeric columns, for linear-Gaussian families."""
    rows = df.dropna(subset=[*columns, *parents])
    c = [F.col(x).cast("double") for x in columns]
    sums = [F.sum(x).alias(f"s_{n}") for n, x in zip(columns, c, strict=True)]
    prods = [F.sum(c[i] * c[j]).alias(f"p_{columns[i]}_{columns[j]}") for i in range(len(c)) for j in range(i, len(c))]
    return rows.groupBy(*parents).agg(F.count("*").alias("n"), *sums, *prods)


def fit_gaussian(df: DataFrame, child: str, parents: Sequence[str] = (), laplace: bool = False, configurations: int = 1) -> DataFrame:
    """mean and variance per configuration. laplace: a pseudo-row (value 0, square 0.1) spread over the configurations."""
    stats = sufficient_stats(df, child, parents)
    more = 1.0 / configurations if laplace else 0.0
    n = F.col("n") + more
    mean = F.col("sum_x") / n
    return stats.select(*parents, "n", mean.alias("mean"), ((F.col("sum_xx") + 0.1 * more) / n - mean * mean).alias("variance"))


def fit_multinomial(df: DataFrame, child: str, parents: Sequence[str] = (), domain: Sequence | None = None, laplace: bool = False) -> DataFrame:
    """p(value | configuration). With a domain, unseen values are listed; laplace adds 1/k of a pseudo-row per configuration to each."""
    counts = sufficient_stats(df, child, parents, numeric=False)
    if domain is not None:
        have = counts.groupBy(*parents).agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("_n"))
        counts = have.select(*parents, F.explode(F.array(*[F.lit(v) for v in domain])).alias("value"), "_n").select(*parents, "value", F.coalesce(F.col("_n")[F.col("value")], F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*parents))
    states = F.count("*").over(Window.partitionBy(*parents))
    configurations = F.size(F.collect_set(F.struct(*parents)).over(Window.partitionBy())) if parents else F.lit(1)
    p = (F.col("n") + 1 / (states * configurations)) / (total + 1 / configurations) if laplace else F.col("n") / total
    return counts.select(*parents, "value", "n", p.alias("p"))


def priors_from_data(df: DataFrame, numeric: Sequence[str], n0: float = 1.0) -> DataFrame:
    """(attribute, m0, k0, a0, b0): Normal-Gamma priors from mean and population variance, missing cells skipped."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("v", F.var_pop))])
    cells = [
        F.struct(F.lit(c).alias("attribute"), F.col(f"m_{c}").alias("m0"), F.lit(float(n0)).alias("k0"), F.lit(n0 / 2).alias("a0"), (n0 * F.col(f"v_{c}") / 2).alias("b0"))
        for c in numeric
    ]
    return one.select(F.inline(F.array(*cells)))


def dirichlet_priors(df: DataFrame, column: str, domain: Sequence[str], n0: float = 1.0, weight: str | None = None) -> DataFrame:
    """(value, alpha): n0 (count + 1) / (N + states), unseen values of the domain included. weight: a column of how many rows a row stands for."""
    many = lambda there: F.coalesce(F.sum(F.when(there, F.col(weight))), F.lit(0)) if weight else F.count_if(there)
    value = F.explode(F.array(*[F.lit(v) for v in domain])).alias("value")
    hits = df.agg(*[many(F.col(column) == v).alias(f"c{i}") for i, v in enumerate(domain)], many(F.col(column).isNotNull()).alias("n"))
    lookup = F.create_map(*[x for i, v in enumerate(domain) for x in (F.lit(v), F.col(f"c{i}"))])
    return hits.select(value, lookup.alias("_c"), "n").select("value", (n0 * (F.col("_c")[F.col("value")] + 1) / (F.col("n") + len(domain))).alias("alpha"))


def fit_naive_bayes(df: DataFrame, label: str, numeric: Sequence[str]) -> DataFrame:
    """(label, n, prior, and mean_ and variance_ of each attribute): one aggregate."""
    aggs = [f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("mean", F.avg), ("variance", F.var_pop))]
    out = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), *aggs)
    return out.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy()))


def naive_bayes_model(table: DataFrame, label: str, numeric: Sequence[str]) -> tuple[MixtureModel, list]:
    """The fitted table (a row per class) as a model whose states are the classes in order."""
    rows = sorted(table.collect(), key=lambda r: r[label])
    return MixtureModel([r["prior"] for r in rows], {c: [(r[f"mean_{c}"], r[f"variance_{c}"]) for r in rows] for c in numeric}, latent="predicted"), [r[label] for r in rows]


def with_fixed(estimates: DataFrame, fixed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Estimates whose given parameters are held at the values of `fixed` (keys, value)."""
    held = fixed.select(*keys, F.col(value).alias("_fixed"))
    return estimates.join(held, list(keys), "left").withColumn(value, F.coalesce("_fixed", value)).drop("_fixed")


def gaussian_evidence(n, sum_x, sum_xx, m0=0.0, k0=1.0, a0=1.0, b0=1.0):
    """Log evidence of a Normal-Gamma family from its statistics."""
    k, a = k0 + n, a0 + n / 2
    m = (k0 * m0 + sum_x) / k
    b = b0 + 0.5 * (sum_xx + k0 * m0**2 - k * m**2)
    return lgamma(a) - lgamma(a0) + a0 * np.log(b0) - a * np.log(b) + 0.5 * (np.log(k0) - np.log(k)) - n / 2 * math.log(2 * math.pi)


def dirichlet_evidence(counts, alpha):
    """Log evidence of a Dirichlet-multinomial family."""
    counts, alpha = np.asarray(counts, float), np.asarray(alpha, float)
    return float(lgamma(alpha.sum()) - lgamma(alpha.sum() + counts.sum()) + (lgamma(alpha + counts) - lgamma(alpha)).sum())


def fit_conjugate(df: DataFrame, child: str, parents: Sequence[str] = (), n0: float = 1.0) -> pd.DataFrame:
    """Posterior Normal-Gamma and log evidence per configuration (a row each) of a fully observed numeric family."""
    prior = priors_from_data(df, [child], n0).first()
    s = sufficient_stats(df, child, parents).toPandas()
    m0, k0, a0, b0 = prior["m0"], prior["k0"], prior["a0"], max(prior["b0"], 1e-12)
    n, x, xx = s["n"], s["sum_x"], s["sum_xx"]
    k = k0 + n
    m = (k0 * m0 + x) / k
    return s.assign(kappa=k, mean=m, a=a0 + n / 2, b=b0 + 0.5 * (xx + k0 * m0**2 - k * m**2), evidence=gaussian_evidence(n.to_numpy(float), x, xx, m0, k0, a0, b0))


def score_elbo_penalised(runs: DataFrame, elbo: str, cardinalities: str) -> DataFrame:
    """elbo_penalised: the bound less ln(k!) for each latent (array of cardinalities)."""
    k = F.aggregate(cardinalities, F.lit(0.0), lambda s, x: s + F.ln(F.factorial(x.cast("int")).cast("double")))
    return runs.withColumn("elbo_penalised", F.col(elbo) - k)


# Variational learning of latent class models and mixtures.


@dataclass
class LatentClass:
    """Posterior of a latent class model. gaussian: attribute -> (m, kappa, a, b) arrays over states; discrete: attribute -> alpha (states by values)."""

    alpha: np.ndarray
    gaussian: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    discrete: dict[str, np.ndarray]
    domains: dict[str, list[str]]
    elbo: float = -math.inf
    steps: int = 0

    @property
    def states(self) -> int:
        return len(self.alpha)

    def expected(self, latent: str = "z") -> MixtureModel:
        """The network at the posterior means, states lightest first."""
        order = np.argsort(self.alpha, kind="stable")
        g = {c: [(float(m[s]), float(b[s] / a[s])) for s in order] for c, (m, _, a, b) in self.gaussian.items()}
        d = {c: [dict(zip(self.domains[c], (t[s] / t[s].sum()).tolist(), strict=True)) for s in order] for c, t in self.discrete.items()}
        return MixtureModel((self.alpha[order] / self.alpha.sum()).tolist(), g, d, latent)


def _log_rho(model: LatentClass, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.tile(digamma(model.alpha) - digamma(model.alpha.sum()), (n, 1))
    for c, (m, kappa, a, b) in model.gaussian.items():
        v = x[c][:, None]
        term = 0.5 * (digamma(a) - np.log(b)) - 0.5 * math.log(2 * math.pi) - 0.5 * ((a / b) * (v - m) ** 2 + 1 / kappa)
        out += np.where(np.isnan(v), 0, term)
    for c, t in model.discrete.items():
        e = digamma(t) - digamma(t.sum(axis=1))[:, None]
        out += np.where(x[c][:, None] < 0, 0, e.T[np.maximum(x[c], 0)])
    return out


def _columns(b: pd.DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]]) -> dict[str, np.ndarray]:
    x = {c: pd.to_numeric(b[c]).to_numpy(float) for c in numeric}
    return x | {c: pd.Categorical(b[c], categories=list(d)).codes.astype(int) for c, d in domains.items()}


def e_step(features: DataFrame, models: Sequence[LatentClass], numeric: Sequence[str], domains: Mapping[str, Sequence[str]], weight: str | None = None) -> list[dict[str, np.ndarray]]:
    """One pass for all candidate models: the expected statistics of each, summed over partitions by key in Spark.

    Each task returns one row of numbers per candidate; their size depends on the model alone.
    """
    shared = features.sparkSession.sparkContext.broadcast(list(models))

    def run(batches):
        sums: list[np.ndarray] = []
        for b in batches:
            if not len(b):
                continue
            x, w = _columns(b, numeric, domains), b[weight].to_numpy(float) if weight else np.ones(len(b))
            parts = []
            for model in shared.value:
                rho = _log_rho(model, x, len(b))
                top = rho.max(axis=1, keepdims=True)
                e = np.exp(rho - top)
                total = e.sum(axis=1, keepdims=True)
                r = e / total * w[:, None]
                flat = [np.array([((top + np.log(total))[:, 0] * w).sum()]), r.sum(axis=0)]
                for c in numeric:
                    there = ~np.isnan(x[c])
                    v, q = x[c][there], r[there]
                    flat += [q.sum(axis=0), q.T @ v, q.T @ (v * v)]
                for c, d in domains.items():
                    there = x[c] >= 0
                    flat.append(np.stack([np.bincount(x[c][there], r[there, s], len(d)) for s in range(model.states)]).ravel())
                parts.append(np.concatenate(flat))
            sums = parts if not sums else [s + p for s, p in zip(sums, parts, strict=True)]
        for k, s in enumerate(sums):
            yield pd.DataFrame({"candidate": k, "i": np.arange(len(s)), "v": s})

    columns = [*numeric, *domains, *([weight] if weight else [])]
    rows = features.select(*columns).mapInPandas(run, "candidate int, i int, v double").groupBy("candidate", "i").agg(F.sum("v").alias("v")).toPandas()
    out = []
    for k, model in enumerate(models):
        flat = rows[rows["candidate"] == k].sort_values("i")["v"].to_numpy()
        at, stats, s = 1 + model.states, {}, model.states
        if not len(flat):
            flat = np.zeros(1 + s + 3 * s * len(numeric) + sum(s * len(d) for d in domains.values()))
        stats["bound"], stats["r"] = flat[0], flat[1:at]
        for c in numeric:
            stats[c] = flat[at : at + 3 * s].reshape(3, s)
            at += 3 * s
        for c, d in domains.items():
            stats[c] = flat[at : at + s * len(d)].reshape(s, len(d))
            at += s * len(d)
        out.append(stats)
    return out


def m_step(stats: Mapping[str, np.ndarray], prior: LatentClass) -> LatentClass:
    """Conjugate update: prior plus statistics."""
    g, d = {}, {}
    for c, (m0, k0, a0, b0) in prior.gaussian.items():
        r, s1, s2 = stats[c]
        k = k0 + r
        m = (k0 * m0 + s1) / k
        g[c] = (m, k, a0 + r / 2, np.maximum(b0 + 0.5 * (s2 + k0 * m0**2 - k * m**2), 1e-12))
    for c, t in prior.discrete.items():
        d[c] = t + stats[c]
    return LatentClass(prior.alpha + stats["r"], g, d, prior.domains)


def dirichlet_divergence(a: np.ndarray, b: np.ndarray) -> float:
    """KL of two Dirichlet distributions."""
    return float(lgamma(a.sum()) - lgamma(a).sum() - lgamma(b.sum()) + lgamma(b).sum() + ((a - b) * (digamma(a) - digamma(a.sum()))).sum())


def normal_gamma_divergence(q: Sequence[np.ndarray], p: Sequence[np.ndarray]) -> float:
    """KL of Normal-Gamma distributions (m, kappa, a, b), added up."""
    (m, k, a, b), (m0, k0, a0, b0) = q, p
    gamma = (a - a0) * digamma(a) - lgamma(a) + lgamma(a0) + a0 * (np.log(b) - np.log(b0)) + a * (b0 - b) / b
    return float((gamma + 0.5 * (np.log(k / k0) + k0 / k - 1 + k0 * (m - m0) ** 2 * a / b)).sum())


def parameter_divergences(q: LatentClass, p: LatentClass) -> dict[str, float]:
    """KL(q || p) of the parameters of the latent (under the empty name) and of each attribute."""
    out = {"": dirichlet_divergence(q.alpha, p.alpha)}
    out |= {c: normal_gamma_divergence(v, p.gaussian[c]) for c, v in q.gaussian.items()}
    return out | {c: sum(map(dirichlet_divergence, t, p.discrete[c])) for c, t in q.discrete.items()}


def parameter_divergence(q: LatentClass, p: LatentClass) -> float:
    """KL(q || p) of all parameters."""
    return sum(parameter_divergences(q, p).values())


def known_gaussian(moments: Sequence[tuple[float, float]], rows: float = 1e9) -> tuple[np.ndarray, ...]:
    """Parameters of an attribute whose (mean, variance) by state are given: a posterior of so many rows that it is a point."""
    m, v = (np.array(x, dtype=float) for x in zip(*moments, strict=True))
    return m, np.full(len(m), rows), np.full(len(m), rows), v * rows


def known_discrete(tables: Sequence[Sequence[float]], rows: float = 1e9) -> np.ndarray:
    """Parameters of an attribute whose value probabilities by state are given."""
    return np.array(tables, dtype=float) * rows


def held(model, fixed: Mapping[str, object] | None):
    """The model with the given parameters of some attributes (known_gaussian, known_discrete); as a prior and as a posterior they add nothing to the bound."""
    if fixed:
        unknown = set(fixed) - {*model.gaussian, *model.discrete}
        if unknown:
            raise ValueError(f"no such attributes: {sorted(unknown)}")
        model.gaussian = {c: fixed.get(c, v) for c, v in model.gaussian.items()}
        model.discrete = {c: fixed.get(c, v) for c, v in model.discrete.items()}
    return model


def class_prior(features: DataFrame, states: int, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], n0: float = 1.0, weight: str | None = None) -> LatentClass:
    """Priors from the data, the same for every state; the latent's is 1 per state. weight: see dirichlet_priors(), for discrete attributes alone."""
    g = {}
    if numeric:
        for r in priors_from_data(features, numeric, n0).collect():
            g[r["attribute"]] = tuple(np.full(states, max(v, 1e-9) if i == 3 else v, float) for i, v in enumerate((r["m0"] or 0.0, r["k0"], r["a0"], r["b0"] or 0.0)))
    d = {}
    for c, dom in domains.items():
        alpha = {r["value"]: r["alpha"] for r in dirichlet_priors(features, c, dom, n0, weight).collect()}
        d[c] = np.tile([alpha[v] for v in dom], (states, 1))
    return LatentClass(np.ones(states), g, d, {c: list(v) for c, v in domains.items()})


def _start(prior: LatentClass, rng: np.random.Generator) -> LatentClass:
    """A random start: means a deviation or so from the overall one, states equally likely."""
    g = {c: (m + rng.standard_normal(len(m)) * np.sqrt(b / a), k + 10, a + 5, b + 5 * b / a) for c, (m, k, a, b) in prior.gaussian.items()}
    d = {c: t + 10 * t * rng.gamma(1.0, 1.0, t.shape) for c, t in prior.discrete.items()}
    return LatentClass(prior.alpha + 10, g, d, prior.domains)


def fit_latent_class(
    features: DataFrame, states: int | Sequence[int], numeric: Sequence[str] = (), domains: Mapping[str, Sequence[str]] | None = None,
    candidates: int = 4, steps: int = 100, threshold: float = 0.01, restart: str = "pyramid", warm: int = 4, seed: int = 0, weight: str | None = None, fixed: Mapping[str, object] | None = None,
) -> dict[int, LatentClass]:
    """The best model by penalised bound for each number of states; every pass over the data serves all candidates and all numbers.

    restart `pyramid`: candidates halve after `warm`, 2 `warm`, ... steps until one is left per number of states;
    `random`: all run on. A model stops when its bound gains less than `threshold`. Missing cells are skipped.
    fixed: parameters of some attributes that are held (known_gaussian, known_discrete), for one number of states.
    """
    if fixed and not isinstance(states, int):
        raise ValueError("held parameters belong to one number of states")
    domains = dict(domains or {})
    sizes = [states] if isinstance(states, int) else list(states)
    features = features.select(*numeric, *domains, *([weight] if weight else [])).persist()  # every step reads it
    try:
        return _fit_latent_class(features, sizes, numeric, domains, candidates, steps, threshold, restart, warm, seed, weight, fixed)
    finally:
        features.unpersist()


def _fit_latent_class(features, sizes, numeric, domains, candidates, steps, threshold, restart, warm, seed, weight, fixed) -> dict[int, LatentClass]:
    priors = {k: held(class_prior(features, k, numeric, domains), fixed) for k in sizes}
    rng = np.random.default_rng(seed)
    live = [(k, held(_start(priors[k], rng), fixed)) for k in sizes for _ in range(candidates if k > 1 else 1)]
    done: list[tuple[int, LatentClass]] = []
    stage = warm
    for step in range(1, steps + 1):
        moved = []
        for (k, old), stats in zip(live, e_step(features, [m for _, m in live], numeric, domains, weight), strict=True):
            elbo = stats["bound"] - parameter_divergence(old, priors[k]) - math.lgamma(k + 1)
            gain = elbo - old.elbo  # the bound of the parameters that this pass used
            new = held(m_step(stats, priors[k]), fixed)
            new.elbo, new.steps = elbo, step
            (done if math.isfinite(old.elbo) and gain < threshold else moved).append((k, new))
        live = moved
        if restart == "pyramid" and step == stage:
            for k in sizes:
                mine = sorted((x for x in live if x[0] == k), key=lambda x: -x[1].elbo)
                keep = mine[: max(1, len(mine) // 2)]
                live = [x for x in live if x[0] != k] + keep
            stage += 2 * step
        if not live:
            break
    best: dict[int, LatentClass] = {}
    for k, m in [*done, *live]:
        if k not in best or m.elbo > best[k].elbo:
            best[k] = m
    return best


def select_cardinality(features: DataFrame, numeric: Sequence[str] = (), domains: Mapping[str, Sequence[str]] | None = None, most: int = 6, **options) -> LatentClass:
    """The first number of states, from 1, after which the bound does not rise; all numbers share each pass."""
    fits = fit_latent_class(features, range(1, most + 1), numeric, domains, **options)
    best = fits[1]
    for k in range(2, most + 1):
        if fits[k].elbo <= best.elbo:
            break
        best = fits[k]
    return best


def fit_mixture(features: DataFrame, states: int, numeric: Sequence[str], full: bool = False, candidates: int = 4, steps: int = 60, threshold: float = 0.01, limit: float = 20.0, seed: int = 0, blocks: Sequence[Sequence[str]] | None = None) -> dict:
    """EM of a Gaussian mixture, all restarts in one pass: weights, means, covariances, log_likelihood, bic.

    full: one covariance matrix per state. blocks: groups of attributes that have joint covariances, others are independent within a state. For
    the rest see fit_mixtures().
    """
    groups = blocks if blocks is not None else [list(numeric)] if full else [[c] for c in numeric]
    return fit_mixtures(features, numeric, [(states, groups)], candidates, steps, threshold, limit, seed)[0]


def _joint_pairs(models: Sequence[Sequence[np.ndarray]]) -> list[tuple[int, int]]:
    """Pairs of attributes that share a group of some model."""
    return sorted({(int(i), int(j)) for groups in models for g in groups for i, j in itertools.combinations(sorted(g), 2)})


def _quadratic(x: np.ndarray, pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """Rows by terms: 1, the columns, their squares and the products of pairs."""
    i, j = np.array(pairs, dtype=int).reshape(-1, 2).T
    return np.concatenate([np.ones((len(x), 1)), x, x * x, x[:, i] * x[:, j]], axis=1)


def _log_coefficients(model: tuple, groups: Sequence[np.ndarray], pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """Terms by states: ln of weight times density, attributes independent between groups, is their product with _quadratic()."""
    w, mu, cov = model
    d, at = mu.shape[1], {p: k for k, p in enumerate(pairs)}
    out = np.zeros((1 + 2 * d + len(pairs), len(w)))
    out[0] = np.log(np.maximum(w, 1e-300))
    for g in groups:
        for s in range(len(w)):
            part, m = cov[s][np.ix_(g, g)], mu[s, g]
            inverse = np.linalg.inv(part)
            out[0, s] -= 0.5 * (np.linalg.slogdet(part)[1] + m @ inverse @ m + len(g) * math.log(2 * math.pi))
            out[1 + g, s] += inverse @ m
            out[1 + d + g, s] -= 0.5 * np.diag(inverse)
            for a, b in itertools.combinations(range(len(g)), 2):
                out[1 + 2 * d + at[tuple(sorted((int(g[a]), int(g[b]))))], s] -= (inverse[a, b] + inverse[b, a]) / 2
    return out


def fit_mixtures(features: DataFrame, numeric: Sequence[str], models: Sequence[tuple[int, Sequence[Sequence[str]]]], candidates: int = 4, steps: int = 60, threshold: float = 0.01, limit: float = 20.0, seed: int = 0) -> list[dict]:
    """EM of several Gaussian mixtures (states, groups of attributes with joint covariances), all their restarts in shared passes; the best restart of each.

    Rows with a missing cell are left out; if none is left, that is an error. Statistics are n, sums and sums of products within groups about the table's
    mean. Equal rows are counted first and estimated once; a pass multiplies the terms of the rows with the coefficients of all models and restarts. The eigenvalues of a covariance, in units of the table's deviations, are kept within 1 / limit^2 and limit. A start stops when its likelihood gains less than `threshold`.
    """
    rows = features.dropna(subset=list(numeric)).select(*[F.col(c).cast("double").alias(c) for c in numeric])
    one = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{c}") for c in numeric for p, f in (("m", F.avg), ("v", F.var_pop))]).first()
    n, d = one["n"], len(numeric)
    if not n:
        raise ValueError("no row has a value in every column")
    centre, var = np.array([one[f"m{c}"] for c in numeric]), np.array([max(one[f"v{c}"], 1e-12) for c in numeric])
    unit = np.sqrt(np.outer(var, var))
    groups = [[np.array([list(numeric).index(c) for c in g]) for g in blocks] for _, blocks in models]
    live = []
    for at, (states, _) in enumerate(models):
        rng = np.random.default_rng(seed)
        live += [(at, -np.inf, (np.full(states, 1 / states), rng.standard_normal((states, d)) * np.sqrt(var), np.stack([np.diag(var)] * states))) for _ in range(candidates)]
    best: list[dict | None] = [None] * len(models)
    rows = rows.groupBy(*numeric).agg(F.count("*").alias("_rows")).persist()  # every step reads it
    try:
        for _ in range(steps):
            pairs = _joint_pairs([groups[at] for at, _, _ in live])
            place = {p: 1 + 2 * d + k for k, p in enumerate(pairs)} | {p[::-1]: 1 + 2 * d + k for k, p in enumerate(pairs)} | {(i, i): 1 + d + i for i in range(d)}
            shared = rows.sparkSession.sparkContext.broadcast(np.concatenate([_log_coefficients(m, groups[at], pairs) for at, _, m in live], axis=1))
            ends = np.cumsum([0, *(models[at][0] for at, _, _ in live)])

            def run(batches, shared=shared, pairs=pairs, ends=ends):
                total, fit = 0.0, np.zeros(len(ends) - 1)
                for b in batches:
                    for begin in range(0, len(b), 4096):  # what a step holds stays in the processor's cache
                        some = b.iloc[begin : begin + 4096]
                        w = some["_rows"].to_numpy(float)
                        terms = _quadratic(some[list(numeric)].to_numpy(float) - centre, pairs)
                        r = terms @ shared.value
                        for k in range(len(fit)):
                            logs = r[:, ends[k] : ends[k + 1]]
                            top = logs.max(axis=1, keepdims=True)
                            np.exp(logs - top, out=logs)
                            t = logs.sum(axis=1, keepdims=True)
                            fit[k] += w @ (top + np.log(t))[:, 0]
                            logs *= w[:, None] / t
                        total = total + terms.T @ r
                if len(fit) and not np.isscalar(total):
                    for k, f in enumerate(fit):
                        v = np.append(f, total[:, ends[k] : ends[k + 1]].ravel())
                        yield pd.DataFrame({"candidate": k, "i": np.arange(len(v)), "v": v})

            got = rows.mapInPandas(run, "candidate int, i int, v double").groupBy("candidate", "i").agg(F.sum("v").alias("v")).toPandas()
            after = []
            for k, (at, past, model) in enumerate(live):
                v, states = got[got["candidate"] == k].sort_values("i")["v"].to_numpy(), models[at][0]
                if best[at] is None or v[0] > best[at]["log_likelihood"]:
                    best[at] = {"log_likelihood": float(v[0]), "weights": model[0], "means": model[1] + centre, "covariances": model[2]}
                if v[0] - past >= threshold:
                    sums = v[1:].reshape(-1, states)
                    after.append((at, v[0], _mixture_step(sums, place, groups[at], var, unit, limit)))
            live = after
            if not live:
                break
    finally:
        rows.unpersist()
    out = []
    for (states, blocks), found in zip(models, best, strict=True):
        dim = states - 1 + states * (d + sum(len(g) * (len(g) + 1) // 2 for g in blocks))
        out.append(found | {"n": n, "dim": dim, "bic": found["log_likelihood"] - dim * math.log(n) / 2})
    return out


def _mixture_step(sums: np.ndarray, place: Mapping[tuple[int, int], int], groups: Sequence[np.ndarray], var: np.ndarray, unit: np.ndarray, limit: float) -> tuple:
    """Weights, means and limited covariances from the sums of a pass: terms by states, the products of two attributes in row `place`."""
    d, r = len(var), np.maximum(sums[0], 1e-9)
    mu = (sums[1 : 1 + d] / r).T
    square = (sums[1 + d : 1 + 2 * d] / r).T - mu * mu
    cov = np.stack([np.diag(np.clip(s, var / limit**2, var * limit)) for s in square])
    for g in groups:
        for s in range(len(r) if len(g) > 1 else 0):
            second = np.array([[sums[place[int(a), int(b)], s] for b in g] for a in g]) / r[s] - np.outer(mu[s, g], mu[s, g])
            values, vectors = np.linalg.eigh((second + second.T) / 2 / unit[np.ix_(g, g)])  # in units of the table's deviations, so that one limit fits all attributes
            cov[s][np.ix_(g, g)] = (vectors * np.clip(values, 1 / limit**2, limit)) @ vectors.T * unit[np.ix_(g, g)]
    return r / r.sum(), mu, cov


def select_mixture(features: DataFrame, numeric: Sequence[str], most: int = 6, **options) -> dict:
    """The Gaussian mixture with the first number of states, from 1, after which BIC does not rise, with its `states`."""
    best = {"states": 1} | fit_mixture(features, 1, numeric, **(options | {"candidates": 1}))
    for k in range(2, most + 1):
        new = {"states": k} | fit_mixture(features, k, numeric, **options)
        if new["bic"] <= best["bic"]:
            break
        best = new
    return best
