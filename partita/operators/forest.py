"""Latent forests: several discrete latents, each a clustering of the same rows, learnt by mean-field passes over Spark.

Every attribute has at most one latent parent and every latent at most one latent parent. The structure is small and
lives on the driver; a pass over the data serves all candidate structures of a search round.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.functions.special import digamma
from partita.operators.dependence import mutual_info_matrix
from partita.operators.parameters import _columns, class_prior, dirichlet_divergence, dirichlet_evidence, gaussian_evidence, normal_gamma_divergence
from partita.operators.scoring import ForestModel
from partita.sources.scratch import stored

#: The parent of attributes without a latent: one state.
ALONE = ""
#: The column of counted(): how many rows a row stands for.
ROWS = "_rows"


def counted(features: DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]]) -> tuple[DataFrame, str | None]:
    """The attributes; without numeric ones each combination of values once, and the name of the column that says in how many rows it is.

    All statistics of discrete attributes are sums over rows, so passes over the combinations give the same: their number is bounded by the
    values and by the rows, whatever the table's size.
    """
    if numeric or not domains:
        return features.select(*numeric, *domains), None
    return features.groupBy(*domains).agg(F.count("*").alias(ROWS)), ROWS


def _weights(b: pd.DataFrame, weight: str | None) -> np.ndarray:
    return b[weight].to_numpy(float) if weight else np.ones(len(b))


@dataclass(frozen=True)
class Structure:
    """cards: states of each latent; up: the latent parent of a latent; of: the latent parent of each attribute (ALONE: none)."""

    cards: Mapping[str, int]
    up: Mapping[str, str]
    of: Mapping[str, str]

    def states(self, latent: str) -> int:
        return 1 if latent == ALONE else self.cards[latent]

    def children(self, latent: str) -> list[str]:
        return [c for c, p in [*self.up.items(), *self.of.items()] if p == latent]

    def cyclic(self) -> bool:
        for z in self.cards:
            seen, at = set(), z
            while at in self.up:
                if at in seen:
                    return True
                seen.add(at)
                at = self.up[at]
        return False


@dataclass
class Forest:
    """Posterior parameters of a structure: latents (arrays of parent states by states), gaussian and discrete attributes by parent state."""

    structure: Structure
    latents: dict[str, np.ndarray]
    gaussian: dict[str, tuple[np.ndarray, ...]]
    discrete: dict[str, np.ndarray]
    elbo: float = -math.inf
    trace: list[float] = field(default_factory=list)

    def expected(self, domains: Mapping[str, Sequence[str]] | None = None) -> ForestModel:
        """The network at the posterior means; domains name the values of the discrete attributes. It can be saved, and scores rows exactly."""
        s, domains = self.structure, domains or {}
        latents = {z: (a / a.sum(axis=1, keepdims=True)).tolist() for z, a in self.latents.items()}
        g = {c: list(zip(m.tolist(), (b / a).tolist(), strict=True)) for c, (m, _, a, b) in self.gaussian.items()}
        d = {c: [dict(zip(domains[c], row, strict=True)) for row in (t / t.sum(axis=1, keepdims=True)).tolist()] for c, t in self.discrete.items()}
        return ForestModel(dict(s.cards), dict(s.up), dict(s.of), latents, g, d)


def forest_prior(base, structure: Structure) -> Forest:
    """Priors: those of `base` (class_prior with one state) for attributes, 1 per state for latents."""
    latents = {z: np.ones((structure.states(structure.up.get(z, ALONE)), k)) for z, k in structure.cards.items()}
    g = {c: tuple(np.full(structure.states(structure.of[c]), v[0]) for v in base.gaussian[c]) for c in base.gaussian}
    d = {c: np.tile(base.discrete[c][0], (structure.states(structure.of[c]), 1)) for c in base.discrete}
    return Forest(structure, latents, g, d)


def forest_start(prior: Forest, rng: np.random.Generator, like: Forest | None = None) -> Forest:
    """A start: parts that `like` has in the same shape are taken over, the others are perturbed priors."""
    latents, g, d = {}, {}, {}
    for z, a in prior.latents.items():
        old = like.latents.get(z) if like else None
        latents[z] = old.copy() if old is not None and old.shape == a.shape else a + 10
    for c, (m, k, a, b) in prior.gaussian.items():
        old = like.gaussian.get(c) if like else None
        if old is not None and len(old[0]) == len(m) and like.structure.of[c] == prior.structure.of[c]:
            g[c] = tuple(v.copy() for v in old)
        else:
            noise = rng.standard_normal(len(m)) if len(m) > 1 else 0.0
            g[c] = (m + noise * np.sqrt(b / a), k + 10, a + 5, b + 5 * b / a)
    for c, t in prior.discrete.items():
        old = like.discrete.get(c) if like else None
        if old is not None and old.shape == t.shape and like.structure.of[c] == prior.structure.of[c]:
            d[c] = old.copy()
        else:
            d[c] = t + 10 * t * (rng.gamma(1.0, 1.0, t.shape) if len(t) > 1 else 1.0)
    return Forest(prior.structure, latents, g, d)


def _emissions(model: Forest, x: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Expected log densities of the attributes below each latent, rows by states; missing cells add nothing."""
    s = model.structure
    out = {z: np.zeros((n, s.states(z))) for z in [*s.cards, ALONE]}
    for c, (m, kappa, a, b) in model.gaussian.items():
        v = x[c][:, None]
        term = 0.5 * (digamma(a) - np.log(b)) - 0.5 * math.log(2 * math.pi) - 0.5 * ((a / b) * (v - m) ** 2 + 1 / kappa)
        out[s.of[c]] += np.where(np.isnan(v), 0, term)
    for c, t in model.discrete.items():
        e = digamma(t) - digamma(t.sum(axis=1))[:, None]
        out[s.of[c]] += np.where(x[c][:, None] < 0, 0, e.T[np.maximum(x[c], 0)])
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def responsibilities(model: Forest, x: dict[str, np.ndarray], n: int, sweeps: int = 8, w: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], float]:
    """q of every latent for n rows by coordinate sweeps, and their part of the bound (w: how many rows each stands for)."""
    w = np.ones(n) if w is None else w
    s = model.structure
    local = _emissions(model, x, n)
    logp = {z: digamma(a) - digamma(a.sum(axis=1))[:, None] for z, a in model.latents.items()}
    q = {z: _softmax(local[z] + logp[z].mean(axis=0)) for z in s.cards}
    q[ALONE] = np.ones((n, 1))
    linked = bool(s.up)
    for _ in range(sweeps if linked else 1):
        for z in s.cards:
            score = local[z] + q[s.up.get(z, ALONE)] @ logp[z]
            for child in (c for c, p in s.up.items() if p == z):
                score = score + q[child] @ logp[child].T
            q[z] = _softmax(score)
    bound = float(w @ local[ALONE][:, 0])
    for z in s.cards:
        bound += float(w @ (q[z] * (local[z] + q[s.up.get(z, ALONE)] @ logp[z] - np.log(np.maximum(q[z], 1e-300)))).sum(axis=1))
    return q, bound


def forest_e_step(features: DataFrame, models: Sequence[Forest], numeric: Sequence[str], domains: Mapping[str, Sequence[str]], weight: str | None = None) -> list[dict]:
    """One pass for all models: their expected statistics, added by Spark; a task returns numbers of the models' size only. weight: the column of counted()."""
    shared = features.sparkSession.sparkContext.broadcast(list(models))

    def run(batches):
        sums: list[np.ndarray] = []
        for b in batches:
            if not len(b):
                continue
            x, w, parts = _columns(b, numeric, domains), _weights(b, weight), []
            for model in shared.value:
                s = model.structure
                q, bound = responsibilities(model, x, len(b), w=w)
                above = {z: (q[z] * w[:, None]) for z in q}
                flat = [np.array([bound])] + [(above[s.up.get(z, ALONE)].T @ q[z]).ravel() for z in s.cards]
                for c in numeric:
                    there = ~np.isnan(x[c])
                    r, v = above[s.of[c]][there], x[c][there]
                    flat += [r.sum(axis=0), r.T @ v, r.T @ (v * v)]
                for c, d in domains.items():
                    there = x[c] >= 0
                    r = above[s.of[c]][there]
                    flat.append(np.stack([np.bincount(x[c][there], r[:, k], len(d)) for k in range(r.shape[1])]).ravel())
                parts.append(np.concatenate(flat))
            sums = parts if not sums else [a + p for a, p in zip(sums, parts, strict=True)]
        for k, v in enumerate(sums):
            yield pd.DataFrame({"candidate": k, "i": np.arange(len(v)), "v": v})

    got = features.select(*numeric, *domains, *([weight] if weight else [])).mapInPandas(run, "candidate int, i int, v double").groupBy("candidate", "i").agg(F.sum("v").alias("v")).toPandas()
    out = []
    for k, model in enumerate(models):
        s, flat = model.structure, got[got["candidate"] == k].sort_values("i")["v"].to_numpy()
        at, stats = 1, {"bound": flat[0]}
        for z, a in model.latents.items():
            stats[z] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        for c in numeric:
            n = s.states(s.of[c])
            stats[c] = flat[at : at + 3 * n].reshape(3, n)
            at += 3 * n
        for c in domains:
            t = model.discrete[c]
            stats[c] = flat[at : at + t.size].reshape(t.shape)
            at += t.size
        out.append(stats)
    return out


def forest_m_step(stats: Mapping, prior: Forest) -> Forest:
    g = {}
    for c, (m0, k0, a0, b0) in prior.gaussian.items():
        r, s1, s2 = stats[c]
        k = k0 + r
        m = (k0 * m0 + s1) / k
        g[c] = (m, k, a0 + r / 2, np.maximum(b0 + 0.5 * (s2 + k0 * m0**2 - k * m**2), 1e-12))
    return Forest(prior.structure, {z: a + stats[z] for z, a in prior.latents.items()}, g, {c: t + stats[c] for c, t in prior.discrete.items()})


def forest_divergences(q: Forest, p: Forest) -> dict[str, float]:
    """KL of the parameters of each node."""
    out = {z: sum(map(dirichlet_divergence, a, p.latents[z])) for z, a in q.latents.items()}
    out |= {c: normal_gamma_divergence(v, p.gaussian[c]) for c, v in q.gaussian.items()}
    return out | {c: sum(map(dirichlet_divergence, t, p.discrete[c])) for c, t in q.discrete.items()}


def forest_divergence(q: Forest, p: Forest) -> float:
    """KL of all parameters."""
    return sum(forest_divergences(q, p).values())


def fit_forests(features: DataFrame, starts: Sequence[Forest], priors: Sequence[Forest], numeric: Sequence[str], domains: Mapping[str, Sequence[str]], steps: int = 30, threshold: float = 0.01, weight: str | None = None) -> list[Forest]:
    """Every start run to convergence; those still moving share each pass. The bound is penalised by ln k! for each latent."""
    now, done = list(starts), {}
    live = list(range(len(now)))
    for _ in range(steps):
        stats = forest_e_step(features, [now[i] for i in live], numeric, domains, weight)
        still = []
        for i, s in zip(live, stats, strict=True):
            old = now[i]
            elbo = s["bound"] - forest_divergence(old, priors[i]) - sum(math.lgamma(k + 1) for k in old.structure.cards.values())
            new = forest_m_step(s, priors[i])
            new.elbo, new.trace = elbo, [*old.trace, elbo]
            now[i] = new
            if math.isfinite(old.elbo) and elbo - old.elbo < threshold:
                done[i] = new
            else:
                still.append(i)
        live = still
        if not live:
            break
    return now


# Local updates: a move changes few nodes, so only these, and what hangs on them, are estimated again.


def node_evidence(stats: Mapping[str, np.ndarray], prior: Forest, node: str) -> float:
    """What a node adds to the bound at the best parameters for its expected statistics: the log of the ratio of normalisers of posterior and prior."""
    if node in prior.gaussian:
        return float(np.sum(gaussian_evidence(*stats[node], *prior.gaussian[node])))
    table = prior.latents[node] if node in prior.latents else prior.discrete[node]
    return sum(dirichlet_evidence(n, alpha) for n, alpha in zip(stats[node], table, strict=True))


@dataclass
class Completed:
    """A model with its rows: `rows` has the features (and the column `weight` of counted()) and, as q_<latent>_<state>, each row's probabilities of every latent, and is a written table;
    stats are the sums of every node and entropy those of every latent over it."""

    rows: DataFrame
    model: Forest
    stats: dict[str, np.ndarray]
    entropy: dict[str, float]
    elbo: float
    weight: str | None = None


def _penalty(s: Structure) -> float:
    return sum(math.lgamma(k + 1) for k in s.cards.values())


def _q_columns(s: Structure, latent: str) -> list[str]:
    return [f"q_{latent}_{i}" for i in range(s.cards[latent])]


def complete(features: DataFrame, model: Forest, prior: Forest, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], weight: str | None = None) -> Completed:
    """Rows with the probabilities of all latents under the model, written once, and their sums."""
    shared, latents = features.sparkSession.sparkContext.broadcast(model), list(model.structure.cards)
    columns = [*numeric, *domains]
    held = [*columns, *([weight] if weight else [])]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in features.select(*held).schema] + [f"{c} double" for z in latents for c in _q_columns(model.structure, z)])

    def run(batches):
        for b in batches:
            q, _ = responsibilities(shared.value, _columns(b, numeric, domains), len(b))
            yield b.assign(**{c: q[z][:, i] for z in latents for i, c in enumerate(_q_columns(model.structure, z))})

    rows = stored(features.select(*held).mapInPandas(run, schema), "completed")
    bare = Completed(rows, model, {}, {}, -math.inf, weight)
    nodes = [*latents, *columns]
    stats, entropy = _local_sums(bare, [Local(model, prior, (), tuple(nodes), tuple(latents))], numeric, domains)[0]
    fitted = forest_m_step(stats, prior)
    elbo = sum(node_evidence(stats, prior, c) for c in nodes) + sum(entropy.values()) - _penalty(model.structure)
    fitted.elbo = elbo
    return Completed(rows, fitted, stats, entropy, elbo, weight)


@dataclass
class Local:
    """A candidate: latents whose probabilities are computed anew, nodes whose parameters are, and latents whose entropy is wanted."""

    model: Forest
    prior: Forest
    latents: tuple[str, ...]
    nodes: tuple[str, ...]
    entropies: tuple[str, ...]

    def columns(self) -> set[str]:
        """Attributes that a pass reads for it."""
        of = self.model.structure.of
        return {c for c in self.nodes if c in of} | {c for c, z in of.items() if z in self.latents}


def local_change(old: Structure, new: Structure) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(latents, nodes) that a move from old to new touches: latents that are new or have other states, parents or children; they and their children, and all whose parent changed."""
    parents = lambda s, c: s.of.get(c, s.up.get(c, ALONE))
    moved = {z for z in new.cards if old.cards.get(z) != new.cards[z] or parents(old, z) != parents(new, z) or set(old.children(z)) != set(new.children(z))}
    nodes = {*moved, *(c for z in moved for c in new.children(z)), *(c for c in new.of if old.of[c] != new.of[c])}
    return tuple(sorted(moved)), tuple(sorted(nodes))


def _local_q(c: Local, x: dict[str, np.ndarray], kept: Mapping[str, np.ndarray], n: int, sweeps: int = 8) -> dict[str, np.ndarray]:
    """Probabilities of the candidate's own latents, given those of the others as they are kept."""
    s, model = c.model.structure, c.model
    logp = {z: digamma(a) - digamma(a.sum(axis=1))[:, None] for z, a in model.latents.items()}
    local = {z: np.zeros((n, s.cards[z])) for z in c.latents}
    for a, z in s.of.items():
        if z in local:
            part = Forest(Structure({z: s.cards[z]}, {}, {a: z}), {}, {a: model.gaussian[a]} if a in model.gaussian else {}, {a: model.discrete[a]} if a in model.discrete else {})
            local[z] += _emissions(part, x, n)[z]
    q = {ALONE: np.ones((n, 1))} | {z: v for z, v in kept.items() if z in s.cards}
    for z in c.latents:
        if z not in q or q[z].shape[1] != s.cards[z]:
            q[z] = _softmax(local[z] + logp[z].mean(axis=0))
    linked = any(s.up.get(z) in c.latents for z in c.latents)
    for _ in range(sweeps if linked else 1):
        for z in c.latents:
            score = local[z] + q[s.up.get(z, ALONE)] @ logp[z]
            for child in (y for y, p in s.up.items() if p == z):
                score = score + q[child] @ logp[child].T
            q[z] = _softmax(score)
    return q


def _local_sums(state: Completed, candidates: Sequence[Local], numeric: Sequence[str], domains: Mapping[str, Sequence[str]]) -> list[tuple[dict, dict]]:
    """(statistics of its nodes, entropies) of every candidate, in one pass over the columns that any of them needs."""
    shared = state.rows.sparkSession.sparkContext.broadcast(list(candidates))
    needed = {c for x in candidates for c in x.columns()}
    num, dom = [c for c in numeric if c in needed], {c: d for c, d in domains.items() if c in needed}
    kept_structure = state.model.structure
    held, weight = list(kept_structure.cards), state.weight

    def run(batches):
        sums: list[np.ndarray] = []
        for b in batches:
            if not len(b):
                continue
            x, w, kept = _columns(b, num, dom), _weights(b, weight), {z: b[_q_columns(kept_structure, z)].to_numpy(float) for z in held}
            parts = []
            for c in shared.value:
                s = c.model.structure
                q = _local_q(c, x, kept, len(b)) if c.latents else {ALONE: np.ones((len(b), 1))} | {z: v for z, v in kept.items() if z in s.cards}
                flat = [np.array([-(w @ (q[z] * np.log(np.maximum(q[z], 1e-300))).sum(axis=1)) for z in c.entropies])]
                for node in c.nodes:
                    r = q[s.up.get(node, ALONE) if node in s.cards else s.of[node]] * w[:, None]
                    if node in s.cards:
                        flat.append((r.T @ q[node]).ravel())
                    elif node in num:
                        there = ~np.isnan(x[node])
                        v, u = x[node][there], r[there]
                        flat += [u.sum(axis=0), u.T @ v, u.T @ (v * v)]
                    else:
                        there = x[node] >= 0
                        flat.append(np.stack([np.bincount(x[node][there], r[there, k], len(dom[node])) for k in range(r.shape[1])]).ravel())
                parts.append(np.concatenate(flat))
            sums = parts if not sums else [p + q for p, q in zip(sums, parts, strict=True)]
        for k, v in enumerate(sums):
            yield pd.DataFrame({"candidate": k, "i": np.arange(len(v)), "v": v})

    got = state.rows.select(*num, *dom, *([weight] if weight else []), *[c for z in held for c in _q_columns(kept_structure, z)]).mapInPandas(run, "candidate int, i int, v double").groupBy("candidate", "i").agg(F.sum("v").alias("v")).toPandas()
    out = []
    for k, c in enumerate(candidates):
        s, flat = c.model.structure, got[got["candidate"] == k].sort_values("i")["v"].to_numpy()
        at, stats = len(c.entropies), {}
        for node in c.nodes:
            shape = c.prior.latents[node].shape if node in s.cards else (3, s.states(s.of[node])) if node in num else c.prior.discrete[node].shape
            stats[node] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        out.append((stats, dict(zip(c.entropies, flat, strict=False))))
    return out


def fit_locally(state: Completed, starts: Sequence[Forest], priors: Sequence[Forest], numeric: Sequence[str], domains: Mapping[str, Sequence[str]], steps: int = 10, threshold: float = 0.01) -> list[Forest]:
    """Candidates next to the completed model, each estimated again only around its change; those still moving share each pass.

    Nodes that a move leaves alone keep their sums, latents their probabilities; so a bound is that of all rows and all nodes, while a pass reads
    the columns and computes the latents of the changed places only. To be followed by global passes, from which they start.
    """
    live = []
    for i, (start, prior) in enumerate(zip(starts, priors, strict=True)):
        latents, nodes = local_change(state.model.structure, start.structure)
        live.append((i, Local(start, prior, latents, nodes, latents)))
    out: list[Forest] = list(starts)
    for _ in range(steps):
        sums, still = _local_sums(state, [c for _, c in live], numeric, domains), []
        for (i, c), (stats, entropy) in zip(live, sums, strict=True):
            s = c.model.structure
            whole = {n: v for n, v in state.stats.items() if n in s.cards or n in s.of} | stats
            hidden = {z: v for z, v in state.entropy.items() if z in s.cards} | entropy
            new = forest_m_step(whole, c.prior)
            new.elbo = sum(node_evidence(whole, c.prior, n) for n in [*s.cards, *s.of]) + sum(hidden.values()) - _penalty(s)
            new.trace = [*c.model.trace, new.elbo]
            gain, out[i] = new.elbo - out[i].elbo, new
            if not (len(new.trace) > 1 and gain < threshold):
                still.append((i, replace(c, model=new)))
        live = still
        if not live:
            break
    return out


def fit_latent_forest(features: DataFrame, structure: Structure, numeric: Sequence[str] = (), domains: Mapping[str, Sequence[str]] | None = None, candidates: int = 3, steps: int = 40, seed: int = 0) -> Forest:
    """The best of several starts of one structure."""
    domains, rng = dict(domains or {}), np.random.default_rng(seed)
    rows, weight = counted(features, numeric, domains)
    rows = rows.persist()  # every pass reads it
    try:
        prior = forest_prior(class_prior(rows, 1, numeric, domains, weight=weight), structure)
        return max(fit_forests(rows, [forest_start(prior, rng) for _ in range(candidates)], [prior] * candidates, numeric, domains, steps, weight=weight), key=lambda m: m.elbo)
    finally:
        rows.unpersist()


def assign(features: DataFrame, model: Forest, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """(key, a label column per latent): the most probable state of each."""
    return labelled(features, model, numeric, domains, [key])


def labelled(features: DataFrame, model: Forest, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """The columns `keep` and a label column per latent: the most probable state of each."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    latents = list(model.structure.cards)

    def run(batches):
        for b in batches:
            q, _ = responsibilities(shared.value, _columns(b, numeric, domains), len(b))
            yield pd.DataFrame({c: b[c] for c in keep} | {z: q[z].argmax(axis=1) for z in latents})

    kinds = [f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep]
    return features.select(*dict.fromkeys([*keep, *numeric, *domains])).mapInPandas(run, ", ".join([*kinds, *[f"{z} int" for z in latents]]))


# Search moves: each gives structures that differ from the current one in one place.


def _new_name(s: Structure) -> str:
    return next(f"z{i}" for i in itertools.count(1) if f"z{i}" not in s.cards)


def add_latents(s: Structure, pairs: Sequence[tuple[str, str]]) -> list[Structure]:
    """A two-state latent over a pair of attributes or roots; a pair of a free attribute and one with a latent joins that latent."""
    out = []
    for a, b in pairs:
        pa, pb = (s.of.get(v, s.up.get(v, ALONE)) for v in (a, b))
        if pa == pb == ALONE:
            z = _new_name(s)
            up, of = dict(s.up), dict(s.of)
            for v in (a, b):
                (up if v in s.cards else of)[v] = z
            out.append(Structure({**s.cards, z: 2}, up, of))
        elif ALONE in (pa, pb):
            free, home = (a, pb) if pa == ALONE else (b, pa)
            if free in s.of:
                out.append(replace(s, of={**s.of, free: home}))
    return out


def change_cards(s: Structure, most: int = 8, less: bool = True) -> list[Structure]:
    out = [replace(s, cards={**s.cards, z: k + 1}) for z, k in s.cards.items() if k < most]
    return out + ([replace(s, cards={**s.cards, z: k - 1}) for z, k in s.cards.items() if k > 2] if less else [])


def add_arcs(s: Structure) -> list[Structure]:
    out = [replace(s, up={**s.up, b: a}) for a in s.cards for b in s.cards if a != b and b not in s.up]
    return [x for x in out if not x.cyclic()]


def remove_latents(s: Structure) -> list[Structure]:
    out = []
    for z in s.cards:
        above = s.up.get(z, ALONE)
        up = {c: p for c, p in s.up.items() if c != z and p != z} | ({c: above for c, p in s.up.items() if p == z} if above != ALONE else {})
        out.append(Structure({c: k for c, k in s.cards.items() if c != z}, up, {c: above if p == z else p for c, p in s.of.items()}))
    return out


def relocate(s: Structure) -> list[Structure]:
    return [replace(s, of={**s.of, c: z}) for c, p in s.of.items() for z in [*s.cards, ALONE] if z != p]


def insert_latents(s: Structure) -> list[Structure]:
    """A latent between a latent and two of its attributes, where it has more than two children."""
    out = []
    for z in s.cards:
        mine = [c for c, p in s.of.items() if p == z]
        if len(s.children(z)) > 2:
            for a, b in itertools.combinations(mine, 2):
                name = _new_name(s)
                out.append(Structure({**s.cards, name: 2}, {**s.up, name: z}, {**s.of, a: name, b: name}))
    return out


def _useful(s: Structure) -> bool:
    return not s.cyclic() and all(s.children(z) for z in s.cards)


def dimension(prior: Forest) -> int:
    """Free numbers to estimate."""
    latents = sum(a.shape[0] * (a.shape[1] - 1) for a in prior.latents.values())
    return latents + sum(2 * len(v[0]) for v in prior.gaussian.values()) + sum(t.shape[0] * (t.shape[1] - 1) for t in prior.discrete.values())


@dataclass(frozen=True)
class Phase:
    """Moves of a stage of a search. per_number: the best move is that of the highest gain for each number that it adds to estimate, else the one of the highest bound."""

    moves: Callable[[Forest], list[Structure]]
    per_number: bool = False


def search(features: DataFrame, start: Structure, moves, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], rounds: int = 20, screen: int = 4, keep: int = 3, steps: int = 30, seed: int = 0, local: bool = True, tried: list[int] | None = None, weight: str | None = None) -> Forest:
    """Hill climbing: all candidates of a round are screened in shared passes, the best few are fitted on, the best is taken while the bound rises.

    moves: a function from a model to structures, or a sequence of Phases: each is climbed until none of its moves gains, then the next, and all over again
    until none of them gains anything; the structure that the last move left is not gone back to. local: screening estimates only the surroundings of a
    move (fit_locally); else all nodes of every candidate. rounds bounds the moves taken; tried collects the number of candidates of every round.
    weight: the column of features that are counted() already.
    """
    phases = list(moves) if isinstance(moves, Sequence) else [Phase(moves)]
    if not weight:
        features, weight = counted(features, numeric, domains)
    features = features.persist()  # every pass reads it
    try:
        return _search(features, start, phases, numeric, domains, rounds, screen, keep, steps, seed, local, [] if tried is None else tried, weight)
    finally:
        features.unpersist()


def _search(features, start, phases, numeric, domains, rounds, screen, keep, steps, seed, local, tried, weight) -> Forest:
    rng = np.random.default_rng(seed)
    base = class_prior(features, 1, numeric, domains, weight=weight)
    prior = forest_prior(base, start)
    best, left = fit_forests(features, [forest_start(prior, rng)], [prior], numeric, domains, steps, weight=weight)[0], None
    idle, at = 0, 0
    while idle < len(phases) and rounds > 0:
        phase = phases[at % len(phases)]
        options = list({repr(s): s for s in phase.moves(best) if _useful(s) and repr(s) != left}.values())
        top = _best_move(features, best, options, base, rng, numeric, domains, screen, keep, steps, local, phase.per_number, weight) if options else None
        tried.append(len(options))
        rounds -= 1
        if top is None or top.elbo <= best.elbo + 0.01:
            idle, at = idle + 1, at + 1
            continue
        left, best, idle = repr(best.structure), top, 0
    return best


def _best_move(features, best, options, base, rng, numeric, domains, screen, keep, steps, local, per_number, weight) -> Forest:
    priors = [forest_prior(base, s) for s in options]
    starts = [forest_start(p, rng, best) for p in priors]
    size = dimension(forest_prior(base, best.structure))

    def worth(model: Forest, prior: Forest) -> float:
        gain = model.elbo - best.elbo
        return gain / max(dimension(prior) - size, 1) if per_number and gain > 0 else gain

    if local:
        state = complete(features, best, forest_prior(base, best.structure), numeric, domains, weight)
        screened = fit_locally(state, starts, priors, numeric, domains, screen)
    else:
        screened = fit_forests(features, starts, priors, numeric, domains, screen, weight=weight)
    order = sorted(range(len(screened)), key=lambda i: -worth(screened[i], priors[i]))[:keep]
    fitted = fit_forests(features, [replace(screened[i], elbo=-math.inf, trace=[]) for i in order], [priors[i] for i in order], numeric, domains, steps, weight=weight)
    return max(zip(fitted, order, strict=True), key=lambda m: worth(m[0], priors[m[1]]))[0]


def _empty(numeric: Sequence[str], domains: Mapping[str, Sequence[str]]) -> Structure:
    return Structure({}, {}, {c: ALONE for c in [*numeric, *domains]})


def learn_partitions(features: DataFrame, numeric: Sequence[str] = (), domains: Mapping[str, Sequence[str]] | None = None, strategy: str = "incremental", alpha: int = 10, start: Forest | None = None, weight: str | None = None, **options) -> Forest:
    """Several clusterings of the same rows.

    incremental: from independent attributes; a round may cover one of the `alpha` pairs of highest dependence with a
    new latent, join a free attribute to a latent, add an arc or a state. refine: from a given model (or none), all
    moves: states, removing, inserting and adding latents, relocating attributes. tree: refine's moves, arcs between
    latents included, until one tree explains what it can. phases: the same moves in turn, first those that expand (by gain for each added number), then those
    that adjust, then those that simplify, so a round has few candidates. Dependence is the mutual information of attribute
    pairs, taken from the data once (ranked_pairs). weight: the column of features that are counted() already.
    """
    domains = dict(domains or {})
    if not weight:
        features, weight = counted(features, numeric, domains)
    features = features.persist()
    try:
        return _learn_partitions(features, numeric, domains, strategy, alpha, start, weight, options)
    finally:
        features.unpersist()


def _learn_partitions(features, numeric, domains, strategy, alpha, start, weight, options) -> Forest:
    ranked = ranked_pairs(features, numeric, domains, weight)

    def incremental(m: Forest) -> list[Structure]:
        s = m.structure
        free = [p for p in ranked if ALONE in (s.of[p[0]], s.of[p[1]])][:alpha]
        roots = [(a, b) for a, b in itertools.combinations([z for z in s.cards if z not in s.up], 2)]
        return add_latents(s, free) + add_latents(s, roots) + change_cards(s) + add_arcs(s)

    def refine(m: Forest) -> list[Structure]:
        s = m.structure
        free = [p for p in ranked if s.of[p[0]] == s.of[p[1]] == ALONE][:alpha]
        return change_cards(s) + remove_latents(s) + insert_latents(s) + add_latents(s, free) + relocate(s)

    def tree(m: Forest) -> list[Structure]:
        return refine(m) + add_arcs(m.structure)

    def expand(m: Forest) -> list[Structure]:
        s = m.structure
        free = [p for p in ranked if ALONE in (s.of[p[0]], s.of[p[1]])][:alpha]
        return change_cards(s, less=False) + insert_latents(s) + add_latents(s, free) + add_arcs(s)

    def simplify(m: Forest) -> list[Structure]:
        fewer = [replace(m.structure, cards={**m.structure.cards, z: k - 1}) for z, k in m.structure.cards.items() if k > 2]
        return fewer + remove_latents(m.structure)

    phases = [Phase(expand, True), Phase(lambda m: relocate(m.structure)), Phase(simplify)]
    moves = {"incremental": incremental, "refine": refine, "tree": tree, "phases": phases}[strategy]
    return search(features, start.structure if start else _empty(numeric, domains), moves, numeric, domains, weight=weight, **options)


def pair_dependence(features: DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], weight: str | None = None) -> dict[tuple[str, str], float]:
    """Mutual information of attribute pairs in nats.

    Discrete pairs are counted; numeric ones are taken as normal, -ln(1 - r^2) / 2, and so are mixed ones with the share of
    variance that lies between states. Three aggregates, whatever the number of attributes. weight: the column of counted().
    """
    found: dict[tuple[str, str], float] = {}
    of_share = lambda share: -0.5 * math.log(max(1 - min(share or 0.0, 1.0), 1e-12))
    if len(numeric) > 1:
        pairs = list(itertools.combinations(numeric, 2))
        one = features.agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
        found |= {p: of_share(one[str(i)] ** 2 if one[str(i)] == one[str(i)] else 0.0) for i, p in enumerate(pairs)}
    if len(domains) > 1:
        found |= {(r["a"], r["b"]): r["mi"] or 0.0 for r in mutual_info_matrix(features, list(domains), weight=weight).collect()}
    if numeric and domains:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(d).alias("d"), F.col(c).cast("double").alias("x"), F.col(d).cast("string").alias("s")) for c in numeric for d in domains])
        groups = features.select(F.inline(cells)).filter("x is not null and s is not null").groupBy("c", "d", "s").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
        n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m"))
        inside, square = F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") * F.col("m") * F.col("m"))
        between = square - mean * mean / n
        shares = groups.groupBy("c", "d").agg((between / F.nullif(between + inside, F.lit(0.0))).alias("share")).collect()  # a row per pair
        found |= {(r["c"], r["d"]): of_share(r["share"]) for r in shares}
    return found


def ranked_pairs(features: DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], weight: str | None = None) -> list[tuple[str, str]]:
    """Attribute pairs by mutual information, highest first, ties by name."""
    found = pair_dependence(features, numeric, domains, weight)
    return sorted(itertools.combinations([*numeric, *domains], 2), key=lambda p: (-found.get(p, found.get(p[::-1], 0.0)), p))


def forest_edges(model: Forest) -> list[tuple[str, str]]:
    """(parent, child) of all arcs, for robinson_foulds() and for display."""
    s = model.structure
    return sorted([(p, c) for c, p in s.up.items()] + [(p, c) for c, p in s.of.items() if p != ALONE])
