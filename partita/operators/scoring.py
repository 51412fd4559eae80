"""Posteriors, labels and likelihoods of rows under a model, as column expressions over literal parameters.

A model with one discrete latent is small (states times attributes), so its parameters become literals of the plan:
no join, no Python, everything inside code generation.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.draws import normal, uniform


@dataclass
class MixtureModel:
    """One discrete latent; every attribute its child. gaussian: per attribute (mean, variance) of each state;
    discrete: per attribute the probabilities of its values in each state."""

    weights: Sequence[float]
    gaussian: Mapping[str, Sequence[tuple[float, float]]] = field(default_factory=dict)
    discrete: Mapping[str, Sequence[Mapping[str, float]]] = field(default_factory=dict)
    latent: str = "z"

    @property
    def states(self) -> int:
        return len(self.weights)

    def dimension(self, free: bool = True) -> int:
        """Numbers to estimate: free ones, or all probabilities of a multinomial counted."""
        less = 1 if free else 0
        k = self.states
        return (k - less) + 2 * k * len(self.gaussian) + sum(sum(len(s) - less for s in v) for v in self.discrete.values())


def gaussian_log(column: str, mean: float, variance: float) -> Column:
    """ln of the normal density of a cell; 0 where it is missing."""
    gap = F.col(column).cast("double") - float(mean)
    return F.coalesce(F.lit(-0.5 * math.log(2 * math.pi * variance)) - gap * gap / (2 * float(variance)), F.lit(0.0))


def discrete_log(column: str, table: Mapping[str, float]) -> Column:
    """ln of the probability of a cell's value; 0 where it is missing."""
    value, expr = F.col(column).cast("string"), None
    for state, p in table.items():
        hit = F.lit(math.log(p) if p > 0 else -1e300)
        expr = F.when(value == state, hit) if expr is None else expr.when(value == state, hit)
    return F.when(value.isNull(), 0.0).otherwise(F.coalesce(expr, F.lit(-1e300)))


def log_joint(model: MixtureModel) -> Column:
    """Array over states of ln p(state, observed cells); missing cells are left out."""
    out = []
    for s, w in enumerate(model.weights):
        terms = [F.lit(math.log(w) if w > 0 else -1e300)]
        terms += [gaussian_log(c, *params[s]) for c, params in model.gaussian.items()]
        terms += [discrete_log(c, params[s]) for c, params in model.discrete.items()]
        out.append(sum(terms[1:], terms[0]))
    return F.array(*out)


def _total(logs: Column) -> Column:
    top = F.array_max(logs)
    return top + F.ln(F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def posterior(df: DataFrame, model: MixtureModel) -> DataFrame:
    """df with <latent>_probs: the probability of every state given the row's observed cells."""
    with_logs = df.withColumn("_l", log_joint(model)).withColumn("_t", _total(F.col("_l")))
    return with_logs.withColumn(f"{model.latent}_probs", F.transform("_l", lambda x: F.exp(x - F.col("_t")))).drop("_l", "_t")


def hard_assign(df: DataFrame, model: MixtureModel) -> DataFrame:
    """df with the most probable state in column <latent>; the first of equals."""
    logs = log_joint(model)
    return df.withColumn("_l", logs).withColumn(model.latent, (F.array_position("_l", F.array_max("_l")) - 1).cast("int")).drop("_l")


def row_log_likelihood(df: DataFrame, model: MixtureModel) -> DataFrame:
    """df with log_likelihood: ln p of the row's observed cells, exact."""
    return df.withColumn("_l", log_joint(model)).withColumn("log_likelihood", _total(F.col("_l"))).drop("_l")


def score_model(df: DataFrame, model: MixtureModel, dim: str = "free") -> DataFrame:
    """One row: n, log_likelihood, dim, aic = ll - d, bic = ll - d ln(n) / 2 (higher is better)."""
    d = model.dimension(dim == "free")
    one = row_log_likelihood(df, model).agg(F.count("*").alias("n"), F.sum("log_likelihood").alias("log_likelihood"))
    ll = F.col("log_likelihood")
    return one.withColumns({"dim": F.lit(d), "aic": ll - d, "bic": ll - d * F.ln("n") / 2})


def _fills(gaussian: Mapping, discrete: Mapping, probs: Callable[[str], Column]) -> dict[str, Column]:
    """Each attribute, its nulls replaced by the mean, or the most probable value, under its parent's state probabilities."""
    mixed = lambda r, values: F.aggregate(F.zip_with(r, F.array(*[F.lit(float(v)) for v in values]), lambda p, m: p * m), F.lit(0.0), lambda s, x: s + x)
    fills = {c: F.coalesce(F.col(c).cast("double"), mixed(probs(c), [m for m, _ in params])) for c, params in gaussian.items()}
    for c, params in discrete.items():
        values = list(params[0])
        scores = F.array(*[mixed(probs(c), [s.get(v, 0) for s in params]) for v in values])
        fills[c] = F.coalesce(F.col(c), F.element_at(F.array(*[F.lit(v) for v in values]), F.array_position(scores, F.array_max(scores)).cast("int")))
    return fills


def impute_with_model(df: DataFrame, model: MixtureModel) -> DataFrame:
    """Nulls become the posterior mean, or the most probable value, given the row's observed cells."""
    name = f"{model.latent}_probs"
    return posterior(df, model).withColumns(_fills(model.gaussian, model.discrete, lambda c: F.col(name))).drop(name)


def order_states(df: DataFrame, label: str) -> DataFrame:
    """df whose labels are renumbered by their frequency, rarest first, ties by label; null labels stay null. The map is one row per label."""
    rank = F.row_number().over(Window.orderBy("_n", label)) - 1
    names = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n")).select(label, rank.alias("_new"))
    return df.join(F.broadcast(names), label, "left").withColumn(label, F.col("_new")).select(*df.columns)


def most_probable_state(df: DataFrame, tables: Mapping[str, Mapping[tuple, Mapping]], parents: Mapping[str, Sequence[str]], variables: Sequence[str], limit: int = 4096) -> DataFrame:
    """df with map_<v>: the joint most probable values of discrete `variables` given the row's other columns.

    tables: per node, parent values -> value -> probability. All joint assignments are enumerated as literals, so
    their number is limited. Null columns that are not asked for are not allowed. First of equals in value order.
    """
    domains = {v: sorted({s for t in tables[v].values() for s in t}) for v in variables}
    count = math.prod(len(d) for d in domains.values())
    if count > limit:
        raise ValueError(f"{count} joint states; the limit is {limit}")
    touched = [n for n in tables if n in variables or any(p in variables for p in parents.get(n, ()))]
    scored = []
    for combo in itertools.product(*domains.values()):
        given = dict(zip(domains, combo, strict=True))
        total = F.lit(0.0)
        for node in touched:
            expr = None
            for config, dist in tables[node].items():
                for value, p in dist.items():
                    test = F.lit(True)
                    for name, want in [*zip(parents.get(node, ()), config, strict=True), (node, value)]:
                        test = test & ((F.lit(given[name]) == want) if name in given else (F.col(name) == want))
                    hit = F.lit(math.log(p) if p > 0 else -1e300)
                    expr = F.when(test, hit) if expr is None else expr.when(test, hit)
            total = total + F.coalesce(expr, F.lit(-1e300))
        scored.append(F.struct(total.alias("s"), *[F.lit(x).alias(f"map_{v}") for v, x in given.items()]))
    tops = df.withColumn("_a", F.array(*scored)).withColumn("_m", F.array_max(F.transform("_a", lambda x: x["s"])))
    best = F.element_at(F.filter("_a", lambda x: x["s"] == F.col("_m")), 1)
    return tops.withColumn("_b", best).select(*df.columns, *[F.col("_b")[f"map_{v}"].alias(f"map_{v}") for v in variables])


def forward_sample(spark, n: int, model: MixtureModel, seed: int = 0, keep_latent: bool = True, hide: float = 0.0) -> DataFrame:
    """n rows drawn from the model: row_id, the latent, then its children; cells are lost with probability `hide`."""
    u = lambda name: uniform(F.col("row_id"), F.lit(name), F.lit(seed))

    def pick(name: str, options: Sequence[tuple], draw: Column) -> Column:
        reached, expr = 0.0, None
        for value, p in options[:-1]:
            reached += p
            expr = F.when(draw < reached, F.lit(value)) if expr is None else expr.when(draw < reached, F.lit(value))
        return F.lit(options[-1][0]) if expr is None else expr.otherwise(F.lit(options[-1][0]))

    df = spark.range(n).withColumnRenamed("id", "row_id")
    df = df.withColumn(model.latent, pick("z", list(enumerate(model.weights)), u("z")))
    cols = {}
    for c, params in model.gaussian.items():
        z = F.sqrt(-2 * F.ln(u(c))) * F.cos(2 * math.pi * u(c + "'"))
        m = F.element_at(F.array(*[F.lit(float(a)) for a, _ in params]), F.col(model.latent) + 1)
        s = F.element_at(F.array(*[F.lit(math.sqrt(v)) for _, v in params]), F.col(model.latent) + 1)
        cols[c] = m + s * z
    for c, params in model.discrete.items():
        per = [pick(c, list(d.items()), u(c)) for d in params]
        expr = F.when(F.col(model.latent) == 0, per[0])
        for s, e in enumerate(per[1:], 1):
            expr = expr.when(F.col(model.latent) == s, e)
        cols[c] = expr
    if hide:
        cols = {c: F.when(u(c + "?") >= hide, e) for c, e in cols.items()}
    df = df.withColumns(cols)
    return df if keep_latent else df.drop(model.latent)


def likelihood_weighting(df: DataFrame, model: MixtureModel, key: str, samples: int = 1000, seed: int = 0) -> DataFrame:
    """(key, log_evidence, probs): estimates from `samples` draws of the latent per row, weighted by the row's density.

    Draws follow from the key (null is a key like any other), their number and the seed. Weights depend on the state alone, so a
    row needs how often each state was drawn.
    """
    edges = [0.0, *itertools.accumulate(model.weights[:-1]), 2.0]
    draws = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: uniform(F.col(key), i, F.lit(seed)))
    given = F.zip_with(log_joint(model), F.array(*[F.lit(math.log(w) if w > 0 else 0.0) for w in model.weights]), lambda a, w: a - w)
    rows = df.select(key, given.alias("_d"), draws.alias("_u"))
    drawn = lambda low, high: F.size(F.filter("_u", lambda u: (u >= low) & (u < high)))
    counts = F.array(*[drawn(low, high) for low, high in itertools.pairwise(edges)])
    top = F.array_max("_d")
    rows = rows.select(key, top.alias("_top"), F.zip_with("_d", counts, lambda d, n: n * F.exp(d - top)).alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return rows.select(key, (F.col("_top") + F.ln(total / samples)).alias("log_evidence"), F.transform("_e", lambda x: x / total).alias("probs"))


@dataclass
class ForestModel:
    """Given parameters of several latents: each has at most one latent parent, each attribute one latent (or none: '').

    cards: states of each latent; up: its latent parent; latents: rows of state probabilities by parent state (one row for
    a root); of: the latent of each attribute; gaussian: (mean, variance), discrete: value probabilities, by that latent's state.
    """

    cards: Mapping[str, int]
    up: Mapping[str, str]
    of: Mapping[str, str]
    latents: Mapping[str, Sequence[Sequence[float]]]
    gaussian: Mapping[str, Sequence[tuple[float, float]]] = field(default_factory=dict)
    discrete: Mapping[str, Sequence[Mapping[str, float]]] = field(default_factory=dict)

    def below(self, latent: str) -> list[str]:
        return [c for c, p in self.up.items() if p == latent]

    def leaves_first(self) -> list[str]:
        out: list[str] = []

        def visit(z: str) -> None:
            for c in self.below(z):
                visit(c)
            out.append(z)

        for z in self.cards:
            if z not in self.up:
                visit(z)
        return out

    def dimension(self) -> int:
        """Free numbers to estimate."""
        latents = sum(len(rows) * (len(rows[0]) - 1) for rows in self.latents.values())
        return latents + sum(2 * len(v) for v in self.gaussian.values()) + sum(len(t) - 1 for v in self.discrete.values() for t in v)


def _attribute_log(model: ForestModel, latent: str, state: int) -> list[Column]:
    out = [gaussian_log(c, *v[state]) for c, v in model.gaussian.items() if model.of[c] == latent]
    return out + [discrete_log(c, v[state]) for c, v in model.discrete.items() if model.of[c] == latent]


def _with_messages(df: DataFrame, model: ForestModel) -> DataFrame:
    """df with, per latent, _l_<z>: ln p(cells below | state), and _m_<z>: ln p(cells below | parent's state), leaves first."""
    for z in model.leaves_first():
        local = [sum([*_attribute_log(model, z, s), *[F.col(f"_m_{c}")[s] for c in model.below(z)]], F.lit(0.0)) for s in range(model.cards[z])]
        df = df.withColumn(f"_l_{z}", F.array(*local))
        rows = [F.array(*[F.col(f"_l_{z}")[s] + (math.log(p) if p > 0 else -1e300) for s, p in enumerate(row)]) for row in model.latents[z]]
        df = df.withColumn(f"_m_{z}", F.array(*[_total(r) for r in rows]))
    return df


def _work_columns(model: ForestModel) -> list[str]:
    return [f"_{kind}_{z}" for z in model.cards for kind in "lm"]


def forest_log_likelihood(df: DataFrame, model: ForestModel) -> DataFrame:
    """df with log_likelihood: ln p of the row's observed cells, exact, by sums from the leaves of each tree to its root."""
    roots = [F.col(f"_m_{z}")[0] for z in model.cards if z not in model.up]
    return _with_messages(df, model).withColumn("log_likelihood", sum([*_attribute_log(model, "", 0), *roots], F.lit(0.0))).drop(*_work_columns(model))


def forest_posterior(df: DataFrame, model: ForestModel) -> DataFrame:
    """df with <z>_probs for every latent: the exact probabilities of its states given the row's observed cells."""
    out = _with_messages(df, model)
    for z in reversed(model.leaves_first()):
        above = model.up.get(z)
        probs = []
        for s in range(model.cards[z]):
            ways = []
            for j, row in enumerate(model.latents[z]):
                share = F.exp(F.col(f"_l_{z}")[s] + (math.log(row[s]) if row[s] > 0 else -1e300) - F.col(f"_m_{z}")[j])
                ways.append(share if above is None else F.col(f"{above}_probs")[j] * share)
            probs.append(sum(ways[1:], ways[0]))
        out = out.withColumn(f"{z}_probs", F.array(*probs))
    return out.drop(*_work_columns(model))


def forest_score(df: DataFrame, model: ForestModel) -> DataFrame:
    """One row: n, log_likelihood, dim, aic and bic (higher is better)."""
    d, ll = model.dimension(), F.col("log_likelihood")
    one = forest_log_likelihood(df, model).agg(F.count("*").alias("n"), F.sum("log_likelihood").alias("log_likelihood"))
    return one.withColumns({"dim": F.lit(d), "aic": ll - d, "bic": ll - d * F.ln("n") / 2})


def impute_with_forest(df: DataFrame, model: ForestModel) -> DataFrame:
    """Nulls become the mean, or the most probable value (the first of equals), of the attribute given all observed cells of the row.

    Given its latent an attribute does not depend on the others, so the exact posterior of that latent, to which every
    tree sends what is observed, is all that a missing cell needs. Attributes without a latent get their overall mean or commonest value.
    """
    names = [f"{z}_probs" for z in model.cards]
    alone = F.array(F.lit(1.0))
    probs = lambda c: F.col(f"{model.of[c]}_probs") if model.of[c] else alone
    return forest_posterior(df, model).withColumns(_fills(model.gaussian, model.discrete, probs)).drop(*names)


def _drawn(draw: Column, probs: Sequence[float]) -> Column:
    """The state in whose share of (0, 1) a draw falls."""
    if len(probs) == 1:
        return F.lit(0)
    expr = None
    for s, reached in enumerate(itertools.accumulate(probs[:-1])):
        expr = F.when(draw < reached, F.lit(s)) if expr is None else expr.when(draw < reached, F.lit(s))
    return expr.otherwise(F.lit(len(probs) - 1))


def forest_sample(rows: DataFrame, key: str, model: ForestModel, seed: int = 0, hide: float = 0.0, keep_latents: bool = True) -> DataFrame:
    """(key, the latents, the attributes): one draw from the model for each row, parents before children.

    A draw follows from the key, the name and the seed, so reruns agree (null is a key like others, equal keys get equal draws). Cells are lost with probability `hide`.
    """
    u = lambda name: uniform(F.col(key), F.lit(name), F.lit(seed))
    df = rows.select(key)
    of = lambda z, options: F.element_at(F.array(*options), F.col(z) + 1) if z else options[0]
    for z in reversed(model.leaves_first()):
        df = df.withColumn(f"_u_{z}", u(z)).withColumn(z, of(model.up.get(z, ""), [_drawn(F.col(f"_u_{z}"), row) for row in model.latents[z]])).drop(f"_u_{z}")
    cells = {}
    for c, params in model.gaussian.items():
        z = model.of[c]
        cells[c] = of(z, [F.lit(float(m)) for m, _ in params]) + of(z, [F.lit(math.sqrt(v)) for _, v in params]) * normal(F.col(key), F.lit(c), F.lit(seed))
    for c, params in model.discrete.items():
        pick = lambda table, c=c: F.element_at(F.array(*[F.lit(v) for v in table]), _drawn(u(c), list(table.values())) + 1)
        cells[c] = of(model.of[c], [pick(table) for table in params])
    if hide:
        cells = {c: F.when(u(c + "?") >= hide, e) for c, e in cells.items()}
    df = df.withColumns(cells)
    return df if keep_latents else df.drop(*model.cards)


def forest_likelihood_weighting(df: DataFrame, model: ForestModel, key: str, samples: int = 1000, seed: int = 0) -> DataFrame:
    """(key, log_evidence, <z>_probs of every latent): estimates from `samples` draws of all latents per row, each weighted by the density of the row's cells.

    Latents are drawn from the top of each tree down, the cells are clamped. Draws follow from the key (null is a key like any other), the
    draw's number, the latent's name and the seed. Where every draw has weight zero the results are null.
    """
    numbers = F.sequence(F.lit(0), F.lit(samples - 1))
    rows = df.withColumns({f"_d_{z}": F.array(*[sum(_attribute_log(model, z, s), F.lit(0.0)) for s in range(k)]) for z, k in model.cards.items()})
    rows = rows.withColumns({"_alone": sum(_attribute_log(model, "", 0), F.lit(0.0))} | {f"_u_{z}": F.transform(numbers, lambda i: uniform(F.col(key), i, F.lit(z), F.lit(seed))) for z in model.cards})
    order = list(reversed(model.leaves_first()))
    for z in order:
        above, tables = model.up.get(z), model.latents[z]
        if above is None:
            states = F.transform(f"_u_{z}", lambda u: _drawn(u, tables[0]))
        else:
            states = F.zip_with(f"_u_{z}", f"_s_{above}", lambda u, p: F.element_at(F.array(*[_drawn(u, row) for row in tables]), p + 1))
        rows = rows.withColumn(f"_s_{z}", states)
    logs = F.transform(numbers, lambda i: F.lit(0.0))
    for z in order:
        logs = F.zip_with(logs, f"_s_{z}", lambda x, s: x + F.element_at(F.col(f"_d_{z}"), s + 1))
    rows = rows.withColumn("_w", logs).withColumn("_top", F.array_max("_w")).withColumn("_e", F.transform("_w", lambda x: F.exp(x - F.col("_top"))))
    total = F.nullif(F.aggregate("_e", F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    share = lambda z, s: F.aggregate(F.zip_with(f"_s_{z}", "_e", lambda t, x: F.when(t == s, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.col("_total")
    rows = rows.withColumn("_total", F.when(F.col("_top") > -1e299, total))
    probs = [F.array(*[share(z, s) for s in range(k)]).alias(f"{z}_probs") for z, k in model.cards.items()]
    return rows.select(key, (F.col("_top") + F.ln(F.col("_total") / samples) + F.col("_alone")).alias("log_evidence"), *probs)
