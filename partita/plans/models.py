"""Queries over learning, scoring, streaming and search operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators import dependence, describe, forest, parameters, scoring, search
from partita.functions.draws import normal_sql, uniform_sql
from partita.operators.scoring import ForestModel, MixtureModel
from partita.plans.preparation import HOLED, _round, holed
from partita.plans.registry import Tables, query

TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

#: A given model of orders: two states, price normal and status multinomial in each.
GIVEN = MixtureModel(
    [0.4, 0.6],
    {"o_totalprice": [(120_000.0, 3.6e9), (330_000.0, 8.1e9)]},
    {"o_orderstatus": [{"F": 0.5, "O": 0.3, "P": 0.2}, {"F": 0.25, "O": 0.35, "P": 0.4}]},
)


def _given_sql(rows: str = HOLED) -> str:
    """ln p(state, cells) of GIVEN in SQL, and their log-sum-exp."""
    logs = []
    for s, w in enumerate(GIVEN.weights):
        m, v = GIVEN.gaussian["o_totalprice"][s]
        cases = " ".join(f"WHEN '{k}' THEN {math.log(p)!r}" for k, p in GIVEN.discrete["o_orderstatus"][s].items())
        logs.append(f"{math.log(w)!r} + coalesce({-0.5 * math.log(2 * math.pi * v)!r} - (o_totalprice - {m}) ** 2 / {2 * v!r}, 0) + CASE o_orderstatus {cases} ELSE 0 END AS l{s}")
    return f"j AS (SELECT *, {', '.join(logs)} FROM {rows}), t AS (SELECT *, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS total FROM j)"


#: A given model of orders with two latents, b below a: price hangs on a, status on b, priority on none.
GIVEN_FOREST = ForestModel(
    {"a": 2, "b": 3},
    {"b": "a"},
    {"o_totalprice": "a", "o_orderstatus": "b", "o_orderpriority": ""},
    {"a": [[0.35, 0.65]], "b": [[0.5, 0.3, 0.2], [0.1, 0.2, 0.7]]},
    {"o_totalprice": [(120_000.0, 3.6e9), (330_000.0, 8.1e9)]},
    {"o_orderstatus": [{"F": 0.6, "O": 0.3, "P": 0.1}, {"F": 0.25, "O": 0.35, "P": 0.4}, {"F": 0.45, "O": 0.5, "P": 0.05}], "o_orderpriority": [dict(zip(PRIORITIES, (0.3, 0.25, 0.2, 0.15, 0.1), strict=True))]},
)


def _forest_sql(rows: str = HOLED) -> str:
    """ln p(states of both latents, cells) of GIVEN_FOREST in SQL, their log-sum-exp, and the row's total."""
    g, m = GIVEN_FOREST, GIVEN_FOREST.discrete
    case = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {math.log(p)!r}" for k, p in table.items()) + " ELSE 0 END"
    logs = []
    for i, pa in enumerate(g.latents["a"][0]):
        mean, v = g.gaussian["o_totalprice"][i]
        for j, pb in enumerate(g.latents["b"][i]):
            logs.append(f"{math.log(pa) + math.log(pb)!r} + coalesce({-0.5 * math.log(2 * math.pi * v)!r} - (o_totalprice - {mean}) ** 2 / {2 * v!r}, 0) + {case('o_orderstatus', m['o_orderstatus'][j])} AS l{i}{j}")
    names = [f"l{i}{j}" for i in range(2) for j in range(3)]
    top = f"greatest({', '.join(names)})"
    return f"""j AS (SELECT *, {', '.join(logs)}, {case('o_orderpriority', m['o_orderpriority'][0])} AS alone FROM {rows}),
      s AS (SELECT *, {top} + ln({' + '.join(f'exp({n} - {top})' for n in names)}) AS joint FROM j), t AS (SELECT *, joint + alone AS total FROM s)"""


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_x, round(sum(l_quantity * l_quantity), 2) AS sum_xx FROM lineitem GROUP BY ALL")
def g1_sufficient_stats(t: Tables) -> DataFrame:
    return _round(parameters.sufficient_stats(t.lineitem, "l_quantity", ["l_returnflag", "l_linestatus"]), 2, "sum_x", "sum_xx")


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_discount), 4) AS s_l_discount, round(sum(l_tax), 4) AS s_l_tax, round(sum(l_discount * l_discount), 4) AS p_l_discount_l_discount,
     round(sum(l_discount * l_tax), 4) AS p_l_discount_l_tax, round(sum(l_tax * l_tax), 4) AS p_l_tax_l_tax FROM lineitem GROUP BY 1""")
def g1_cross_stats(t: Tables) -> DataFrame:
    out = parameters.cross_stats(t.lineitem, ["l_discount", "l_tax"], ["l_returnflag"])
    return _round(out, 4, *[c for c in out.columns if c[:2] in ("s_", "p_")])


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity) / (count(*) + 1.0 / 3), 6) AS mean,
     round((sum(l_quantity * l_quantity) + 0.1 / 3) / (count(*) + 1.0 / 3) - (sum(l_quantity) / (count(*) + 1.0 / 3)) ** 2, 5) AS variance FROM lineitem GROUP BY 1""")
def g2_fit_gaussian(t: Tables) -> DataFrame:
    return _round(_round(parameters.fit_gaussian(t.lineitem, "l_quantity", ["l_returnflag"], laplace=True, configurations=3), 6, "mean"), 5, "variance")


@query("""SELECT o_orderstatus, o_orderpriority AS value, count(*) AS n, round((count(*) + 1.0 / 15) / (sum(count(*)) OVER (PARTITION BY o_orderstatus) + 1.0 / 3), 8) AS p FROM orders GROUP BY 1, 2""")
def g2_fit_multinomial(t: Tables) -> DataFrame:
    return _round(parameters.fit_multinomial(t.orders, "o_orderpriority", ["o_orderstatus"], PRIORITIES, laplace=True), 8, "p")


@query(f"""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(var_pop(o_totalprice) / 1e6, 3) AS variance_millions FROM {HOLED}
     WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1""")
def g3_fit_missing(t: Tables) -> DataFrame:
    out = parameters.fit_gaussian(holed(t), "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", "n", F.round("mean", 3).alias("mean"), F.round(F.col("variance") / 1e6, 3).alias("variance_millions"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS attribute, round(avg({c}), 6) AS m0, 1.0 AS k0, 0.5 AS a0, round(var_pop({c}) / 2, 6) AS b0 FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def g4_priors(t: Tables) -> DataFrame:
    return _round(parameters.priors_from_data(t.lineitem, ["l_quantity", "l_discount", "l_tax"]), 6, "m0", "b0")


@query("SELECT v AS value, round((count(o_orderkey) + 1.0) / ((SELECT count(*) FROM orders) + 6), 8) AS alpha FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')) d(v) LEFT JOIN orders ON o_orderpriority = v GROUP BY 1")
def g4_dirichlet_priors(t: Tables) -> DataFrame:
    return _round(parameters.dirichlet_priors(t.orders, "o_orderpriority", [*PRIORITIES, "6-NEVER"]), 8, "alpha")


@query("""WITH p AS (SELECT avg(l_quantity) AS m0, var_pop(l_quantity) / 2 AS b0 FROM lineitem), s AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx FROM lineitem GROUP BY 1),
     q AS (SELECT *, 1.0 + n AS k, (m0 + sx) / (1.0 + n) AS m, 0.5 + n / 2.0 AS a FROM s, p), r AS (SELECT *, b0 + 0.5 * (sxx + m0 * m0 - k * m * m) AS b FROM q)
     SELECT l_returnflag, n, k AS kappa, round(m, 6) AS mean, a, round(b, 2) AS b, round(lgamma(a) - lgamma(0.5) + 0.5 * ln(b0) - a * ln(b) - 0.5 * ln(k) - n / 2.0 * ln(2 * pi()), 2) AS evidence FROM r""")
def g5_fit_conjugate(t: Tables) -> DataFrame:
    out = t.spark.createDataFrame(parameters.fit_conjugate(t.lineitem, "l_quantity", ["l_returnflag"]))
    return _round(_round(out.select("l_returnflag", "n", "kappa", "mean", "a", "b", "evidence"), 6, "mean"), 2, "b", "evidence")


def _given_class() -> parameters.LatentClass:
    """A given posterior of two event classes."""
    two = lambda *v: parameters.np.array(v, dtype=float)
    return parameters.LatentClass(two(40, 60), {"value": (two(20, 70), two(30, 50), two(15, 25), two(3000, 9000))}, {"event_type": parameters.np.array([[5, 1, 2, 3, 9], [2, 4, 6, 1, 3]], dtype=float)}, {"event_type": TYPES})


def _em_step_sql() -> str:
    """Expected counts and sums of one pass over the events under _given_class(), whose expectations are constants here."""
    model, logs = _given_class(), []
    for s in range(2):
        m, k, a, b = (float(v[s]) for v in model.gaussian["value"])
        const = parameters.digamma(model.alpha)[s] - parameters.digamma(model.alpha.sum()) + 0.5 * (parameters.digamma(parameters.np.array(a)) - math.log(b)) - 0.5 * math.log(2 * math.pi) - 0.5 / k
        e = parameters.digamma(model.discrete["event_type"][s]) - parameters.digamma(model.discrete["event_type"][s].sum())
        cases = " ".join(f"WHEN '{v}' THEN {float(x)!r}" for v, x in zip(TYPES, e, strict=True))
        logs.append(f"{float(const)!r} - {0.5 * a / b!r} * (value - {m!r}) ** 2 + CASE event_type {cases} ELSE 0 END AS l{s}")
    return f"""WITH l AS (SELECT value, {', '.join(logs)} FROM events), r AS (SELECT value, 1 / (1 + exp(l1 - l0)) AS r0, 1 / (1 + exp(l0 - l1)) AS r1 FROM l)
      SELECT 0 AS state, round(sum(r0), 4) AS n, round(sum(r0 * value), 2) AS sum_x, round(sum(r0 * value * value), 0) AS sum_xx FROM r UNION ALL SELECT 1, round(sum(r1), 4), round(sum(r1 * value), 2), round(sum(r1 * value * value), 0) FROM r"""


@query(_em_step_sql())
def g6_expectation_step(t: Tables) -> DataFrame:
    """One pass over the events under a given posterior."""
    stats = parameters.e_step(t.events, [_given_class()], ["value"], {"event_type": TYPES})[0]
    rows = [(s, *(float(v) for v in stats["value"][:, s])) for s in range(2)]
    return _round(_round(_round(t.spark.createDataFrame(rows, "state int, n double, sum_x double, sum_xx double"), 4, "n"), 2, "sum_x"), 0, "sum_xx")


def event_clusters(t: Tables) -> DataFrame:
    """Clusters of events by value and type (best of four starts), labelled, with the mean of each."""
    best = parameters.fit_latent_class(t.events, 3, ["value"], {"event_type": TYPES}, candidates=4, steps=30)[3]
    return describe.group_mean_std(scoring.hard_assign(t.events, best.expected("cluster")), "cluster", "value")


@query()
def g6_latent_class(t: Tables) -> DataFrame:
    return event_clusters(t)


def _mixture_rows(t: Tables, fit: dict, numeric: list[str]) -> DataFrame:
    """A row per state: weight, means and deviations, with the likelihood and BIC of the model."""
    rows = []
    for k, w in enumerate(fit["weights"]):
        cells = [float(v) for j in range(len(numeric)) for v in (fit["means"][k][j], fit["covariances"][k][j][j] ** 0.5)]
        rows.append((k, float(w), *cells, fit["log_likelihood"], float(fit["bic"]), fit["n"]))
    names = [f"{f}_{c} double" for c in numeric for f in ("mean", "deviation")]
    return t.spark.createDataFrame(rows, ", ".join(["state int", "weight double", *names, "log_likelihood double", "bic double", "n long"]))


@query()
def g9_mixture_diagonal(t: Tables) -> DataFrame:
    numeric = ["l_quantity", "l_discount"]
    return _mixture_rows(t, parameters.fit_mixture(t.lineitem, 3, numeric, steps=12), numeric)


@query()
def g10_mixture_full(t: Tables) -> DataFrame:
    numeric = ["l_quantity", "l_extendedprice"]
    return _mixture_rows(t, parameters.fit_mixture(t.lineitem, 2, numeric, full=True, steps=12), numeric)


@query("""WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mq, var_pop(l_quantity) AS vq, avg(l_discount) AS md, var_pop(l_discount) AS vd FROM lineitem)
     SELECT 0 AS state, 1.0 AS weight, round(mq, 6) AS mean_l_quantity, round(sqrt(vq), 6) AS deviation_l_quantity, round(md, 8) AS mean_l_discount, round(sqrt(vd), 8) AS deviation_l_discount,
       round(-n / 2.0 * (2 * ln(2 * pi()) + ln(vq) + ln(vd) + 2), 3) AS log_likelihood, n FROM m""")
def g9_one_component(t: Tables) -> DataFrame:
    """A mixture of one state is the table's moments, reached in one step."""
    numeric = ["l_quantity", "l_discount"]
    out = _mixture_rows(t, parameters.fit_mixture(t.lineitem, 1, numeric, candidates=1, steps=3), numeric)
    return out.select("state", "weight", *[F.round(c, d).alias(c) for c, d in (("mean_l_quantity", 6), ("deviation_l_quantity", 6), ("mean_l_discount", 8), ("deviation_l_discount", 8), ("log_likelihood", 3))], "n")


@query()
def g11_select_mixture(t: Tables) -> DataFrame:
    numeric = ["l_quantity", "l_discount"]
    return _mixture_rows(t, parameters.select_mixture(t.lineitem, numeric, most=3, candidates=2, steps=6), numeric)


@query()
def g11_select_cardinality(t: Tables) -> DataFrame:
    best = parameters.select_cardinality(t.events, ["value"], {"event_type": TYPES}, most=4, candidates=2, steps=20)
    return t.events.agg(F.count("*").alias("n")).withColumns({"states": F.lit(best.states), "elbo": F.lit(float(best.elbo))})


@query("SELECT o_orderpriority, round(sum(o_totalprice) / 1e6 - ln(6) - ln(2), 6) AS elbo_penalised FROM orders GROUP BY 1")
def g12_penalised(t: Tables) -> DataFrame:
    runs = t.orders.groupBy("o_orderpriority").agg((F.sum("o_totalprice") / 1e6).alias("elbo"), F.array(F.lit(3), F.lit(2)).alias("k"))
    return parameters.score_elbo_penalised(runs, "elbo", "k").select("o_orderpriority", F.round("elbo_penalised", 6).alias("elbo_penalised"))


@query(f"WITH {_given_sql()} SELECT count(*) AS n, round(sum(total), 4) AS log_likelihood, 9 AS dim, round(sum(total) - 9, 4) AS aic, round(sum(total) - 9 * ln(count(*)) / 2, 4) AS bic FROM t")
def g13_score_model(t: Tables) -> DataFrame:
    return _round(scoring.score_model(holed(t), GIVEN), 4, "log_likelihood", "aic", "bic")


_NB = """nb AS (SELECT l_returnflag AS c, count(*) / (SELECT count(*) FROM lineitem) AS prior, avg(l_quantity) AS mq, var_pop(l_quantity) AS vq, avg(l_discount) AS md, var_pop(l_discount) AS vd FROM lineitem GROUP BY 1)"""


@query(f"WITH {_NB} SELECT c AS l_returnflag, round(prior, 8) AS prior, round(mq, 6) AS mean_q, round(vq, 5) AS variance_q, round(md, 8) AS mean_d, round(vd, 8) AS variance_d FROM nb")
def g14_naive_bayes(t: Tables) -> DataFrame:
    out = parameters.fit_naive_bayes(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"])
    r = lambda c, d, n: F.round(c, d).alias(n)
    return out.select("l_returnflag", r("prior", 8, "prior"), r("mean_l_quantity", 6, "mean_q"), r("variance_l_quantity", 5, "variance_q"), r("mean_l_discount", 8, "mean_d"), r("variance_l_discount", 8, "variance_d"))


@query("SELECT l_returnflag, count(*) AS n, CASE l_returnflag WHEN 'A' THEN 25.0 ELSE round(avg(l_quantity), 6) END AS mean FROM lineitem GROUP BY 1")
def g15_fixed_parameters(t: Tables) -> DataFrame:
    fixed = t.spark.createDataFrame([("A", 25.0)], "l_returnflag string, mean double")
    fitted = parameters.fit_gaussian(t.lineitem, "l_quantity", ["l_returnflag"]).select("l_returnflag", "n", "mean")
    return _round(parameters.with_fixed(fitted, fixed, ["l_returnflag"], "mean"), 6, "mean")


@query(f"WITH {_given_sql()} SELECT o_orderkey, round(exp(l0 - total), 6) AS p0, round(exp(l1 - total), 6) AS p1 FROM t")
def i1_posterior(t: Tables) -> DataFrame:
    return scoring.posterior(holed(t), GIVEN).select("o_orderkey", *[F.round(F.col("z_probs")[i], 6).alias(f"p{i}") for i in (0, 1)])


@query(f"WITH {_given_sql()} SELECT o_orderkey, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS z FROM t")
def i2_hard_assign(t: Tables) -> DataFrame:
    return scoring.hard_assign(holed(t), GIVEN).select("o_orderkey", "z")


@query(f"WITH {_given_sql()} SELECT o_orderkey, round(total, 6) AS log_likelihood FROM t")
def i3_row_log_likelihood(t: Tables) -> DataFrame:
    return _round(scoring.row_log_likelihood(holed(t), GIVEN).select("o_orderkey", "log_likelihood"), 6, "log_likelihood")


@query(f"""WITH {_given_sql()}, n AS (SELECT o_orderkey, l0 - ln(0.4) AS d0, l1 - ln(0.6) AS d1,
       len(list_filter(range(50), lambda i: {uniform_sql("o_orderkey", "i", "0")} < 0.4)) AS n0 FROM t), e AS (SELECT *, greatest(d0, d1) AS top, n0 * exp(d0 - greatest(d0, d1)) AS e0, (50 - n0) * exp(d1 - greatest(d0, d1)) AS e1 FROM n)
     SELECT o_orderkey, round(top + ln((e0 + e1) / 50), 6) AS log_evidence, round(e0 / (e0 + e1), 6) AS p0, round(e1 / (e0 + e1), 6) AS p1 FROM e""")
def i4_likelihood_weighting(t: Tables) -> DataFrame:
    out = scoring.likelihood_weighting(holed(t), GIVEN, "o_orderkey", 50)
    return out.select("o_orderkey", F.round("log_evidence", 6).alias("log_evidence"), *[F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in (0, 1)])


@query(f"""WITH {_forest_sql()} SELECT o_orderkey, round(exp(l00 - joint) + exp(l01 - joint) + exp(l02 - joint), 6) AS a0, {', '.join(f'round(exp(l0{j} - joint) + exp(l1{j} - joint), 6) AS b{j}' for j in range(3))} FROM t""")
def i1_forest_posterior(t: Tables) -> DataFrame:
    out = scoring.forest_posterior(holed(t), GIVEN_FOREST)
    return out.select("o_orderkey", F.round(F.col("a_probs")[0], 6).alias("a0"), *[F.round(F.col("b_probs")[j], 6).alias(f"b{j}") for j in range(3)])


@query(f"WITH {_forest_sql()} SELECT count(*) AS n, round(sum(total), 4) AS log_likelihood, 19 AS dim, round(sum(total) - 19, 4) AS aic, round(sum(total) - 19 * ln(count(*)) / 2, 4) AS bic FROM t")
def g13_forest_score(t: Tables) -> DataFrame:
    return _round(scoring.forest_score(holed(t), GIVEN_FOREST), 4, "log_likelihood", "aic", "bic")


_FLAG = {"l_returnflag": {(): {"A": 0.3, "N": 0.45, "R": 0.25}}, "l_linestatus": {("A",): {"F": 0.8, "O": 0.2}, ("N",): {"F": 0.3, "O": 0.7}, ("R",): {"F": 0.6, "O": 0.4}}}


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN [0.3 * 0.8, 0.45 * 0.3, 0.25 * 0.6] ELSE [0.3 * 0.2, 0.45 * 0.7, 0.25 * 0.4] END AS p FROM lineitem)
     SELECT l_orderkey, l_linenumber, CASE list_position(p, list_max(p)) WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS map_l_returnflag FROM s""")
def i5_most_probable_state(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus")
    return scoring.most_probable_state(rows, _FLAG, {"l_linestatus": ["l_returnflag"]}, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "map_l_returnflag")


@query("""WITH n AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*), o_orderpriority) - 1 AS r FROM orders GROUP BY 1) SELECT o_orderkey, r AS state FROM orders JOIN n USING (o_orderpriority)""")
def i7_order_states(t: Tables) -> DataFrame:
    return scoring.order_states(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("state")), "state")


@query(f"""WITH {_given_sql()}, p AS (SELECT *, exp(l0 - total) AS p0, exp(l1 - total) AS p1 FROM t)
     SELECT o_orderkey, round(coalesce(o_totalprice, p0 * 120000.0 + p1 * 330000.0), 3) AS o_totalprice FROM p""")
def e5_impute_with_model(t: Tables) -> DataFrame:
    return _round(scoring.impute_with_model(holed(t), GIVEN).select("o_orderkey", "o_totalprice"), 3, "o_totalprice")


@query(f"""WITH {_forest_sql(f"(SELECT * REPLACE (CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS o_orderstatus) FROM {HOLED})")}, p AS (SELECT *, {', '.join(f'exp(l{i}0 - joint) + exp(l{i}1 - joint) + exp(l{i}2 - joint) AS a{i}' for i in range(2))}, {', '.join(f'exp(l0{j} - joint) + exp(l1{j} - joint) AS b{j}' for j in range(3))} FROM t),
     q AS (SELECT *, {', '.join(f"b0 * {f[0]} + b1 * {f[1]} + b2 * {f[2]} AS s{k}" for k, f in (("F", (0.6, 0.25, 0.45)), ("O", (0.3, 0.35, 0.5)), ("P", (0.1, 0.4, 0.05))))} FROM p)
     SELECT o_orderkey, round(coalesce(o_totalprice, a0 * 120000.0 + a1 * 330000.0), 3) AS o_totalprice, coalesce(o_orderpriority, '1-URGENT') AS o_orderpriority,
       coalesce(o_orderstatus, CASE WHEN sF >= sO AND sF >= sP THEN 'F' WHEN sO >= sP THEN 'O' ELSE 'P' END) AS o_orderstatus FROM q""")
def e5_impute_forest(t: Tables) -> DataFrame:
    """Missing cells of orders from a forest of two latents; what one tree has observed reaches the other's attributes through the arc between them."""
    rows = holed(t).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    return _round(scoring.impute_with_forest(rows, GIVEN_FOREST).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), 3, "o_totalprice")


def _case_sql(draw: str, options: list[tuple[str, float]]) -> str:
    """CASE over the shares of (0, 1)."""
    reached, out = 0.0, []
    for value, p in options[:-1]:
        reached += p
        out.append(f"WHEN {draw} < {reached!r} THEN {value}")
    return f"CASE {' '.join(out)} ELSE {options[-1][0]} END"


def _states_sql(key: str, number: str = "") -> tuple[str, str]:
    """Draws of both latents of GIVEN_FOREST for a key (and a draw's number)."""
    draw = lambda z: uniform_sql(key, *filter(None, [number]), f"'{z}'", "3")
    numbered = lambda row: [(str(i), p) for i, p in enumerate(row)]
    a, b = GIVEN_FOREST.latents["a"], GIVEN_FOREST.latents["b"]
    return _case_sql(draw("a"), numbered(a[0])), f"CASE a WHEN 0 THEN {_case_sql(draw('b'), numbered(b[0]))} ELSE {_case_sql(draw('b'), numbered(b[1]))} END"


def _sample_sql() -> str:
    a, b = _states_sql("o_orderkey")
    quoted = lambda table: [(f"'{v}'", p) for v, p in table.items()]
    draw = lambda c: uniform_sql("o_orderkey", f"'{c}'", "3")
    status = " ".join(f"WHEN {j} THEN {_case_sql(draw('o_orderstatus'), quoted(table))}" for j, table in enumerate(GIVEN_FOREST.discrete["o_orderstatus"]))
    return f"""WITH s AS (SELECT *, {b} AS b FROM (SELECT o_orderkey, {a} AS a FROM orders))
      SELECT o_orderkey, a, b, round(CASE a WHEN 0 THEN 120000.0 ELSE 330000.0 END + CASE a WHEN 0 THEN 60000.0 ELSE 90000.0 END * {normal_sql("o_orderkey", "'o_totalprice'", "3")}, 3) AS o_totalprice,
        CASE WHEN {draw('o_orderstatus?')} >= 0.1 THEN CASE b {status} END END AS o_orderstatus FROM s"""


@query(_sample_sql())
def i6_forest_sample(t: Tables) -> DataFrame:
    """One draw for each order from a model of two latents of which one hangs on the other."""
    whole = scoring.forest_sample(t.orders, "o_orderkey", GIVEN_FOREST, seed=3)
    lossy = scoring.forest_sample(t.orders, "o_orderkey", GIVEN_FOREST, seed=3, hide=0.1, keep_latents=False).select("o_orderkey", "o_orderstatus")
    return _round(whole.select("o_orderkey", "a", "b", "o_totalprice").join(lossy, "o_orderkey"), 3, "o_totalprice")


def _weighting_sql(samples: int) -> str:
    a, b = _states_sql("o_orderkey", "i")
    case = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {math.log(p)!r}" for k, p in table.items()) + " ELSE 0 END"
    price = " ".join(f"WHEN {i} THEN coalesce({-0.5 * math.log(2 * math.pi * v)!r} - (o_totalprice - {m}) ** 2 / {2 * v!r}, 0)" for i, (m, v) in enumerate(GIVEN_FOREST.gaussian["o_totalprice"]))
    status = " ".join(f"WHEN {j} THEN {case('o_orderstatus', table)}" for j, table in enumerate(GIVEN_FOREST.discrete["o_orderstatus"]))
    return f"""WITH d AS (SELECT *, {b} AS b FROM (SELECT *, {a} AS a FROM (SELECT *, unnest(range({samples})) AS i FROM {HOLED}))),
      w AS (SELECT o_orderkey, a, b, exp((CASE a {price} END) + (CASE b {status} END)) AS w, {case('o_orderpriority', GIVEN_FOREST.discrete['o_orderpriority'][0])} AS alone FROM d)
      SELECT o_orderkey, round(ln(sum(w) / {samples}) + any_value(alone), 6) AS log_evidence, round(sum(w) FILTER (a = 0) / sum(w), 6) AS a0, {', '.join(f'round(coalesce(sum(w) FILTER (b = {j}), 0) / sum(w), 6) AS b{j}' for j in range(3))} FROM w GROUP BY 1"""


@query(_weighting_sql(40))
def i4_forest_weighting(t: Tables) -> DataFrame:
    """Posteriors of two dependent latents by weighted draws."""
    out = scoring.forest_likelihood_weighting(holed(t), GIVEN_FOREST, "o_orderkey", 40, seed=3)
    return out.select("o_orderkey", F.round("log_evidence", 6).alias("log_evidence"), F.round(F.col("a_probs")[0], 6).alias("a0"), *[F.round(F.col("b_probs")[j], 6).alias(f"b{j}") for j in range(3)])


@query(f"""WITH {_given_sql()}, c AS (SELECT exp(l0 - total) AS a0, exp(l1 - total) AS a1, CASE WHEN o_orderpriority IS NULL THEN 0.5 WHEN o_orderpriority < '3' THEN 0.9 ELSE 0.2 END AS b0 FROM t),
     n AS (SELECT sum(a0 * b0) AS n00, sum(a0 * (1 - b0)) AS n01, sum(a1 * b0) AS n10, sum(a1 * (1 - b0)) AS n11, count(*) AS n FROM c),
     h AS (SELECT -((n00 + n01) / n * ln((n00 + n01) / n) + (n10 + n11) / n * ln((n10 + n11) / n)) AS hx, -((n00 + n10) / n * ln((n00 + n10) / n) + (n01 + n11) / n * ln((n01 + n11) / n)) AS hy,
       -(n00 / n * ln(n00 / n) + n01 / n * ln(n01 / n) + n10 / n * ln(n10 / n) + n11 / n * ln(n11 / n)) AS hxy FROM n)
     SELECT round(hx + hy - hxy, 8) AS mi, round((hx + hy - hxy) / sqrt(hx * hy), 8) AS nmi FROM h""")
def f10_partition_nmi(t: Tables) -> DataFrame:
    soft = scoring.posterior(holed(t), GIVEN)
    b = F.when(F.col("o_orderpriority").isNull(), 0.5).when(F.col("o_orderpriority") < "3", 0.9).otherwise(0.2)
    rows = soft.select("o_orderkey", "z_probs", F.array(b, 1 - b).alias("y_probs"))
    return _round(dependence.partition_nmi(rows, "o_orderkey", "z_probs", "y_probs"), 8, "mi", "nmi")


_FAMILIES = [("l_returnflag", frozenset()), ("l_returnflag", frozenset({"l_linestatus"})), ("l_linestatus", frozenset({"l_linenumber", "l_returnflag"}))]


def _family_sql() -> str:
    out = []
    for child, parents in _FAMILIES:
        some = sorted(parents)
        config = f"concat_ws('|', {', '.join(some)})" if some else "''"
        out.append(f"""SELECT '{child}' AS child, '{','.join(some)}' AS parents, round(sum(n * ln(n / nc)), 4) AS log_likelihood, (count(DISTINCT x) - 1) * count(DISTINCT config) AS dim,
          round(sum(n * ln(n / nc)) - (count(DISTINCT x) - 1) * count(DISTINCT config) * ln(sum(n)) / 2, 4) AS bic
          FROM (SELECT x, config, n, sum(n) OVER (PARTITION BY config) AS nc FROM (SELECT {child} AS x, {config} AS config, count(*) AS n FROM lineitem GROUP BY 1, 2))""")
    return " UNION ALL ".join(out)


@query(_family_sql())
def j1_family_scores(t: Tables) -> DataFrame:
    return _round(search.discrete_family_scores(t.lineitem, _FAMILIES).drop("family", "n"), 4, "log_likelihood", "bic")


_HOLED_LINES = "(SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax, CASE WHEN l_orderkey % 5 <> 0 THEN l_linestatus END AS l_linestatus) FROM lineitem)"
_LINEAR = [("l_extendedprice", "l_quantity", ""), ("l_tax", "l_discount", ""), ("l_discount", "l_tax", ""), ("l_extendedprice", "l_quantity", "l_returnflag"), ("l_tax", "l_discount", "l_linestatus"), ("l_quantity", "l_tax", "l_linestatus")]


def holed_lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumns({"l_tax": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")), "l_linestatus": F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linestatus"))})


def _linear_sql(mixed: bool) -> str:
    """Families of a numeric child, a numeric parent and, if mixed, a discrete one: residual variances per configuration."""
    out = []
    for y, x, g in _LINEAR:
        if bool(g) == mixed:
            parents = ",".join(sorted(filter(None, (x, g))))
            there = f"{y} IS NOT NULL AND {x} IS NOT NULL" + (f" AND {g} IS NOT NULL" if g else "")
            out.append(f"""SELECT '{y}' AS child, '{parents}' AS parents, sum(n)::BIGINT AS n, round(sum(ll), 2) AS log_likelihood, 3 * count(*) AS dim, round(sum(ll) - 3 * count(*) * ln(sum(n)) / 2, 2) AS bic FROM
              (SELECT count(*) AS n, -count(*) / 2.0 * (ln(2 * pi() * (var_pop({y}) - covar_pop({x}, {y}) ** 2 / var_pop({x}))) + 1) AS ll FROM {_HOLED_LINES} WHERE {there} GROUP BY {g or "1 = 1"})""")
    return " UNION ALL ".join(out)


@query(_linear_sql(False))
def j1_gaussian_scores(t: Tables) -> DataFrame:
    """Families with nulls in other places, each over its own complete rows."""
    scores = search.gaussian_family_scores(holed_lines(t), [(y, frozenset({x})) for y, x, g in _LINEAR if not g])
    rows = [(r["child"], r["parents"], r["n"], float(r["log_likelihood"]), r["dim"], float(r["bic"])) for r in scores]
    return _round(t.spark.createDataFrame(rows, "child string, parents string, n long, log_likelihood double, dim long, bic double"), 2, "log_likelihood", "bic")


@query(_linear_sql(True))
def j1_mixed_scores(t: Tables) -> DataFrame:
    """Numeric children of a numeric and a discrete parent."""
    families = [(y, frozenset({x, g})) for y, x, g in _LINEAR if g]
    return _round(search.conditional_family_scores(holed_lines(t), families, ["l_returnflag", "l_linestatus"]).drop("family"), 2, "log_likelihood", "bic")


def _evidence_sql() -> str:
    """Log evidence of _LINEAR's families, with one numeric parent and a discrete one or none, and of _FAMILIES; alone: of the child by itself on the same rows."""
    out = []
    rest = "-n / 2.0 * ln(2 * pi()) + 0.5 * ln(b0) + lgamma(0.5 + n / 2.0) - lgamma(0.5) - (0.5 + n / 2.0)"
    for y, x, g in _LINEAR:
        parents = ",".join(sorted(filter(None, (x, g))))
        there = f"{y} IS NOT NULL AND {x} IS NOT NULL" + (f" AND {g} IS NOT NULL" if g else "")
        sums = f"""SELECT count(*) AS n, any_value(vx) AS vx, any_value(vy) / 2 AS b0, sum({y} - my) AS sy, sum({x} - mx) AS sx, sum(({y} - my) ** 2) AS yy, sum(({x} - mx) ** 2) AS xx, sum(({y} - my) * ({x} - mx)) AS xy
               FROM {_HOLED_LINES}, (SELECT avg({y}) AS my, var_pop({y}) AS vy, avg({x}) AS mx, var_pop({x}) AS vx FROM {_HOLED_LINES}) WHERE {there} GROUP BY"""
        out.append(f"""SELECT '{y}' AS child, '{parents}' AS parents, sum(n)::BIGINT AS n, round(sum(e), 2) AS log_evidence,
          (SELECT round({rest} * ln(b0 + 0.5 * (yy - sy * sy / (n + 1))) - 0.5 * ln(n + 1), 2) FROM ({sums} 1 = 1)) AS alone FROM
          (SELECT n, {rest} * ln(b0 + 0.5 * (yy - (sy * sy * (xx + vx) - 2 * sy * xy * sx + xy * xy * (n + 1)) / d)) + 0.5 * (ln(vx) - ln(d)) AS e FROM
            (SELECT *, (n + 1) * (xx + vx) - sx * sx AS d FROM ({sums} {g or "1 = 1"})))""")
    for child, parents in _FAMILIES:
        some = sorted(parents)
        config = f"concat_ws('|', {', '.join(some)})" if some else "''"
        there = " AND ".join(f"{c} IS NOT NULL" for c in (child, *some))
        one = lambda by, child=child, there=there: f"""(SELECT sum(nc)::BIGINT AS n, round(sum(lgamma(1.0) - lgamma(1.0 + nc) + r), 2) AS e FROM
          (SELECT sum(n) AS nc, sum(lgamma(alpha + n) - lgamma(alpha)) AS r FROM (SELECT {child}::VARCHAR AS x, {by} AS config, count(*) AS n FROM {_HOLED_LINES} WHERE {there} GROUP BY 1, 2)
           JOIN (SELECT {child}::VARCHAR AS x, (count(*) + 1.0) / (sum(count(*)) OVER () + count(*) OVER ()) AS alpha FROM {_HOLED_LINES} WHERE {child} IS NOT NULL GROUP BY 1) USING (x) GROUP BY config))"""  # noqa: E731
        out.append(f"SELECT '{child}', '{','.join(some)}', a.n, a.e, b.e FROM {one(config)} a, {one(repr(''))} b")
    return " UNION ALL ".join(out)


@query(_evidence_sql())
def j1_evidence_scores(t: Tables) -> DataFrame:
    """Marginal likelihoods of numeric and discrete families with nulls, of one or two parents."""
    families = [(y, frozenset(filter(None, (x, g)))) for y, x, g in _LINEAR] + _FAMILIES
    return _round(search.evidence_family_scores(holed_lines(t), families, ["l_returnflag", "l_linestatus", "l_linenumber"]).drop("family"), 2, "log_evidence", "alone")


def _arc_rows(t: Tables, graph: dict, score: float) -> DataFrame:
    """One row per arc of a graph, with its score."""
    arcs = sorted((p, c) for c, ps in graph.items() for p in ps) or [("", "none")]
    return t.spark.createDataFrame([(p, c, float(score)) for p, c in arcs], "parent string, child string, score double")


@query()
def j2_climb_by_evidence(t: Tables) -> DataFrame:
    """Arcs among columns with nulls, discrete parents of numeric columns included, by marginal likelihood."""
    graph, score = search.hill_climb(holed_lines(t), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_tax"], mixed=True, score="evidence")
    return _arc_rows(t, graph, score)


@query()
def j2_hill_climb(t: Tables) -> DataFrame:
    graph, score = search.hill_climb(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"])
    n = t.lineitem.agg(F.count("*").alias("n"))
    arcs = sorted(f"{p}>{c}" for c, ps in graph.items() for p in ps)
    return n.withColumns({"score": F.lit(float(score)), "arcs": F.lit(",".join(arcs))})


DOMAINS = {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": PRIORITIES, "late": ["n", "y"], "big": ["n", "y"]}


def marked_orders(t: Tables) -> DataFrame:
    """orders with two columns that depend on others."""
    late, big = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250_000
    return t.orders.withColumns({"late": F.when(late, "y").otherwise("n"), "big": F.when(big, "y").otherwise("n")})


def _forest_rows(rows: DataFrame, model: forest.Forest) -> DataFrame:
    """One row per arc of a model, with its bound and the rows it was learnt from."""
    arcs = [F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child")) for p, c in forest.forest_edges(model)]
    none = F.array(F.struct(F.lit(forest.ALONE).alias("parent"), F.lit("none").alias("child")))
    n = rows.agg(F.count("*").alias("n"))
    return n.select("n", F.lit(float(model.elbo)).alias("elbo"), F.lit(len(model.structure.cards)).alias("latents"), F.inline(F.array(*arcs) if arcs else none))


@query()
def g8_latent_forest(t: Tables) -> DataFrame:
    structure = forest.Structure({"a": 2, "b": 2}, {"b": "a"}, {"o_totalprice": "a", "big": "a", "o_orderstatus": "b", "late": "b", "o_orderpriority": forest.ALONE})
    rows = marked_orders(t)
    model = forest.fit_latent_forest(rows, structure, ["o_totalprice"], DOMAINS, candidates=2, steps=12)
    labels = forest.assign(rows, model, ["o_totalprice"], DOMAINS, "o_orderkey")
    return labels.groupBy("a", "b").agg(F.count("*").alias("n"))


@query()
def j6_learn_partitions(t: Tables) -> DataFrame:
    rows = marked_orders(t)
    return _forest_rows(rows, forest.learn_partitions(rows, ["o_totalprice"], DOMAINS, alpha=4, rounds=4, screen=3, keep=2, steps=10))


@query()
def j9_refine_partitions(t: Tables) -> DataFrame:
    rows = marked_orders(t)
    first = forest.learn_partitions(rows, (), DOMAINS, alpha=2, rounds=1, screen=2, keep=1, steps=6)
    return _forest_rows(rows, forest.learn_partitions(rows, (), DOMAINS, "refine", start=first, alpha=2, rounds=3, screen=2, keep=2, steps=8))


@query()
def j5_group_attributes(t: Tables) -> DataFrame:
    """Islands among discrete and numeric attributes: a row per island and attribute."""
    groups, fits = search.group_attributes(marked_orders(t), DOMAINS, ["o_totalprice"], candidates=2, steps=12)
    named = [(i, c, m.states, float(m.elbo)) for i, (g, m) in enumerate(zip(groups, fits, strict=True)) for c in g]
    return t.spark.createDataFrame(named, "island int, attribute string, states int, elbo double")


@query()
def g7_multi_restart(t: Tables) -> DataFrame:
    n = t.events.agg(F.count("*").alias("n"))
    out = None
    for how in ("pyramid", "random"):
        best = parameters.fit_latent_class(t.events, 2, ["value"], {"event_type": TYPES}, candidates=4, steps=12, restart=how, warm=2)[2]
        row = n.withColumns({"restart": F.lit(how), "elbo": F.lit(float(best.elbo)), "steps": F.lit(best.steps)})
        out = row if out is None else out.unionByName(row)
    return out


@query()
def j3_structural_em(t: Tables) -> DataFrame:
    rows = marked_orders(t)
    start = forest.fit_latent_forest(rows, forest.Structure({"a": 2}, {}, dict.fromkeys([*DOMAINS], "a")), (), DOMAINS, candidates=2, steps=8)
    return _forest_rows(rows, search.structural_em(rows.select("o_orderkey", *DOMAINS), start, "o_orderkey", (), DOMAINS, rounds=2, steps=8))


@query()
def j4_augmented_latent_class(t: Tables) -> DataFrame:
    rows = marked_orders(t)
    graph, score = search.augmented_latent_class(rows, ["o_totalprice"], DOMAINS, candidates=2, steps=8)
    arcs = ",".join(sorted(f"{p}>{c}" for c, ps in graph.items() for p in ps))
    return rows.agg(F.count("*").alias("n")).withColumns({"score": F.lit(float(score)), "arcs": F.lit(arcs)})


@query()
def j4_select_augmented(t: Tables) -> DataFrame:
    """The number of states of an augmented latent class, and its arcs."""
    graph, score, states = search.select_augmented(marked_orders(t), ["o_totalprice"], DOMAINS, most=4, candidates=2, steps=8)
    return _arc_rows(t, graph, score).withColumn("states", F.lit(states))


@query()
def j9_refine_and_rewire(t: Tables) -> DataFrame:
    """Refining moves and structural EM in turn."""
    rows = marked_orders(t).select("o_orderkey", *DOMAINS)
    return _forest_rows(rows, search.refine_and_rewire(rows, "o_orderkey", (), DOMAINS, rounds=2, alpha=2, screen=2, keep=1, steps=6))


@query()
def j7_binary_forest(t: Tables) -> DataFrame:
    rows = marked_orders(t)
    return _forest_rows(rows, search.learn_binary_forest(rows, "o_orderkey", DOMAINS, "labels", rounds=2, steps=8))


@query()
def j8_latent_tree(t: Tables) -> DataFrame:
    rows = marked_orders(t)
    return _forest_rows(rows, forest.learn_partitions(rows, (), DOMAINS, "tree", alpha=3, rounds=3, screen=2, keep=1, steps=6))


@query()
def j8_tree_by_phases(t: Tables) -> DataFrame:
    """A latent tree by expanding, adjusting and simplifying in turn."""
    rows = marked_orders(t)
    return _forest_rows(rows, forest.learn_partitions(rows, (), DOMAINS, "phases", alpha=3, rounds=6, screen=2, keep=1, steps=6))


@query()
def j10_pouches(t: Tables) -> DataFrame:
    best = search.search_pouches(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], most_states=3, rounds=3, screen=3, steps=8)
    groups = ";".join(",".join(sorted(b)) for b in sorted(best["blocks"]))
    return t.lineitem.agg(F.count("*").alias("n")).withColumns({"states": F.lit(best["states"]), "blocks": F.lit(groups), "bic": F.lit(float(best["bic"]))})
