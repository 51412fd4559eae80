import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.functions import special
from partita.operators import compare, dependence, describe, forest, missing, parameters, prepare, ranks, scoring, search
from partita.operators.scoring import MixtureModel
from partita.sources import tables as io
from partita.streaming import updates

PLANTED = MixtureModel([0.3, 0.7], {"x": [(-4.0, 1.0), (3.0, 0.5)], "y": [(0.0, 1.0), (6.0, 1.0)]}, {"c": [{"a": 0.9, "b": 0.1}, {"a": 0.2, "b": 0.8}]})


@pytest.fixture(scope="module")
def planted(spark):
    return scoring.forward_sample(spark, 3000, PLANTED, seed=1, hide=0.1).cache()


def test_tails_and_gamma_functions():
    assert math.isclose(float(special.digamma(1.0)), -0.5772156649015329, abs_tol=1e-12)
    assert math.isclose(special.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.chi2_tail(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(special.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    # published upper 5 % points of the studentised range
    for q, k, dof in ((3.877, 3, 10), (4.232, 5, 20), (3.314, 3, 1_000_000)):
        assert abs(special.studentised_range_tail(q, k, dof) - 0.05) < 5e-4


def test_bound_never_falls_and_partitions_do_not_matter(planted):
    domains = {"c": ["a", "b"]}
    prior = parameters.class_prior(planted, 2, ["x", "y"], domains)
    model = parameters._start(prior, np.random.default_rng(0))
    bounds = []
    for _ in range(8):
        one = parameters.e_step(planted, [model], ["x", "y"], domains)[0]
        two = parameters.e_step(planted.repartition(7), [model], ["x", "y"], domains)[0]
        assert all(np.allclose(one[k], two[k]) for k in one)
        bounds.append(one["bound"] - parameters.parameter_divergence(model, prior))
        model = parameters.m_step(one, prior)
    assert all(b - a > -1e-6 * abs(a) for a, b in zip(bounds, bounds[1:]))


def test_planted_clusters_are_recovered(planted):
    fits = parameters.fit_latent_class(planted, [1, 2, 3], ["x", "y"], {"c": ["a", "b"]}, candidates=3, steps=40)
    assert fits[2].elbo > fits[1].elbo
    model = fits[2].expected()
    assert abs(model.weights[0] - 0.3) < 0.04 and abs(model.gaussian["x"][0][0] + 4) < 0.2 and abs(model.discrete["c"][1]["b"] - 0.8) < 0.05
    labelled = scoring.hard_assign(planted.withColumnRenamed("z", "truth"), model)
    assert labelled.filter("z = truth").count() > 0.97 * labelled.count()
    filled = scoring.impute_with_model(planted.drop("z"), model)
    assert filled.filter("x is null or y is null or c is null").count() == 0


def test_one_step_equals_plain_sums(spark):
    rows = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "b"), (5.0, "b")], "x double, c string")
    prior = parameters.LatentClass(np.ones(1), {"x": tuple(np.array([v]) for v in (0.0, 1.0, 1.0, 1.0))}, {"c": np.ones((1, 2))}, {"c": ["a", "b"]})
    stats = parameters.e_step(rows, [prior], ["x"], {"c": ["a", "b"]})[0]
    assert stats["r"].tolist() == [4] and stats["x"][:, 0].tolist() == [3, 8, 30] and stats["c"].tolist() == [[1, 2]]
    new = parameters.m_step(stats, prior)
    m, k, a, b = (v[0] for v in new.gaussian["x"])
    assert (k, a) == (4, 2.5) and math.isclose(m, 2) and math.isclose(b, 1 + 0.5 * (30 - 16))


def test_gaussian_mixtures(planted):
    diag = parameters.fit_mixture(planted, 2, ["x", "y"], candidates=3, steps=30)
    full = parameters.fit_mixture(planted, 2, ["x", "y"], full=True, candidates=3, steps=30)
    for fit in (diag, full):
        assert sorted(np.round(fit["means"][:, 0]).tolist()) == [-4, 3]
    assert diag["dim"] == 9 and full["dim"] == 11


def test_posteriors_and_sampling_agree(planted):
    rows = scoring.posterior(planted, PLANTED)
    assert rows.filter(F.abs(F.aggregate("z_probs", F.lit(0.0), lambda s, x: s + x) - 1) > 1e-9).count() == 0
    exact = scoring.row_log_likelihood(planted.filter("row_id < 40"), PLANTED)
    drawn = scoring.likelihood_weighting(planted.filter("row_id < 40"), PLANTED, "row_id", 4000)
    both = exact.join(drawn, "row_id").select("log_likelihood", "log_evidence").toPandas()
    assert (both["log_likelihood"] - both["log_evidence"]).abs().max() < 0.2


def test_a_single_batch_stream_is_a_batch_fit_and_replays_change_nothing(spark, planted, tmp_path):
    domains = {"c": ["a", "b"]}
    prior = parameters.class_prior(planted, 2, ["x", "y"], domains)
    start = parameters._start(prior, np.random.default_rng(0))
    planted.select("x", "y", "c").coalesce(1).write.parquet(str(tmp_path / "in"))
    state = updates.StateTable(str(tmp_path / "state"))
    on_batch = updates.updater(state, prior, start, ["x", "y"], domains, steps=5)
    updates.run_stream(spark.readStream.schema("x double, y double, c string").parquet(str(tmp_path / "in")), on_batch, str(tmp_path / "at"))
    saved = state.rows(spark)
    whole = updates.update(planted, prior, start, ["x", "y"], domains, steps=5)
    assert len(saved) == 1 and np.allclose(saved[0]["natural"], updates.natural(whole))
    on_batch(planted.select("x", "y", "c"), saved[0]["batch_id"])
    assert [r["natural"] for r in state.rows(spark)] == [r["natural"] for r in saved]
    again = updates.from_natural(updates.natural(whole), prior)
    assert np.allclose(again.gaussian["x"][3], whole.gaussian["x"][3])


def test_parallel_deltas_of_one_block_are_its_fit(planted):
    prior = parameters.class_prior(planted, 2, ["x"], {})
    start = parameters._start(prior, np.random.default_rng(0))
    one = updates.parallel_bayes_update(planted, prior, start, ["x"], steps=4, blocks=1)
    now = start
    for _ in range(4):
        now = parameters.m_step(parameters.e_step(planted, [now], ["x"], {})[0], prior)
    assert np.allclose(updates.natural(one), updates.natural(now))


def test_arff_tables(spark, tmp_path):
    (tmp_path / "t.arff").write_text("% note\n@relation r\n\n@attribute id {p1,p2}\n@attribute age real [0,120]\n@data\n% more\np1,4.5\np2,?\n")
    df = io.read_arff_table(spark, str(tmp_path / "t.arff"))
    assert sorted(map(tuple, df.collect())) == [("p1", 4.5), ("p2", None)]
    assert df.schema["id"].metadata["states"] == ["p1", "p2"] and df.schema["age"].metadata["bounds"] == [0.0, 120.0]
    (tmp_path / "bad.arff").write_text("@relation r\n@attribute a real\n@data\n1,2\n")
    with pytest.raises(Exception, match="does not have 1 cells"):
        io.read_arff_table(spark, str(tmp_path / "bad.arff")).collect()
    io.write_metrics(spark, str(tmp_path / "runs"), elbo=1.5, seconds=2.0)
    io.write_metrics(spark, str(tmp_path / "runs"), elbo=2.5, seconds=1.0)
    assert spark.read.json(str(tmp_path / "runs")).count() == 2
    io.save_model(spark, PLANTED, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="lacks attributes"):
        io.load_model(spark, str(tmp_path / "m"), ["x", "y"])


def test_edges_of_small_tables(spark):
    ties = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)] * 2, "g string, v double")
    assert compare.mann_whitney_stat(ties, "g", "v", "a", "b").first()["u"] == 3.0
    with pytest.raises(ValueError, match="no such columns"):
        prepare.project(ties, ["g", "nope"])
    holes = spark.createDataFrame([(1, None, "x"), (2, None, None)], "k long, v double, c string")
    assert {r["attribute"]: r["missing"] for r in describe.missing_profile(holes, ["v", "c"]).collect()} == {"v": 2, "c": 1}
    assert missing.impute_expected(holes, ["v"], ["c"]).filter("c = 'x' and v is null").count() == 2
    far = spark.createDataFrame([(1e9 + i, 1e9 - i, 1) for i in range(5)], "a double, b double, w long")
    cov = {(r["a"], r["b"]): r["covariance"] for r in prepare.weighted_moments(far, ["a", "b"], "w").collect()}
    assert cov == {("a", "a"): 2.0, ("a", "b"): -2.0, ("b", "b"): 2.0}
    twins = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "k long, v array<double>")
    got = {(r["key_q"], r["key"]): r["distance"] for r in dependence.knn_join(twins, twins, "k", "v", 1).collect()}
    assert got == {(1, 2): 0.0, (2, 1): 0.0, (3, 1): 5.0}
    with pytest.raises(ValueError, match="positive"):
        dependence.radius_join(far, far, "w", ["a"], 0)


def test_radius_join_meets_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(dependence, "KEYS", 4)
    monkeypatch.setattr(dependence, "LISTS", 20)
    rows = [(i, float(i % 5), 0.5 * (i % 3)) for i in range(60)] + [(100 + i, 2.0, 9.0) for i in range(30)]
    rows += [(200, None, 1.0), (201, float("nan"), 1.0), (202, float("inf"), 1.0), (203, float("inf"), 1.0), (None, 1.0, 1.0), (3, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    pairs = dependence.radius_pairs(df, df, "k", ["a", "b"], 1.1)
    lists = pairs.select("keys").distinct().collect()
    assert 16 < len(lists) < 91 and pairs.count() < 1500  # 15 vectors, one of them with 30 rows in lists of few
    whole = [r for r in rows if r[0] is not None and r[1] is not None and abs(r[1]) < 1e9]
    far = lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2])
    want = sorted((p[0], q[0], round(far(p, q), 9)) for p in whole for q in whole if p[0] != q[0] and far(p, q) <= 1.1)
    got = sorted((r["key_q"], r["key"], round(r["distance"], 9)) for r in dependence.radius_join(df, df, "k", ["a", "b"], 1.1).collect())
    assert got == want


def test_passes_over_discrete_attributes_read_combinations(spark, monkeypatch):
    domains = {"a": ["x", "y"], "b": ["x", "y"], "c": ["x", "y", "z"]}
    rng = np.random.default_rng(3)
    z = rng.random(3000) < 0.4
    pick = lambda p, one, other: np.where(rng.random(3000) < np.where(z, p, 1 - p), one, other)
    a, b, c = pick(0.9, "x", "y"), pick(0.8, "x", "y"), pick(0.7, "z", "y")
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else str(p), str(q), "other" if i % 70 == 0 else str(r)) for i, (p, q, r) in enumerate(zip(a, b, c))], "k long, a string, b string, c string")
    one = forest.Structure({"t": 2}, {}, dict.fromkeys(domains, "t"))
    prior = forest.forest_prior(parameters.class_prior(rows, 1, (), domains), one)
    start = forest.forest_start(prior, np.random.default_rng(0))
    by_row = forest.fit_forests(rows, [start], [prior], (), domains, 5)[0]
    few, weight = forest.counted(rows, (), domains)
    assert few.count() < 40 and few.agg(F.sum(weight)).first()[0] == 3000
    by_count = forest.fit_forests(few, [start], [forest.forest_prior(parameters.class_prior(few, 1, (), domains, weight=weight), one)], (), domains, 5, weight=weight)[0]
    assert by_count.elbo == pytest.approx(by_row.elbo, abs=1e-6)
    assert forest.pair_dependence(few, (), domains, weight) == pytest.approx(forest.pair_dependence(rows, (), domains))
    assert search.hill_climb(few, list(domains), weight=weight)[0] == search.hill_climb(rows, list(domains))[0]
    assert search.hill_climb(few, list(domains), weight=weight)[1] == pytest.approx(search.hill_climb(rows, list(domains))[1])

    seen = []
    monkeypatch.setattr(forest, "forest_e_step", lambda features, *rest, _f=forest.forest_e_step: (seen.append(features.count()), _f(features, *rest))[1])
    search.refine_and_rewire(rows, "k", (), domains, rounds=1, alpha=2, screen=2, keep=1, steps=3)
    search.structural_em(rows, by_row, "k", (), domains, rounds=1, steps=3)
    search.learn_binary_forest(rows, "k", domains, "labels", rounds=1, steps=3)
    forest.fit_latent_forest(rows, one, (), domains, 1, 2)
    assert seen and max(seen) < 40
    monkeypatch.setattr(updates, "forest_e_step", lambda features, *rest, _f=updates.forest_e_step: (seen.append(features.count()), _f(features, *rest))[1])
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/counted-state"
    for rule in ("bayes", "drift", "stochastic"):
        state = updates.StateTable(f"{path}-{rule}")
        on_batch = updates.updater(state, prior, start, (), domains, rule, steps=3)
        on_batch(rows.filter("k < 1500"), 0)
        on_batch(rows.filter("k >= 1500"), 1)
        last = state.rows(spark)[-1]
        model = updates.from_natural(np.array(state.rows(spark)[0]["natural"]), prior)
        want = scoring.forest_log_likelihood(rows.filter("k >= 1500"), model.expected(domains)).agg(F.sum("log_likelihood")).first()[0]
        assert last["predictive"] == pytest.approx(want)
    assert max(seen) < 40


def test_mixtures_estimate_equal_rows_once(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.multivariate_normal([0, 0, 5], [[1, 0.8, 0], [0.8, 1, 0], [0, 0, 1]], 60), rng.multivariate_normal([4, -4, 1], np.eye(3), 60)]), 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] * 4, "a double, b double, c double")
    blocks = [["b", "a"], ["c"]]
    fit = parameters.fit_mixture(df, 2, ["a", "b", "c"], blocks=blocks, candidates=2, steps=6)
    total = np.zeros(len(x))
    for w, m, cov in zip(fit["weights"], fit["means"], fit["covariances"], strict=True):
        gap = x - m
        total += w * np.exp(-0.5 * (gap @ np.linalg.inv(cov) * gap).sum(axis=1)) / np.sqrt(np.linalg.det(2 * math.pi * cov))
    assert fit["n"] == 480 and fit["log_likelihood"] == pytest.approx(4 * np.log(total).sum(), abs=1e-6)
    assert abs(fit["covariances"][:, 0, 1]).max() > 0.3 and not fit["covariances"][:, :2, 2].any()
    model, groups = (fit["weights"], fit["means"], fit["covariances"]), [np.array([1, 0]), np.array([2])]
    pairs = parameters._joint_pairs([groups])
    assert pairs == [(0, 1)]
    assert np.exp(parameters._quadratic(x, pairs) @ parameters._log_coefficients(model, groups, pairs)).sum(axis=1) == pytest.approx(total)


def test_noise_is_drawn_once(spark, monkeypatch):
    kept, real = {}, dependence.stored
    monkeypatch.setattr(dependence, "stored", lambda df, label: kept.setdefault(label, real(df, label)))
    rows = spark.range(60).selectExpr("id", "id % 3 as a", "id % 2 as b")
    dependence.mutual_info_continuous(rows, "id", "a", "b", jitter=1e-6)
    assert kept["mi-rows"].count() == 60 and kept["mi-rows"].columns == ["key", "x", "y"]


def test_structures(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, 2000)
    b = np.where(rng.random(2000) < 0.9, a, 1 - a)
    x = rng.standard_normal(2000)
    y = 2 * x + 0.1 * rng.standard_normal(2000)
    rows = [(str(p), str(q), str(r), float(s), float(t)) for p, q, r, s, t in zip(a, b, rng.integers(0, 2, 2000), x, y)]
    df = spark.createDataFrame(rows, "a string, b string, c string, x double, y double").cache()
    graph, score = search.hill_climb(df, ["a", "b", "c"], ["x", "y"])
    assert sorted(tuple(sorted((p, c))) for c, ps in graph.items() for p in ps) == [("a", "b"), ("x", "y")]
    empty = sum(search.FamilyScores(df, ["a", "b", "c"], ["x", "y"])([(v, frozenset()) for v in "abcxy"]).values())
    assert score > empty
    mi = dependence.mutual_info_continuous(df.withColumn("k", F.monotonically_increasing_id()), "k", "x", "y")
    assert abs(mi - (-0.5 * math.log(1 - 4 / 4.01))) < 0.25


@pytest.fixture(scope="module")
def two_partitions(spark):
    """Two independent hidden clusterings, each with three attributes, and one column of noise."""
    rng = np.random.default_rng(6)
    n = 1500
    u, v = rng.integers(0, 2, n), rng.integers(0, 2, n)
    flip = lambda z: np.where(rng.random(n) < 0.1, 1 - z, z)
    cols = {f"a{i}": flip(u) for i in range(3)} | {f"b{i}": flip(v) for i in range(3)}
    rows = [(i, *[str(c[i]) for c in cols.values()], float(rng.standard_normal())) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(["k long", *[f"{c} string" for c in cols], "x double"])).cache()


FOREST_DOMAINS = {c: ["0", "1"] for c in ("a0", "a1", "a2", "b0", "b1", "b2")}


def test_forest_bounds_rise_and_one_latent_is_a_latent_class(two_partitions, planted):
    structure = forest.Structure({"p": 2, "q": 2}, {"q": "p"}, {**{c: "p" if c[0] == "a" else "q" for c in FOREST_DOMAINS}, "x": forest.ALONE})
    model = forest.fit_latent_forest(two_partitions, structure, ["x"], FOREST_DOMAINS, candidates=1, steps=10)
    assert all(b - a > -1e-3 for a, b in zip(model.trace, model.trace[1:]))
    one = forest.Structure({"z": 2}, {}, {"x": "z", "y": "z", "c": "z"})
    a = forest.fit_latent_forest(planted, one, ["x", "y"], {"c": ["a", "b"]}, candidates=3, steps=60)
    b = parameters.fit_latent_class(planted, 2, ["x", "y"], {"c": ["a", "b"]}, candidates=3, steps=60)[2]
    assert abs(a.elbo - b.elbo) < 0.5


def test_partitions_are_learnt(two_partitions):
    model = forest.learn_partitions(two_partitions, ["x"], FOREST_DOMAINS, alpha=4, rounds=8, screen=3, keep=2, steps=12)
    groups = {}
    for c, z in model.structure.of.items():
        groups.setdefault(z, set()).add(c)
    assert {"a0", "a1", "a2"} in groups.values() and {"b0", "b1", "b2"} in groups.values()
    labels = forest.assign(two_partitions, model, ["x"], FOREST_DOMAINS, "k")
    z = model.structure.of["a0"]
    same = labels.join(two_partitions, "k").filter(F.col(z) == F.col("a0").cast("int")).count() / 1500
    assert max(same, 1 - same) > 0.85


def test_moves_keep_structures_sound():
    s = forest.Structure({"p": 3, "q": 2}, {"q": "p"}, {"a": "p", "b": "p", "c": "q", "d": "q", "e": forest.ALONE})
    for t in [*forest.remove_latents(s), *forest.insert_latents(s), *forest.relocate(s), *forest.change_cards(s), *forest.add_latents(s, [("a", "e"), ("e", "p")]), *forest.add_arcs(s)]:
        assert not t.cyclic() and set(t.of) == set(s.of) and all(p in (*t.cards, forest.ALONE) for p in [*t.of.values(), *t.up.values()])
    assert forest.add_arcs(s) == []
    assert forest.remove_latents(s)[0].of["a"] == forest.ALONE


def test_places_totals_and_quantiles(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], float(v) if i % 9 else None) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    placed = {r["k"]: r["before"] for r in ranks.running_total(df, ["k"]).collect()}
    assert placed == {i: i for i in range(500)}
    assert sorted(r["k"] for r in ranks.smallest(df.repartition(5), ["v", "k"], 77).collect()) == sorted(
        k for k, *_ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))[:77]
    )
    got = {r["g"]: (r["q"], r["m"]) for r in ranks.quantiles(df, "v", {"q": 0.3, "m": 0.5}, ["g"]).collect()}
    for g in "ab":
        v = [x for _, h, x in rows if h == g and x is not None]
        assert np.allclose(got[g], np.quantile(v, [0.3, 0.5]))
    whole = ranks.quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert math.isclose(whole, np.median([x for *_, x in rows if x is not None]))
    assert ranks.quantiles(df.limit(0), "v", {"m": 0.5}, ["g"]).count() == 0
    batches = prepare.fixed_batches(df, "k", 64).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in batches) == [(i, 64) for i in range(7)] + [(7, 52)]


def test_family_scores_stand_alone(spark):
    rng = np.random.default_rng(3)
    a, c = rng.standard_normal(300), rng.standard_normal(300)
    rows = [(float(x), float(2 * x + rng.standard_normal()), None if i % 2 else float(z), "a|b" if i % 3 else "a", "c" if i % 3 else "b|c", None) for i, (x, z) in enumerate(zip(a, c, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string, e string, f string")
    family = ("b", frozenset({"a"}))
    alone = search.gaussian_family_scores(df, [family])[0]["bic"]
    beside = search.gaussian_family_scores(df, [("c", frozenset({"a"})), family])
    assert abs(alone - beside[1]["bic"]) < 1e-9 and beside[0]["n"] == 150
    one = search.discrete_family_scores(df, [("d", frozenset({"e"})), ("a", frozenset({"d", "e"}))]).collect()
    assert {(r["child"], r["dim"]) for r in one} == {("d", 2), ("a", 299 * 2)}
    scores = search.FamilyScores(df, ["d", "e", "f"], ["a", "b", "c"])
    got = scores([("f", frozenset()), ("d", frozenset({"f"})), ("b", frozenset({"f"})), ("b", frozenset({"a", "d"})), ("b", frozenset({"d"}))])
    assert got["f", frozenset()] == 0 and got["d", frozenset({"f"})] == got["b", frozenset({"f"})] == -math.inf
    assert got["b", frozenset({"a", "d"})] > got["b", frozenset({"d"})]
    graph, _ = search.hill_climb(df, ["d", "e", "f"], ["a", "b", "c"], mixed=True)
    assert "a" in graph["b"] or "b" in graph["a"]


def test_forests_are_saved_and_score_rows(spark, two_partitions, tmp_path):
    structure = forest.Structure({"u": 2, "v": 2}, {"v": "u"}, {**{f"a{i}": "u" for i in range(3)}, **{f"b{i}": "v" for i in range(3)}, "x": forest.ALONE})
    fitted = forest.fit_latent_forest(two_partitions, structure, ["x"], FOREST_DOMAINS, candidates=2, steps=15)
    model = fitted.expected(FOREST_DOMAINS)
    io.save_forest(spark, model, str(tmp_path / "forest"))
    again = io.load_forest(spark, str(tmp_path / "forest"), two_partitions.columns)
    assert again == model
    with pytest.raises(ValueError, match="lacks attributes"):
        io.load_forest(spark, str(tmp_path / "forest"), ["x"])
    rows = scoring.forest_posterior(scoring.forest_log_likelihood(two_partitions.limit(40), model), model).collect()
    for r in rows:
        joint = {}
        for u in range(2):
            for v in range(2):
                p = model.latents["u"][0][u] * model.latents["v"][u][v]
                for i in range(3):
                    p *= model.discrete[f"a{i}"][u][r[f"a{i}"]] * model.discrete[f"b{i}"][v][r[f"b{i}"]]
                joint[u, v] = p
        m, s2 = model.gaussian["x"][0]
        total = sum(joint.values())
        assert abs(r["log_likelihood"] - math.log(total) + 0.5 * math.log(2 * math.pi * s2) + (r["x"] - m) ** 2 / (2 * s2)) < 1e-9
        assert abs(r["v_probs"][1] - (joint[0, 1] + joint[1, 1]) / total) < 1e-9 and abs(r["u_probs"][0] - (joint[0, 0] + joint[0, 1]) / total) < 1e-9
    score = scoring.forest_score(two_partitions, model).first()
    assert score["dim"] == 1 + 2 + 12 + 2 and score["bic"] < score["log_likelihood"]


def test_comparison_report_has_p(spark):
    rng = np.random.default_rng(5)
    rows = [("pq"[i % 2], "xyz"[i % 3], float(rng.standard_normal() + 2 * (i % 2)), "mn"[int(rng.random() < 0.2 + 0.6 * (i % 2))]) for i in range(300)] + [(None, "x", 1.0, None)]
    df = spark.createDataFrame(rows, "two string, three string, v double, c string")
    out = compare.with_p(compare.compare_partitions(df, ["two", "three"], ["v"], ["c"])).set_index(["partition", "test", "a"], drop=False)
    assert sorted(out["test"]) == ["chi2", "chi2", "kruskal_wallis", "mann_whitney", "tukey", "tukey", "tukey"]
    assert out["p"].notna().all() and out.loc[out["partition"] == "two", "reject"].all() and not out.loc[out["partition"] == "three", "reject"].any()
    assert describe.contingency_table(df, "two", "c").agg(F.sum("n")).first()[0] == 300


def test_text_keys_have_neighbours(spark):
    rows = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [5.0])], "k string, v array<double>")
    assert {(r["key_q"], r["key"]) for r in dependence.knn_join(rows, rows, "k", "v", 1).collect()} == {("a", "b"), ("b", "a"), ("c", "b")}


def test_draws_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1.0), ("k", 5.0)], "k string, x double")
    got = scoring.likelihood_weighting(rows, MixtureModel([0.5, 0.5], {"x": [(0.0, 1.0), (5.0, 1.0)]}), "k", 100).collect()
    assert len(got) == 2 and all(abs(sum(r["probs"]) - 1) < 1e-9 for r in got)


def test_planted_groups_are_found(spark, two_partitions):
    groups, fits = search.group_attributes(two_partitions, FOREST_DOMAINS, candidates=2, steps=15)
    assert sorted(map(sorted, groups)) == [["a0", "a1", "a2"], ["b0", "b1", "b2"]] and all(m.states >= 2 for m in fits)
    ranked = forest.ranked_pairs(two_partitions, ["x"], FOREST_DOMAINS)
    assert len(ranked) == 21 and all(a[0] == b[0] for a, b in ranked[:6]) and {"x"} <= set(ranked[-1]) | set(ranked[-2])


def test_binary_trees_do_not_mix_partitions(spark, two_partitions):
    model = search.learn_binary_forest(two_partitions, "k", FOREST_DOMAINS, "average", rounds=2, steps=10)
    below = {}
    for c, z in model.structure.of.items():
        if z != forest.ALONE:
            below.setdefault(z, set()).add(c[0])
    assert below and all(len(kinds) == 1 for kinds in below.values())


def test_structural_em_parts_what_one_latent_joins(spark, two_partitions):
    rows = two_partitions.select("k", *FOREST_DOMAINS)
    structure = forest.Structure({"u": 2, "v": 2}, {}, {**dict.fromkeys(["a0", "a1", "a2"], "u"), "b0": "u", "b1": "v", "b2": "v"})
    start = forest.fit_latent_forest(rows, structure, (), FOREST_DOMAINS, candidates=2, steps=15)
    learnt = search.structural_em(rows, start, "k", (), FOREST_DOMAINS, rounds=2, steps=12)
    assert learnt.elbo >= start.elbo and learnt.structure.of["b0"] == learnt.structure.of["b1"]


def test_mixture_size_and_joint_leaves_are_found(spark):
    rng = np.random.default_rng(8)
    z = rng.integers(0, 2, 1200)
    x = rng.standard_normal(1200) + 8 * z
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, 0.9 * (x - 8 * z) + 0.3 * rng.standard_normal(1200) - 6 * z, rng.standard_normal(1200), strict=True)], "x double, y double, w double").cache()
    assert parameters.select_mixture(df, ["x", "y"], most=3, full=True, candidates=3, steps=15)["states"] == 2
    found = search.search_pouches(df, ["x", "y", "w"], most_states=3, rounds=4, screen=12, steps=25)
    assert found["states"] == 2 and ["x", "y"] in [sorted(b) for b in found["blocks"]]


def test_marginal_likelihoods_of_families(spark):
    rng = np.random.default_rng(8)
    n = 400
    g = rng.integers(0, 2, n)
    x, w = rng.normal(5, 2, n), rng.normal(0, 1, n)
    y = np.where(g == 1, 3 * x, x) + 10 + rng.normal(0, 0.5, n)
    rows = [(float(a), float(b) if i % 9 else None, float(c), str(k)) for i, (a, b, c, k) in enumerate(zip(x, y, w, g, strict=True))]
    df = spark.createDataFrame(rows, "x double, y double, w double, g string")
    families = [("y", frozenset(p)) for p in ((), ("x",), ("w",), ("g",), ("x", "g"), ("x", "w", "g"))] + [("g", frozenset())]
    got = [r["log_evidence"] for r in sorted(search.evidence_family_scores(df, families, ["g"]).collect(), key=lambda r: r["family"])]
    there = np.array([r[1] is not None for r in rows])
    mean, var = y[there].mean(), y[there].var()
    plain = parameters.gaussian_evidence(there.sum(), (y[there] - mean).sum(), ((y[there] - mean) ** 2).sum(), 0.0, 1.0, 0.5, var / 2)
    assert math.isclose(got[0], float(plain), rel_tol=1e-9)
    assert got[4] > got[1] > got[0] > got[2] and got[4] > got[3] and got[4] > got[5]  # the true parents win, a needless one costs
    counts = np.bincount(g)
    assert math.isclose(got[6], parameters.dirichlet_evidence(counts, (counts + 1) / (n + 2)), rel_tol=1e-9)
    scaled = [r["log_evidence"] for r in search.evidence_family_scores(df.withColumn("x", F.col("x") * 1000), families[1:2], ["g"]).collect()]
    assert math.isclose(scaled[0], got[1], rel_tol=1e-6)
    graph, _ = search.hill_climb(df, ["g"], ["x", "y", "w"], mixed=True, score="evidence")
    joined = {frozenset((p, c)) for c, ps in graph.items() for p in ps}
    assert {frozenset("xy"), frozenset("gy")} <= joined and not any("w" in pair for pair in joined)
    with pytest.raises(ValueError):
        search.hill_climb(df, ["g"], ["x"], score="other")


def test_forests_fill_sample_and_weigh(spark):
    model = scoring.ForestModel(
        {"a": 2, "b": 2, "c": 3}, {"b": "a"}, {"x": "a", "u": "b", "v": "b", "w": "c", "t": ""},
        {"a": [[0.4, 0.6]], "b": [[0.9, 0.1], [0.2, 0.8]], "c": [[0.2, 0.3, 0.5]]},
        {"x": [(0.0, 1.0), (8.0, 1.0)], "t": [(2.0, 4.0)]},
        {"u": [{"p": 0.9, "q": 0.1}, {"p": 0.1, "q": 0.9}], "v": [{"p": 0.8, "q": 0.2}, {"p": 0.3, "q": 0.7}], "w": [{"1": 0.9, "2": 0.1}, {"1": 0.5, "2": 0.5}, {"1": 0.1, "2": 0.9}]},
    )
    rows = scoring.forest_sample(spark.range(4000).withColumnRenamed("id", "k"), "k", model, seed=2).cache()
    share = rows.groupBy("a", "b").count().collect()
    assert abs({(r["a"], r["b"]): r["count"] / 4000 for r in share}[1, 1] - 0.48) < 0.03
    assert rows.agg(F.avg("t"), F.var_pop("t")).first()[1] == pytest.approx(4, rel=0.1)
    holed = rows.select("k", F.when(F.col("k") % 2 == 0, F.col("x")).alias("x"), F.when(F.col("k") % 3 != 0, F.col("u")).alias("u"), "v", F.when(F.col("k") % 5 != 0, F.col("w")).alias("w"), F.when(F.col("k") % 7 != 0, F.col("t")).alias("t"))
    filled = scoring.impute_with_forest(holed, model)
    assert filled.columns == holed.columns and filled.filter("x is null or u is null or w is null or t is null").count() == 0
    both = filled.alias("f").join(rows.alias("r"), "k").filter("k % 3 = 0 and k % 2 = 0")
    right = both.filter("f.u = r.u").count() / both.count()
    common = max(r["count"] for r in both.groupBy("r.u").count().collect()) / both.count()
    assert right > common + 0.1  # what x tells about a, and a about b, fills u
    exact = {r["k"]: r for r in scoring.forest_posterior(holed, model).limit(50).collect()}
    drawn = scoring.forest_likelihood_weighting(holed.filter(F.col("k").isin(list(exact))), model, "k", 800).collect()
    evidence = {r["k"]: r["log_likelihood"] for r in scoring.forest_log_likelihood(holed, model).filter(F.col("k").isin(list(exact))).collect()}
    for r in drawn:
        assert abs(r["log_evidence"] - evidence[r["k"]]) < 0.35
        assert all(abs(p - q) < 0.12 for z in "abc" for p, q in zip(r[f"{z}_probs"], exact[r["k"]][f"{z}_probs"], strict=True))
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, 1.0, "never", "p", "1", 2.0)], "k long, x double, u string, v string, w string, t double")
    got = {r["k"]: r for r in scoring.forest_likelihood_weighting(odd, model, "k", 50).collect()}
    assert got[None]["log_evidence"] == pytest.approx(0, abs=1e-9) and got[1]["log_evidence"] is None
    assert scoring.forest_sample(odd.limit(0), "k", model).count() == scoring.impute_with_forest(odd.limit(0), model).count() == 0


def test_local_updates_reach_the_bound_of_global_ones(spark, two_partitions):
    rng = np.random.default_rng(3)
    base = parameters.class_prior(two_partitions, 1, ["x"], FOREST_DOMAINS)
    one = forest.Structure({"p": 2}, {}, {c: "p" if c[0] == "a" else forest.ALONE for c in [*FOREST_DOMAINS, "x"]})
    first = forest_of(two_partitions, base, one, rng)
    state = forest.complete(two_partitions, first, forest.forest_prior(base, one), ["x"], FOREST_DOMAINS)
    assert abs(state.elbo - first.elbo) < 1e-3 * abs(first.elbo)
    again = forest.fit_forests(two_partitions, [state.model], [forest.forest_prior(base, one)], ["x"], FOREST_DOMAINS, 1)[0]
    assert state.elbo <= again.elbo + 1e-6 * abs(again.elbo)  # the bound of the sums, exact without another pass
    two = forest.Structure({"p": 2, "q": 2}, {}, {c: "p" if c[0] == "a" else "q" if c[0] == "b" else forest.ALONE for c in [*FOREST_DOMAINS, "x"]})
    prior = forest.forest_prior(base, two)
    start = forest.forest_start(prior, rng, state.model)
    latents, nodes = forest.local_change(one, two)
    assert latents == ("q",) and set(nodes) == {"q", "b0", "b1", "b2"}
    local = forest.fit_locally(state, [start], [prior], ["x"], FOREST_DOMAINS, 200, 1e-9)[0]
    whole = forest.fit_forests(two_partitions, [start], [prior], ["x"], FOREST_DOMAINS, 200, 1e-9)[0]
    assert abs(local.elbo - whole.elbo) < 1e-6 * abs(whole.elbo)
    assert all(b - a > -1e-7 * abs(a) for a, b in zip(local.trace, local.trace[1:]))
    # other moves: fewer values are read, and global passes from there only add
    options = [*forest.change_cards(two), *forest.remove_latents(two), *forest.relocate(two)[:6], *forest.insert_latents(two)[:2], *forest.add_arcs(two)]
    state = forest.complete(two_partitions, whole, prior, ["x"], FOREST_DOMAINS)
    priors = [forest.forest_prior(base, s) for s in options]
    starts = [forest.forest_start(p, rng, state.model) for p in priors]
    tried = forest.fit_locally(state, starts, priors, ["x"], FOREST_DOMAINS, 4)
    for m, p in zip(tried, priors, strict=True):
        latents, nodes = forest.local_change(two, m.structure)
        assert len(forest.Local(m, p, latents, nodes, latents).columns()) < 7
    best = max(range(len(tried)), key=lambda i: tried[i].elbo)
    after = forest.fit_forests(two_partitions, [forest.replace(tried[best], elbo=-math.inf)], [priors[best]], ["x"], FOREST_DOMAINS, 30)[0]
    assert after.elbo > tried[best].elbo - 1e-6 * abs(after.elbo)


def forest_of(rows, base, structure, rng):
    prior = forest.forest_prior(base, structure)
    return forest.fit_forests(rows, [forest.forest_start(prior, rng)], [prior], ["x"], FOREST_DOMAINS, 40)[0]


def test_deltas_of_a_stream_are_those_of_its_table(spark, planted, tmp_path):
    domains = {"c": ["a", "b"]}
    prior = parameters.class_prior(planted, 2, ["x", "y"], domains)
    start = parameters._start(prior, np.random.default_rng(0))
    rows = planted.select("x", "y", "c", (F.col("row_id") % 5).alias("part"), "row_id")
    table = {r["batch"]: r for r in updates.batch_deltas(rows.withColumn("part", F.when(F.col("row_id") % 11 != 0, F.col("part"))), "part", prior, start, ["x", "y"], domains, 3).collect()}
    assert set(table) == set(range(5)) and sum(r["n"] for r in table.values()) == rows.filter("row_id % 11 <> 0").count()
    now = start
    for _ in range(3):
        now = parameters.m_step(parameters.e_step(rows.filter("part = 2 and row_id % 11 <> 0"), [now], ["x", "y"], domains)[0], prior)
    assert np.allclose(table[2]["delta"], updates.natural(now) - updates.natural(prior))
    # as a stream: one micro-batch per file; files hold whole batches, then one more brings rows of a batch that is known
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(5):
        rows.filter((F.col("part") == part) & (F.col("row_id") % 11 != 0)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("x double, y double, c string, part long, row_id long").option("maxFilesPerTrigger", 2).parquet(source)
    updates.run_deltas(updates.batch_deltas(stream, "part", prior, start, ["x", "y"], domains, 3), sink, str(tmp_path / "at"))
    got = spark.read.parquet(sink)
    assert {r["batch"]: r["n"] for r in got.collect()} == {k: r["n"] for k, r in table.items()}
    sums = [updates.natural(updates.add_deltas(d, prior)) for d in (got, spark.createDataFrame(list(table.values())))]
    assert np.allclose(*sums)
    updates.run_deltas(updates.batch_deltas(stream, "part", prior, start, ["x", "y"], domains, 3), sink, str(tmp_path / "at"))  # nothing new
    assert np.allclose(updates.natural(updates.add_deltas(spark.read.parquet(sink), prior)), sums[0])
    rows.filter("part = 2 and row_id % 11 = 0").coalesce(1).write.mode("append").parquet(source)
    updates.run_deltas(updates.batch_deltas(stream, "part", prior, start, ["x", "y"], domains, 3), sink, str(tmp_path / "at"))
    more = updates.add_deltas(spark.read.parquet(sink), prior)
    assert math.isclose(more.alpha.sum() - prior.alpha.sum(), rows.filter("row_id % 11 <> 0 or part = 2").count(), rel_tol=1e-9)
    assert updates.batch_deltas(rows.limit(0), "part", prior, start, ["x", "y"], domains).count() == 0


def test_drift_of_one_attribute_moves_its_weight_alone(spark, tmp_path):
    rng = np.random.default_rng(4)
    z = rng.integers(0, 2, 1600)
    x, y = np.where(z, 6, -6) + rng.normal(0, 1, 1600), np.where(z, 5, -5) + rng.normal(0, 1, 1600)
    y[1200:] += 60  # y drifts in the last batch
    rows = spark.createDataFrame([(i, float(a), float(b), i // 400) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x double, y double, part int")
    prior = parameters.class_prior(rows, 2, ["x", "y"], {})
    start = parameters._start(prior, np.random.default_rng(0))
    for kind in ("exponential", "normal"):
        state = updates.StateTable(str(tmp_path / kind))
        on_batch = updates.updater(state, prior, start, ["x", "y"], {}, "drift", weights="each", weight_prior=kind, steps=10)
        updates.prequential(rows, "part", on_batch, state)
        calm, moved = (r["weights"] for r in state.rows(spark)[2:])
        assert calm["x"] > 0.8 and calm["y"] > 0.8 and moved["x"] > 0.8 and moved["y"] < 0.3
    assert math.isclose(updates.drift_weight(0.0), 0.5, abs_tol=1e-6) and math.isclose(updates.drift_weight(3.0), 1 / (1 - math.exp(-3)) - 1 / 3, abs_tol=1e-5)
    assert math.isclose(updates.drift_weight(0.0, "normal", 0.5, 0.2), 0.5, abs_tol=1e-6) and updates.drift_weight(1e4, "normal") > 0.99 and math.isclose(updates.drift_weight(-1e4), 1e-4)
    # a normal weight far from its ends is a normal one: its mean is centre + push * spread ** 2
    assert math.isclose(updates.drift_weight(4.0, "normal", 0.4, 0.05), 0.41, abs_tol=1e-4)


def test_forests_learn_from_batches(spark, two_partitions, tmp_path):
    structure = forest.Structure({"p": 2, "q": 2}, {"q": "p"}, {**{c: "p" if c[0] == "a" else "q" for c in FOREST_DOMAINS}, "x": forest.ALONE})
    base = parameters.class_prior(two_partitions, 1, ["x"], FOREST_DOMAINS)
    prior = forest.forest_prior(base, structure)
    start = forest.forest_start(prior, np.random.default_rng(0))
    flat = updates.natural(start)
    assert np.allclose(updates.natural(updates.from_natural(flat, prior)), flat) and sum(updates.node_sizes(prior).values()) == len(flat)
    whole = updates.update(two_partitions, prior, start, ["x"], FOREST_DOMAINS, steps=6)
    one = updates.StateTable(str(tmp_path / "one"))
    out = updates.prequential(two_partitions.withColumn("part", F.lit(3)), "part", updates.updater(one, prior, start, ["x"], FOREST_DOMAINS, steps=6), one).collect()
    assert [r["batch_id"] for r in out] == [3] and np.allclose(one.rows(spark)[0]["natural"], updates.natural(whole))
    three = updates.StateTable(str(tmp_path / "three"))
    rows = two_partitions.withColumn("part", (F.col("k") % 3).cast("int"))
    out = updates.prequential(rows, "part", updates.updater(three, prior, start, ["x"], FOREST_DOMAINS, steps=12), three).orderBy("batch_id").collect()
    assert out[0]["predictive"] is None and out[2]["predictive"] > out[1]["predictive"] - 60
    last = updates.from_natural(np.array(three.rows(spark)[-1]["natural"]), prior)
    assert math.isclose(sum(t.sum() for t in last.latents.values()) - sum(t.sum() for t in prior.latents.values()), 3000, rel_tol=1e-9)
    model = last.expected(FOREST_DOMAINS)
    labels = scoring.forest_posterior(two_partitions, model).withColumn("z", F.when(F.col("p_probs")[1] > 0.5, "1").otherwise("0"))
    same = labels.filter("z = a0").count() / 1500
    assert max(same, 1 - same) > 0.85


def test_given_parameters_are_held(spark, planted, tmp_path):
    fixed = {"x": parameters.known_gaussian([(-4.0, 1.0), (3.0, 0.5)]), "c": parameters.known_discrete([[0.9, 0.1], [0.2, 0.8]])}
    fit = parameters.fit_latent_class(planted, 2, ["x", "y"], {"c": ["a", "b"]}, candidates=2, steps=20, fixed=fixed)[2].expected()
    lightest = 0 if fit.gaussian["x"][0][0] < 0 else 1
    assert lightest == 0 and np.allclose(fit.gaussian["x"], [(-4.0, 1.0), (3.0, 0.5)]) and math.isclose(fit.discrete["c"][0]["a"], 0.9)
    assert abs(fit.weights[0] - 0.3) < 0.04 and abs(fit.gaussian["y"][1][0] - 6) < 0.2  # the free ones follow
    prior = parameters.class_prior(planted, 2, ["x", "y"], {"c": ["a", "b"]})
    state = updates.StateTable(str(tmp_path / "held"))
    on_batch = updates.updater(state, prior, parameters._start(prior, np.random.default_rng(0)), ["x", "y"], {"c": ["a", "b"]}, steps=5, fixed=fixed)
    updates.prequential(planted.withColumn("part", F.col("row_id") % 2), "part", on_batch, state)
    last = updates.from_natural(np.array(state.rows(spark)[-1]["natural"]), prior)
    assert np.allclose(last.gaussian["x"][0], [-4.0, 3.0], atol=1e-6)
    with pytest.raises(ValueError, match="no such"):
        parameters.fit_latent_class(planted, 2, ["x"], {}, fixed={"y": fixed["x"]})


def test_islands_of_numbers_and_words(spark):
    rng = np.random.default_rng(12)
    n = 900
    u, v = rng.integers(0, 2, n), rng.integers(0, 2, n)
    flip = lambda z: np.where(rng.random(n) < 0.1, 1 - z, z)
    x = {f"x{i}": 4.0 * u + rng.normal(0, 1, n) for i in range(2)} | {f"y{i}": -3.0 * v + rng.normal(0, 1, n) for i in range(3)}
    rows = [(*[float(c[i]) if (i + k) % 11 else None for k, c in enumerate(x.values())], str(flip_u)) for i, flip_u in enumerate(flip(u))]
    df = spark.createDataFrame(rows, ", ".join([f"{c} double" for c in x] + ["w string"]))
    groups, models = search.group_attributes(df, {"w": ["0", "1"]}, list(x), candidates=2, steps=20)
    assert sorted(map(sorted, groups)) == [["w", "x0", "x1"], ["y0", "y1", "y2"]]
    assert [m.states for m in models] == [2, 2]
    found = next(m for m in models if "x0" in m.gaussian)
    assert sorted(np.round(found.gaussian["x0"][0])) == [0, 4]


def test_number_of_augmented_states_and_their_arc(spark):
    rng = np.random.default_rng(14)
    n = 1500
    z = rng.integers(0, 3, n)
    rows = [(float(6 * k + rng.normal()), float(-5 * k + rng.normal()), float(a := rng.normal() + 4 * k), float(2 * a + rng.normal(0, 0.3)), str(k if rng.random() < 0.8 else rng.integers(0, 3))) for k in z]
    df = spark.createDataFrame(rows, "x double, y double, a double, b double, c string")
    graph, score, states = search.select_augmented(df, ["x", "y", "a", "b"], {"c": ["0", "1", "2"]}, most=5, candidates=4, steps=30)
    assert states == 3 and all("latent" in graph[c] for c in ("x", "y", "a", "b", "c"))
    assert "a" in graph["b"] or "b" in graph["a"]
    assert not any(p in graph[c] for p, c in (("x", "y"), ("y", "x")))


def test_restarts_reach_the_same_best_fit(planted):
    both = [parameters.fit_latent_class(planted, 2, ["x", "y"], {"c": ["a", "b"]}, candidates=6, steps=40, restart=how, warm=2)[2] for how in ("pyramid", "random")]
    assert abs(both[0].elbo - both[1].elbo) < 1.0
    one = parameters.fit_latent_class(planted, 2, ["x", "y"], {"c": ["a", "b"]}, candidates=1, steps=40)[2]
    assert min(m.elbo for m in both) >= one.elbo - 0.5


def test_refining_and_rewiring_mends_a_wrong_start(spark, two_partitions):
    wrong = forest.Structure({"p": 2, "q": 2}, {}, {"a0": "p", "b0": "p", "b1": "p", "a1": "q", "a2": "q", "b2": "q"})
    start = forest.fit_latent_forest(two_partitions, wrong, (), FOREST_DOMAINS, candidates=2, steps=15)
    model = search.refine_and_rewire(two_partitions, "k", (), FOREST_DOMAINS, start, rounds=3, alpha=3, screen=3, keep=2, steps=12, seed=1)
    groups = {}
    for c, z in model.structure.of.items():
        groups.setdefault(z, set()).add(c)
    assert {"a0", "a1", "a2"} in groups.values() and {"b0", "b1", "b2"} in groups.values() and model.elbo > start.elbo


def test_a_planted_tree_is_found(spark):
    rng = np.random.default_rng(15)
    n = 2500
    u = rng.integers(0, 2, n)
    v = np.where(rng.random(n) < 0.15, 1 - u, u)
    flip = lambda z: np.where(rng.random(n) < 0.08, 1 - z, z)
    cols = {f"a{i}": flip(u) for i in range(3)} | {f"b{i}": flip(v) for i in range(3)}
    df = spark.createDataFrame([(i, *[str(c[i]) for c in cols.values()]) for i in range(n)], ", ".join(["k long", *[f"{c} string" for c in cols]]))
    counts = {}
    for strategy in ("tree", "phases"):
        counts[strategy] = []
        model = forest.learn_partitions(df, (), FOREST_DOMAINS, strategy, alpha=4, rounds=14, screen=3, keep=2, steps=15, tried=counts[strategy])
        s = model.structure
        tops = {s.of[c] for c in FOREST_DOMAINS}
        assert forest.ALONE not in tops and len(tops) == 2 and all(len({s.of[f"{g}{i}"] for i in range(3)}) == 1 for g in "ab")
        assert any(s.up.get(x) == y for x in tops for y in tops)  # the two are linked
    assert max(counts["phases"]) < max(counts["tree"])  # a round has fewer candidates


def test_pairs_of_groups_are_tested_as_by_themselves(spark):
    rows = [("a", "x")] * 8 + [("a", "y")] * 3 + [("b", "x")] * 2 + [("b", "y")] * 9 + [("c", "z")] * 4 + [("c", "x")] + [(None, "x"), ("a", None)]
    df = spark.createDataFrame(rows, "g string, c string")
    got = compare.chi2_pairwise(df, "g", "c")
    assert [(r["a"], r["b"]) for r in got] == [("a", "b"), ("a", "c"), ("b", "c")]
    for r in got:
        one = compare.chi2_independence(df.filter(F.col("g").isin(r["a"], r["b"])), "g", "c")
        assert r["dof"] == one["dof"] and math.isclose(r["chi2"], one["chi2"], rel_tol=1e-9) and math.isclose(r["p"], one["p"], rel_tol=1e-9)
    assert compare.chi2_pairwise(df.filter("g = 'a'"), "g", "c") == []
