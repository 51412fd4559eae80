import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.operators import dependence, parameters, scoring
from partita.operators.neighbours import METRICS, Cells, LocalSearch, _median_splits, _reaches, knn_join, local_cells


def brute(queries, base, k, metric):
    out = []
    for kq, vq in queries:
        near = sorted((float(METRICS[metric](np.array(vq) - np.array(v))), kb) for kb, v in base if kb != kq)
        out += [(kq, kb, round(d, 9), r) for r, (d, kb) in enumerate(near[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r["key_q"], r["key"], round(r["distance"], 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("dims", "n", "metric", "grid"), [(2, 700, "euclidean", 0), (3, 500, "chebyshev", 4), (5, 400, "manhattan", 0), (1, 400, "euclidean", 7), (2, 300, "manhattan", 1)])
def test_neighbours_equal_brute_force(spark, dims, n, metric, grid):
    rng = np.random.default_rng(n)
    x = rng.integers(0, grid, (n, dims)).astype(float) if grid else rng.standard_normal((n, dims))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(None, [0.0] * dims), (-1, None), (-2, [float("nan")] * dims), (-3, []), (-4, [None] * dims), (-5, [float("inf")] * dims)]
    df = spark.createDataFrame(rows + bad, "id long, v array<double>")
    want = brute([r for r in rows if r[0] % 3 == 0], rows, 4, metric)
    for options in ({}, {"cell": 40, "block": 25}, {"cell": 16, "most": 32}):
        assert got(knn_join(df.filter("id is null or id % 3 = 0"), df, "id", "v", 4, metric, **options)) == want


def test_text_keys_few_rows_and_empty_tables(spark):
    rows = [("b", [0.0]), ("a", [0.0]), ("b", [1.0]), ("c", [5.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    assert got(knn_join(df, df, "id", "v", 5)) == sorted(
        [("b", "a", 0.0, 1), ("b", "c", 5.0, 2), ("a", "b", 0.0, 1), ("a", "b", 1.0, 2), ("a", "c", 5.0, 3), ("b", "a", 1.0, 1), ("b", "c", 4.0, 2), ("c", "b", 4.0, 1), ("c", "a", 5.0, 2), ("c", "b", 5.0, 3)]
    )
    assert knn_join(df.limit(0), df, "id", "v", 2).count() == knn_join(df, df.limit(0), "id", "v", 2).count() == 0
    with pytest.raises(ValueError):
        knn_join(df, df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0))), "id", "v", 2)
    with pytest.raises(ValueError):
        knn_join(df, df, "id", "v", 2, "cosine")


def test_a_query_visits_few_cells_whatever_the_size():
    visits = []
    for n in (20_000, 160_000):
        x = np.random.default_rng(1).standard_normal((n, 2))
        cells = Cells(_median_splits(x[: 64 * (n // 1000)], n // 1000))
        at = cells.place(x)
        count = len(cells.nodes) + 1
        cells.low, cells.high, cells.sizes = np.full((count, 2), np.inf), np.full((count, 2), -np.inf), np.bincount(at, minlength=count)
        np.minimum.at(cells.low, at, x)
        np.maximum.at(cells.high, at, x)
        q = x[:400]
        own = cells.place(q)
        bound = np.array([np.partition(METRICS["euclidean"](x[at == c] - v), 5)[5] for c, v in zip(own, q, strict=True)])
        visits.append((cells.apart(q, "euclidean") <= _reaches(bound)[:, None]).sum(axis=1).mean())
    assert max(visits) < 1.6 and visits[1] < 1.2 * visits[0]


def test_boxes_of_a_task_leave_most_points_out():
    x = np.random.default_rng(2).standard_normal((20_000, 2))
    search = LocalSearch(x, "euclidean")
    q = x[:300]
    bound = search.bound(q, 6, np.full(300, np.inf))
    hits = list(search.within(q, bound))
    i, j, d = map(np.concatenate, zip(*hits, strict=True))
    assert (np.bincount(i, minlength=300) >= 6).all() and np.allclose(d, METRICS["euclidean"](q[i] - x[j]))
    met = (search.cells.apart(q, "euclidean") <= _reaches(bound)[:, None]) @ search.cells.sizes
    assert met.mean() < 0.03 * len(x)
    cells, at = local_cells(np.zeros((500, 3)))
    assert cells.sizes.sum() == 500 and len(np.unique(at)) == 1


def test_noise_parts_ties(spark):
    rows = spark.createDataFrame([(i, float(i % 3), float(i % 2), float(i)) for i in range(300)], "id long, x double, y double, z double")
    assert dependence.mutual_info_continuous(rows, "id", "x", "y") > 3  # ties without noise: nearly independent columns, a nonsensical estimate
    assert dependence.mutual_info_continuous(rows, "id", "x", "y", jitter=1e-10) < 0.2
    once, again = (dependence.jittered(rows, "id", ["x"], 1e-10, 5).orderBy("id").toPandas()["x"] for _ in range(2))
    assert (once == again).all() and len(set(once)) == 300 and (abs(once - [i % 3 for i in range(300)]) < 1e-8).all()


def test_null_labels_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "b")], "id long, z string")
    assert sorted(map(tuple, scoring.order_states(rows, "z").collect())) == [(1, 0), (2, None), (3, 1), (4, 1)]


def test_names_with_separators_are_told_apart(spark):
    trees = spark.createDataFrame([("s", "p", "x|y"), ("t", "p", "x"), ("t", "p", "y"), ("u", "p:x", "y"), ("v", "p", "x:y")], "model string, parent string, child string")
    found = {(r["a"], r["b"]): r["distance"] for r in dependence.robinson_foulds(trees).collect()}
    assert set(found.values()) == {1.0} and len(found) == 6


def test_mixture_of_no_complete_row_is_refused(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    with pytest.raises(ValueError, match="no row"):
        parameters.fit_mixture(rows, 2, ["x", "y"])
