import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from partita.llm import queries
from partita.llm.hard_negatives import mine, pack_planes, planes_scores, subset_sums, unpack_planes

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score int"


def brute(rows, every, positives=5, negatives=5, low=80, high=100):
    """rows: (vec_id, whole components, label)."""
    out = []
    for a, va, la in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb) for b, vb, lb in rows if b != a)
        for ps, p, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [x for x in scored if x[2] != la and low * -ps <= 100 * -x[0] <= high * -ps]
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_planes_hold_numbers_and_scores():
    rng = np.random.default_rng(3)
    for low, high, planes in ((-256, 257, 10), (-1, 1, 1), (0, 2, 2), (-(2**40), 2**40, 42)):
        v, a = rng.integers(low, high, (50, 24)), rng.integers(low, high, (7, 24))
        packed = pack_planes(v, planes)
        assert (unpack_planes(packed) == v).all()
        octets = packed.transpose(1, 2, 0).astype(np.intp)
        with np.errstate(over="ignore"):
            assert (planes_scores(subset_sums(a, np.int64), octets) == v @ a.T).all()


def test_query_matches_brute_force_and_sql(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], [int(np.floor(256 * float(x))) for x in r["embedding"]], label))
    found = got(queries.op11_four_russians(spark, sf))
    assert found == brute(rows, 100)
    con = duckdb.connect()
    path = f"{sf}/embeddings.parquet"
    con.execute(f"create view embeddings as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    sql = con.execute(queries.ORACLE_SQL["op11_four_russians"]).df()
    assert sorted(map(tuple, sql[["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]].astype(int).to_numpy().tolist())) == found


def test_many_blocks_agree_with_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 11) / 256).tolist(), int(rng.integers(0, 3)) if i % 3 else 0) for i in range(0, 3000, 5)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    want = brute([(i, [int(np.floor(256 * x)) for x in np.array(v, dtype=np.float32).astype(float)], lab) for i, v, lab in rows], 50)
    assert len(want) > 500  # with many ties: components are -3 to 3
    anchors = F.col("vec_id") % 50 == 0
    assert got(mine(df, anchors)) == want
    assert got(mine(df, anchors, chunk=70, block=9)) == want
    assert got(mine(df, anchors, negatives=3, low=50, high=90, chunk=200)) == brute([(i, [int(np.floor(256 * x)) for x in np.array(v, dtype=np.float32).astype(float)], lab) for i, v, lab in rows], 50, negatives=3, low=50, high=90)


def test_edges_nulls_repeats_ties_lengths_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5], 2), (3, [], 1), (4, [0.0, 0.0], 2), (5, [0.5, 0.24], 2), (6, [0.5, 0.24], 2), (7, [-0.5, 300.0], 3), (8, [0.45, 0.25, 0.5], 2)]
    bad = [(10, None, 1), (11, [0.5, None], 1), (12, [nan, 0.5], 1), (13, [inf, 0.5], 1), (14, [0.5, 0.25], None), (None, [0.5, 0.25], 1), (15, [1e30, 0.0], 2)]
    repeated = [(1, [0.5, 0.25], 1), (5, [0.5, 0.24], 2), (0, [0.9, 0.9], 2)]  # the row with the smaller label counts
    df = spark.createDataFrame([(*r, 1, 2) for r in good + bad + repeated], SCHEMA)
    width = max(len(v) for _, v, _ in good)
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in good]
    found = got(mine(df, F.col("vec_id") % 100 == 0))
    assert found == brute(whole, 100) and len(found) > 3
    assert got(mine(df.limit(0), F.col("vec_id") % 100 == 0)) == []
    assert got(mine(df.filter("vec_id > 9"), F.col("vec_id") % 100 == 0)) == []
    alone = spark.createDataFrame([(0, [1.0], 1, 0, 0)], SCHEMA)
    assert got(mine(alone, F.col("vec_id") % 100 == 0)) == []
    same = spark.createDataFrame([(i, [0.5] * 9, i % 2, 0, 0) for i in range(400)] * 2, SCHEMA)
    assert got(mine(same, F.col("vec_id") % 100 == 0, chunk=50, block=2)) == brute([(i, [128] * 9, i % 2) for i in range(400)], 100)
