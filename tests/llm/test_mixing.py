import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from partita.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        level = (total - sum(most * sizes[s] for s in full)) / (sum(w[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def words(text):
    return len((text or "").encode().split())


def test_targets_rates_and_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    out = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes, docs_of = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
        docs_of[r["source"]].append((r["doc_id"], words(r["text"])))
    targets = brute_targets(dict(sizes))
    for s, members in docs_of.items():
        got = [out[i] for i, _ in members]
        assert all(g["size"] == n and g["source_size"] == sizes[s] and math.isclose(g["target"], targets[s], rel_tol=1e-9) for g, (_, n) in zip(got, members))
        assert all(0 <= g["taken"] <= 2 * g["size"] and g["taken"] == g["copies"] * g["size"] for g in got)
        if targets[s] < 2 * sizes[s] * (1 - 1e-12):  # bisection of the tilt
            mean = sum(n for _, n in members) / sum(1 for _, n in members if n)
            low, high = -1e4, 1e4
            for _ in range(200):
                mid = (low + high) / 2
                total = sum(min(2.0, math.exp(min(50.0, mid * n / mean))) * n for _, n in members if n)
                low, high = (mid, high) if total < targets[s] else (low, mid)
            for g, (_, n) in zip(got, members):
                assert math.isclose(g["rate"], min(2.0, math.exp(min(50.0, low * n / mean))) if n else 0, rel_tol=1e-5, abs_tol=1e-7)
        # whole documents: within the least document that could still change
        assert abs(sum(g["taken"] for g in got) - targets[s]) <= max(0.03 * targets[s], min(n for _, n in members if n))
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in out.items()}


def test_edges(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 50, None), (5, "  ", "empty"), (6, "e f\x0bg\x1ch", "x"), (6, "e f\x0bg\x1ch", "x"), (None, "p q", "y")]
    docs = spark.createDataFrame([(*r, 7, 1.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 2), (1, 3), (2, 0), (3, 0), (4, 50), (5, 0), (6, 3), (6, 3)]
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def test_equal_rows_are_dealt_in_lots(spark):
    rows = [(None, "same words here now", "a")] * 9000 + [(i, "w " * (1 + i % 30), "a") for i in range(1500)] + [(5, None, "b")] * 700 + [(6, "one two", "b")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows)
    same = out[out["doc_id"].isna()]
    assert len(same) == 9000 and same["copies"].max() - same["copies"].min() <= 1 and same["rate"].nunique() == 1
    for _, g in out.groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 30 * (1 + len(g) // 400)
    assert out["copies"].between(0, 2).all() and (out[out["size"] == 0]["copies"] == 0).all()
    with pytest.raises(RuntimeError, match="settle"):
        mixing.balance(spark.createDataFrame([("a", 3, 5), ("a", 9, 2)], "source string, size long, n long"), spark.createDataFrame([("a", 33, 50.0)], "source string, source_size long, target double"), rounds=1)


def test_rows_are_taken_as_often_as_the_mix_says(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumns({"copies": F.lit(5), "turn": F.lit(6), "_copies": F.lit(7)})
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    taken = defaultdict(int)
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        taken[r["doc_id"]] += 1
    assert dict(taken) == {i: c for i, c in copies.items() if c}


def test_no_python_runs(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
