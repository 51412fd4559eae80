"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from partita.llm.common import spread_join, stored

#: Edges that a task contracts at once.
BLOCK = 500_000


def least_reached(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For nodes 0, 1, ... the least one that each reaches over the edges (a, b): roots are hung below smaller roots, then paths are shortened."""
    root = np.arange(nodes)
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while ((up := root[root]) != root).any():
            root = up


def contracted(edges: DataFrame, total: int) -> DataFrame:
    """(a, b), a > b: every task makes stars of the edges that it holds, BLOCK or so of the `total`: each node goes to the least one it reaches there."""
    kind = edges.schema["a"].dataType
    parts = [f.name for f in kind.fields] if isinstance(kind, StructType) else []
    flat = [(F.col(end)[p] if p else F.col(end)).alias(f"{end}{i}") for end in "ab" for i, p in enumerate(parts or [""])]
    rows = edges.repartition(max(1, -(-total // BLOCK))).select(*flat)
    names = [f"{end}{i}" for end in "ab" for i in range(len(parts) or 1)]

    def run(batches):
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        got = pd.concat(frames, ignore_index=True)
        half = len(names) // 2
        both = pd.concat([got[names[:half]].set_axis(range(half), axis=1), got[names[half:]].set_axis(range(half), axis=1)], ignore_index=True)
        number = both.groupby(list(range(half)), sort=True).ngroup().to_numpy()
        first = np.zeros(number.max() + 1, dtype=np.int64)
        first[number] = np.arange(len(number))
        root = least_reached(number[: len(got)], number[len(got) :], len(first))
        moved = np.flatnonzero(root != np.arange(len(root)))
        out = pd.concat([both.iloc[first[moved]].reset_index(drop=True), both.iloc[first[root[moved]]].reset_index(drop=True)], axis=1)
        yield out.set_axis(names, axis=1)

    done = rows.mapInPandas(run, rows.schema)
    whole = lambda end: F.struct(*[F.col(f"{end}{i}").alias(p) for i, p in enumerate(parts)]) if parts else F.col(f"{end}0")
    return done.select(whole("a").alias("a"), whole("b").alias("b"))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over (a, b), a > b. Large: each node's larger neighbours go to its least neighbour; small: the smaller ones do."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    joined = spread_join(pairs, least, ["u"], total)
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.filter(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that a node reaches; only nodes with an edge are listed.

    edges: (a, b) of any orderable type; loops, null ends, repeated and turned edges are allowed. Every task first makes stars of a block of edges. Where one
    block holds all that is left, that is the answer; else alternating large and small star steps follow: each is an aggregate with partial sums and a join
    back, in which hubs (nodes with so many edges that there can be few of them) are broadcast, so none is gathered in one task. Every round is
    written to the shared folder; the driver sees a count and a checksum. An empty table gives an empty table.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.select(high.alias("a"), low.alias("b")).filter("a > b").distinct(), "edges")
    sign = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    total = now.count()
    if total:
        now = stored(contracted(now, total), "edges")
    before = sign(now) if total > BLOCK else None
    for _ in range(most_rounds if before else 0):
        if before[0] <= BLOCK:
            now = stored(contracted(now, before[0]), "edges")
            break
        now = stored(_star(stored(_star(now, True, before[0]), "edges"), False, before[0]), "edges")
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        if before:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)
