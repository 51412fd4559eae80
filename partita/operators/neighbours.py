"""Exact nearest neighbours: cells of a tree of medians, bounds that prove which cells a query can leave out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.sources.scratch import stored

#: metric -> distance from gaps (an array whose last axis is the dimensions).
METRICS = {
    "euclidean": lambda d: np.sqrt((d * d).sum(axis=-1)),
    "manhattan": lambda d: np.abs(d).sum(axis=-1),
    "chebyshev": lambda d: np.abs(d).max(axis=-1),
}
#: Sampled points of a cell, points of a box within a task, and numbers that a task compares at once.
SAMPLED, BOX, AT_ONCE = 64, 128, 2_000_000


def _median_splits(x: np.ndarray, parts: int) -> list[tuple[int, float]]:
    """Nodes of a tree in breadth-first order: (dimension of widest spread, median of it); (-1, 0) where points are too few or equal. A left child is at 2 i + 1."""
    depth = max(0, int(np.ceil(np.log2(max(parts, 1)))))
    nodes, groups = [], [np.arange(len(x))]
    for _ in range(depth):
        after = []
        for rows in groups:
            some = x[rows]
            spread = some.max(axis=0) - some.min(axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
            d = int(spread.argmax()) if len(spread) else 0
            if not len(spread) or not spread[d] > 0:
                nodes.append((-1, 0.0))
                after += [rows, rows[:0]]
                continue
            cut = float(np.median(some[:, d]))
            if not (some[:, d] < cut).any():  # more than half are equal
                cut = float(some[some[:, d] > cut, d].min())
            nodes.append((d, cut))
            left = some[:, d] < cut
            after += [rows[left], rows[~left]]
        groups = after
    return nodes


@dataclass
class Cells:
    """A partition of space by median splits, and for each of its cells the box of the points in it (empty cells: from inf to -inf) and their number."""

    nodes: list[tuple[int, float]]
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    sizes: np.ndarray | None = None

    @property
    def depth(self) -> int:
        return (len(self.nodes) + 1).bit_length() - 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(x), dtype=np.int64)
        dims, cuts = np.array([n[0] for n in self.nodes] or [0]), np.array([n[1] for n in self.nodes] or [0.0])
        for _ in range(self.depth):
            d = dims[at]
            right = (d >= 0) & (x[np.arange(len(x)), np.maximum(d, 0)] >= cuts[at])
            at = 2 * at + 1 + right
        return at - len(self.nodes)

    def apart(self, x: np.ndarray, metric: str) -> np.ndarray:
        """Points by cells: no point of the cell is nearer; infinite for empty cells."""
        total = np.zeros((len(x), len(self.low)))
        for d in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, d] - x[:, d : d + 1], x[:, d : d + 1] - self.high[:, d]), 0)
            total = np.maximum(total, gap) if metric == "chebyshev" else total + (gap * gap if metric == "euclidean" else gap)
        total = np.sqrt(total) if metric == "euclidean" else total
        total[:, self.sizes == 0] = np.inf
        return total


def local_cells(x: np.ndarray) -> tuple[Cells, np.ndarray]:
    """Cells of about BOX points over the points at hand, and the cell of each."""
    cells = Cells(_median_splits(x, len(x) // BOX))
    at = cells.place(x)
    n = len(cells.nodes) + 1
    cells.low, cells.high = np.full((n, x.shape[1]), np.inf), np.full((n, x.shape[1]), -np.inf)
    np.minimum.at(cells.low, at, x)
    np.maximum.at(cells.high, at, x)
    cells.sizes = np.bincount(at, minlength=n)
    return cells, at


def _reaches(bound: np.ndarray) -> np.ndarray:
    """Bounds widened by more than the rounding of distances."""
    return bound * (1 + 1e-9)


class LocalSearch:
    """Points of one task, searched through boxes."""

    def __init__(self, x: np.ndarray, metric: str) -> None:
        self.cells, at = local_cells(x)
        self.order = np.argsort(at, kind="stable")
        self.x, self.metric = x[self.order], metric
        self.ends = np.cumsum(self.cells.sizes)

    def _rows(self, cell: int) -> slice:
        return slice(self.ends[cell] - self.cells.sizes[cell], self.ends[cell])

    def _gaps(self, q: np.ndarray, rows: slice) -> np.ndarray:
        return METRICS[self.metric](q[:, None, :] - self.x[None, rows, :])

    def bound(self, q: np.ndarray, k: int, known: np.ndarray) -> np.ndarray:
        """For each query a distance within which k points lie for certain: that of the k-th in the nearest box, or `known` if that is less."""
        out, apart = known.copy(), self.cells.apart(q, self.metric)
        near = apart.argmin(axis=1)
        for c in np.unique(near):
            rows, which = self._rows(c), np.flatnonzero(near == c)
            n = rows.stop - rows.start
            if n >= k:
                for some in np.array_split(which, max(1, which.size * n * q.shape[1] // AT_ONCE)):
                    out[some] = np.minimum(out[some], np.partition(self._gaps(q[some], rows), k - 1, axis=1)[:, k - 1])
        return out

    def within(self, q: np.ndarray, bound: np.ndarray):
        """(query, point, distance) arrays of all points within each query's bound, a few at a time."""
        apart = self.cells.apart(q, self.metric)
        for c in range(len(self.cells.sizes)):
            if not self.cells.sizes[c]:
                continue
            rows, which = self._rows(c), np.flatnonzero(apart[:, c] <= _reaches(bound))
            for some in np.array_split(which, max(1, which.size * (rows.stop - rows.start) * q.shape[1] // AT_ONCE)) if len(which) else ():
                d = self._gaps(q[some], rows)
                i, j = np.nonzero(d <= bound[some, None])
                yield some[i], self.order[rows.start + j], d[i, j]


def _stack(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors as the bytes of doubles; rows without a key, and vectors that are null, empty or hold null or non-finite components, are left out."""
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), x.alias("x")).filter(F.col("key").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "v": [(np.asarray(v, dtype="<f8") + 0.0).tobytes() for v in b["x"]]})

    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, v binary")


def _fit_cells(points: DataFrame, total: int, cell: int, most: int) -> Cells:
    """Median splits from a bounded sample (SAMPLED points a cell, those with the smallest hashes), boxes and sizes from all points."""
    cells = max(1, min(most, -(-total // cell)))
    some = points.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLED * cells).collect() if cells > 1 else []
    tree = Cells(_median_splits(_stack(pd.Series([r["v"] for r in some])), cells) if some else [])

    def run(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            if len(b):
                x = _stack(b["v"])
                at = tree.place(x)
                for c in np.unique(at).tolist():
                    part = x[at == c]
                    low[c], high[c] = np.minimum(low.get(c, np.inf), part.min(axis=0)), np.maximum(high.get(c, -np.inf), part.max(axis=0))
                    n[c] = n.get(c, 0) + len(part)
        for c in n:
            yield pd.DataFrame({"cell": c, "d": np.arange(len(low[c])), "low": low[c], "high": high[c], "n": n[c]})

    found = points.select("v").mapInPandas(run, "cell int, d int, low double, high double, n long").groupBy("cell", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()
    count, dims = len(tree.nodes) + 1, int(found["d"].max()) + 1
    tree.low, tree.high, tree.sizes = np.full((count, dims), np.inf), np.full((count, dims), -np.inf), np.zeros(count, dtype=np.int64)
    c, d = found["cell"].to_numpy(), found["d"].to_numpy()
    tree.low[c, d], tree.high[c, d] = found["low"], found["high"]
    tree.sizes[c] = found["n"]
    return tree


def _visit(asked: DataFrame, placed: DataFrame, parts: DataFrame, block: int, meet, schema: str) -> DataFrame:
    """asked (cell, v, bound) meets placed (cell, v, keys) by cell: a cell with many points is cut into parts, its queries into blocks, so a task gets `block` of each."""
    sized = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(F.broadcast(parts), "cell")  # a row per cell at most
    sized = F.broadcast(sized)
    deal = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sized, "cell").select("cell", every("parts").alias("part"), deal("blocks").alias("block"), "v", "bound")
    right = placed.join(sized, "cell").select("cell", deal("parts").alias("part"), every("blocks").alias("block"), "v", "keys")
    on = ["cell", "part", "block"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, schema)


def knn_join(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean", block: int = 65_536, cell: int = 8192, most: int = 1024) -> DataFrame:
    """(key_q, key, distance, rank): the k nearest rows of base for each query row, rows of the query's own key excluded, ties by key. Exact.

    Equal vectors are one point with its k + 1 smallest keys, and one query, so copies cost nothing. Points fall into cells of
    about `cell` (at most `most`), split at medians of a bounded sample, whose true boxes are taken from all points. A query first
    visits its own cell: the distance of its (k + 1)-th point there bounds what it looks for. Then it visits the cells whose box comes
    within that bound, so where vectors cluster, or have few dimensions, a query is sent to a few cells whatever the table's size; in many dimensions
    without structure no exact index can leave out much, and queries go to most cells. A task gets `block` points and queries at most, and searches
    them through boxes of its own.

    Null keys, and vectors that are null, empty or have null or non-finite components, are left out; vectors of different lengths raise an error.
    Repeated keys of base give one row each; repeated keys of queries as well.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    kind, spark = base.schema[key].dataType.simpleString(), base.sparkSession
    asked_rows, base_rows = stored(vectors(queries, key, vector), "knn-queries"), vectors(base, key, vector)
    need = k + 1
    first = F.row_number().over(Window.partitionBy("v").orderBy("key"))
    points = base_rows.withColumn("_r", first).filter(F.col("_r") <= need).groupBy("v").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    points = stored(points, "knn-points")
    one = points.agg(F.count("*"), F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    other = asked_rows.agg(F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    widths = {w for w in (*one[1:], *other) if w is not None}
    if len(widths) > 1:
        raise ValueError("vectors differ in length")
    if not one[0] or other[0] is None:
        return spark.createDataFrame([], f"key_q {kind}, key {kind}, distance double, rank int")
    cells = _fit_cells(points, one[0], cell, most)
    shared = spark.sparkContext.broadcast(cells)  # boxes of `most` cells at most

    def place(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell": shared.value.place(_stack(b["v"])), "v": b["v"], "keys": b["keys"]})

    placed = stored(points.mapInPandas(place, f"cell int, v binary, keys array<{kind}>"), "knn-cells")
    parts = spark.createDataFrame([(c, -(-int(n) // block)) for c, n in enumerate(cells.sizes) if n], "cell int, parts int")
    alone = asked_rows.select("v").distinct()

    def start(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                yield pd.DataFrame({"cell": shared.value.apart(_stack(part["v"]), metric).argmin(axis=1), "v": part["v"], "bound": np.inf})

    def bounds(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"v": [], "bound": []})
        got = LocalSearch(_stack(p["v"]), metric)
        out = [got.bound(_stack(part["v"]), need, part["bound"].to_numpy()) for part in _portions(q, got)]
        return pd.DataFrame({"v": q["v"], "bound": np.concatenate(out)})

    def spread(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                bound = part["bound"].to_numpy()
                i, c = np.nonzero((shared.value.apart(_stack(part["v"]), metric) <= _reaches(bound)[:, None]) & (shared.value.sizes > 0))
                yield pd.DataFrame({"cell": c, "v": part["v"].to_numpy()[i], "bound": bound[i]})

    schema = "cell int, v binary, bound double"
    if len(cells.sizes) > 1:
        bounded = _visit(alone.mapInPandas(start, schema), placed, parts, block, bounds, "v binary, bound double").groupBy("v").agg(F.min("bound").alias("bound"))
        asked = stored(bounded.mapInPandas(spread, schema), "knn-visits")
    else:
        asked = alone.select(F.lit(0).alias("cell"), "v", F.lit(float("inf")).alias("bound"))

    def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            got, many = LocalSearch(_stack(p["v"]), metric), np.array([len(x) for x in p["keys"]])
            flat = np.concatenate([np.asarray(x) for x in p["keys"]])
            starts = np.append(0, np.cumsum(many))
            order = np.unique(flat, return_inverse=True)[1]  # numbers in the order of keys
            for part in _portions(q, got):
                x = _stack(part["v"])
                bound = got.bound(x, need, part["bound"].to_numpy())
                hits = list(got.within(x, bound))
                if not hits:
                    continue
                i, j, d = map(np.concatenate, zip(*hits, strict=True))
                each = many[j]
                at = np.repeat(starts[j] - np.append(0, np.cumsum(each)[:-1]), each) + np.arange(each.sum())
                i, d = np.repeat(i, each), np.repeat(d, each)
                o = np.lexsort((order[at], d, i))
                i, d, at = i[o], d[o], at[o]
                begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                top = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < need
                out.append(pd.DataFrame({"v": part["v"].to_numpy()[i[top]], "key": flat[at[top]], "distance": d[top]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"v": [], "key": [], "distance": []})

    met = _visit(asked, placed, parts, block, meet, f"v binary, key {kind}, distance double")
    place_of = F.row_number().over(Window.partitionBy("v").orderBy("distance", "key"))
    best = met.withColumn("_r", place_of).filter(F.col("_r") <= need).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("distance", "key"))).alias("near"))
    others = asked_rows.withColumnRenamed("key", "key_q").join(best, "v").select("key_q", F.slice(F.filter("near", lambda s: s["key"] != F.col("key_q")), 1, k).alias("near"))
    return others.select("key_q", F.posexplode("near").alias("_p", "_s")).select("key_q", F.col("_s.key").alias("key"), F.col("_s.distance").alias("distance"), (F.col("_p") + 1).cast("int").alias("rank"))


def _portions(q: pd.DataFrame, search: LocalSearch):
    """Parts of the queries, so small that all hits of a part fit in memory even if all points are equally far."""
    step = max(1, min(1024, AT_ONCE // max(1, len(search.x))))
    for at in range(0, len(q), step):
        yield q.iloc[at : at + step]
