"""Approximate nearest neighbours by adaptive dimension scans of inverted lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partita.llm.common import stored

#: Dimensions of a column block; queries and rows that are compared at once.
COLUMNS, QUERIES, ROWS = 16, 64, 2048


def usable(vector: Column) -> Column:
    """Not null, not empty, every component present and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """A rotation, unit centroids in rotated space, and how many rows each list has."""

    rotation: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotation


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def vectors(base: DataFrame) -> DataFrame:
    """(vec_id, x): usable rows, vectors as the bytes of doubles."""
    rows = base.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "x": [np.asarray(v, dtype="<f8").tobytes() for v in b["embedding"]]})

    return rows.filter("vec_id is not null").mapInPandas(run, "vec_id long, x binary")


def fit(rows: DataFrame, width: int, lists: int = 64, rows_each: int = 64, seed: int = 11) -> Index | None:
    """An index over vectors() rows of `width` bytes, its centroids fitted on at most 128 rows a list: those with the smallest hashed id.

    The list count shrinks for small tables so that a list has about `rows_each` sampled rows. None without rows.
    """
    some = rows.filter(F.octet_length("x") == width).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(128 * lists).collect()
    if not some:
        return None
    x = _unit(np.stack([np.frombuffer(r["x"], dtype="<f8") for r in some]))
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    z = x @ rotation
    c = z[rng.permutation(len(z))[: max(1, min(lists, len(z) // rows_each))]]
    for _ in range(10):
        own = (z @ c.T).argmax(axis=1)
        c = _unit(np.stack([z[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return Index(rotation, c, np.zeros(len(c), dtype=np.int64))


def _bound(best: np.ndarray, seen: int, dims: int, doubt: float) -> np.ndarray:
    """The partial distance over `seen` of `dims` rotated dimensions up to which a candidate may still beat distance `best`.

    Random rotation makes a scaled partial distance a fair estimate; `doubt` sets the confidence of the test.
    """
    return best * (1 + doubt / np.sqrt(seen)) ** 2 * seen / dims if seen < dims else best * (1 + 1e-9) + 1e-12


class Scan:
    """Queries against the lists of one shard: each query keeps its k smallest distances so far from list to list."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int, doubt: float) -> None:
        self.q, self.own, self.k, self.doubt = q, own, k, doubt
        self.best = np.full((len(q), k), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.work = 0  # partial distances over a block that were computed

    def meet(self, which: np.ndarray, z: np.ndarray, ids: np.ndarray, first: int) -> None:
        """Queries `which` scan the rows z (numbered from `first`): after each column block those too far are abandoned."""
        dims = z.shape[1]
        for a in range(0, len(which), QUERIES):
            some = which[a : a + QUERIES]
            for b in range(0, len(z), ROWS):
                x = z[b : b + ROWS]
                q, c = self.q[some, :COLUMNS], x[:, :COLUMNS]
                part = np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (q @ c.T), 0)
                seen = min(COLUMNS, dims)
                i, j = np.nonzero(part <= _bound(self.best[some, -1], seen, dims, self.doubt)[:, None])
                self.work += part.size
                away = self.own[some[i]] != ids[b + j]
                i, j = i[away], j[away]
                part = part[i, j]
                for at in range(COLUMNS, dims, COLUMNS):
                    d = x[j, at : at + COLUMNS] - self.q[some[i], at : at + COLUMNS]
                    self.work += len(i)
                    part = part + np.einsum("ij,ij->i", d, d)
                    keep = part <= _bound(self.best[some[i], -1], min(at + COLUMNS, dims), dims, self.doubt)
                    i, j, part = i[keep], j[keep], part[keep]
                if len(i):
                    self._note(some[i], first + b + j, part)

    def _note(self, query: np.ndarray, row: np.ndarray, distance: np.ndarray) -> None:
        self.found.append((query, row, distance))
        order = np.lexsort((distance, query))
        query, distance = query[order], distance[order]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        top = place < self.k
        new = np.full((len(start), self.k), np.inf)
        new[np.repeat(np.arange(len(start)), np.diff(np.append(start, len(query))))[top], place[top]] = distance[top]
        who = query[start]
        self.best[who] = np.sort(np.hstack([self.best[who], new]), axis=1)[:, : self.k]

    def survivors(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every pair that the final k-th distances leave."""
        if not self.found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        query, row, distance = map(np.concatenate, zip(*self.found, strict=True))
        keep = distance <= _bound(self.best[query, -1], 1, 1, self.doubt)
        return query[keep], row[keep]


def shards(sizes: np.ndarray, chunk: int) -> list[tuple[int, int, int]]:
    """(list, first shard, shards): lists side by side in shards of about `chunk` rows; a larger list is cut into several."""
    out, shard, held = [], 0, 0
    for j, n in enumerate(sizes.tolist()):
        if n > chunk:
            if held:
                shard, held = shard + 1, 0
            out.append((j, shard, -(-n // chunk)))
            shard += -(-n // chunk)
            continue
        if held and held + n > chunk:
            shard, held = shard + 1, 0
        out.append((j, shard, 1))
        held += n
    return out


def search(base: DataFrame, queries: Column, k: int = 5, probes: float = 0.6, fewest: int = 28, doubt: float = 2.1, lists: int | None = None, chunk: int | None = None, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine for each row of base (vec_id, embedding) that `queries` picks.

    Candidates are all rows but the query's own. There are as many lists as the root of the rows (64 to 1024) unless
    `lists` says so. A query scans the share `probes` of the lists, `fewest` at least (more where those hold too few rows). Lists lie side
    by side in shards of about `chunk` rows (by default two for each slot of the cluster, 65,536 rows at most); a list that is larger is cut by a
    hash of vec_id, so one with a third of all rows is spread. A query goes to a shard once, with up to `block` others: there its
    nearest list is compared first, and its k-th distance so far is carried from list to list, so later ones are left
    after the first column block. Scores are exact, on the original vectors in double precision; equal scores rank by vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose length
    is not the most common one of the table (of equals the longest), nor null ids. Rows that repeat a vec_id count once, with their best score. An empty
    table gives no rows.
    """
    spark = base.sparkSession
    rows = stored(vectors(base), "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.octet_length("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return none
    width, total = common["width"], common["count"]
    index = fit(rows, width, lists or min(1024, max(64, int(total**0.5))))
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        for b in batches:
            if len(b):
                z = shared.value.rotated(np.frombuffer(b"".join(b["x"]), dtype="<f8").reshape(len(b), -1))
                yield pd.DataFrame({"list": (z @ shared.value.centroids.T).argmax(axis=1), "vec_id": b["vec_id"], "x": b["x"]})

    placed = stored(rows.filter(F.octet_length("x") == width).mapInPandas(place, "list int, vec_id long, x binary"), "lists")
    for r in placed.groupBy("list").count().collect():  # one row per list
        index.sizes[r["list"]] = r["count"]
    chunk = chunk or min(65_536, max(1024, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    cut = shards(index.sizes, chunk)
    sized = spark.sparkContext.broadcast((index.centroids, index.sizes, cut))
    most = max(1, min(fewest, len(index.centroids)), int(np.ceil(probes * len(index.centroids))))

    def probe(batches):
        centroids, sizes, cut = sized.value
        first, many = np.array([c[1] for c in cut]), np.array([c[2] for c in cut])
        for b in batches:
            if not len(b):
                continue
            z = shared.value.rotated(np.frombuffer(b"".join(b["x"]), dtype="<f8").reshape(len(b), -1))
            order = np.argsort(-(z @ centroids.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            until = np.maximum(most, 1 + (held < 2 * k + 1).sum(axis=1).clip(max=order.shape[1] - 1))
            out = []
            for query_id, x, o, n in zip(b["vec_id"], b["x"], order, until, strict=True):
                by: dict[int, list[int]] = {}
                for j in o[:n].tolist():
                    for shard in range(first[j], first[j] + many[j]):
                        by.setdefault(shard, []).append(j)
                out += [(query_id, x, np.array(v, dtype=np.int32), shard) for shard, v in by.items()]
            yield pd.DataFrame(out, columns=["query_id", "x", "probed", "shard"])

    asked = placed.filter(queries).select("vec_id", "x").dropDuplicates(["vec_id"]).mapInPandas(probe, "query_id long, x binary, probed array<int>, shard int")
    asked = stored(asked, "probes")
    asks = asked.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # one row per shard
    where = F.broadcast(spark.createDataFrame(cut, "list int, first int, many int"))  # one row per list
    left = (
        placed.join(where, "list")
        .withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many")).cast("int"))
        .join(asks, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "vec_id", "x")
    )
    right = asked.join(asks, "shard").select("shard", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "x", "probed")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a = a.sort_values(["list", "vec_id"], kind="stable").drop_duplicates(["vec_id", "x"])
        x = np.frombuffer(b"".join(a["x"]), dtype="<f8").reshape(len(a), -1)
        q = np.frombuffer(b"".join(b["x"]), dtype="<f8").reshape(len(b), -1)
        ids, own = a["vec_id"].to_numpy(), b["query_id"].to_numpy()
        z = shared.value.rotated(x)
        scan = Scan(shared.value.rotated(q), own, k, doubt)
        names, first = np.unique(a["list"].to_numpy(), return_index=True)
        span = dict(zip(names.tolist(), zip(first, [*first[1:], len(a)], strict=True), strict=True))
        askers: dict[int, tuple[list, list]] = {j: ([], []) for j in span}
        for i, probed in enumerate(b["probed"]):
            here = [j for j in probed.tolist() if j in span]
            for turn, j in enumerate(here):
                askers[j][min(turn, 1)].append(i)
        for turn in range(2):  # nearest lists, then the others
            for j, (start, end) in span.items():
                if askers[j][turn]:
                    scan.meet(np.array(askers[j][turn]), z[start:end], ids[start:end], start)
        who, row = scan.survivors()
        score = np.clip((x[row] * q[who]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1))[row] * np.sqrt((q * q).sum(axis=1))[who]), -1, 1)
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, dtype=np.int64)
        top = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < k
        return pd.DataFrame({"query_id": own[who[top]], "vec_id": ids[row[top]], "score": score[top]})

    keys = ["shard", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
