"""Parameter learning from streams of row batches with Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.forest import Forest, counted, forest_divergences, forest_e_step, forest_m_step
from partita.operators.parameters import LatentClass, _columns, _log_rho, e_step, held, m_step, parameter_divergences
from partita.operators.scoring import forest_log_likelihood, row_log_likelihood


def _blocks(model: LatentClass | Forest) -> list[tuple[str, list[np.ndarray]]]:
    """Natural parameters of a model by node: of its latent (under the empty name) or latents, then of its attributes."""
    latents = model.latents if isinstance(model, Forest) else {"": model.alpha}
    out = [(z, [a]) for z, a in latents.items()]
    out += [(c, [k, k * m, a, b + 0.5 * k * m * m]) for c, (m, k, a, b) in model.gaussian.items()]
    return out + [(c, [t]) for c, t in model.discrete.items()]


def natural(model: LatentClass | Forest) -> np.ndarray:
    """Natural parameters as one array: they add over batches and partitions."""
    return np.concatenate([x.ravel() for _, parts in _blocks(model) for x in parts])


def node_sizes(model: LatentClass | Forest) -> dict[str, int]:
    """How many natural parameters each node has, in their order."""
    return {name: sum(x.size for x in parts) for name, parts in _blocks(model)}


def from_natural(flat: np.ndarray, like: LatentClass | Forest) -> LatentClass | Forest:
    tables, g, at = {}, {}, 0
    for name, parts in _blocks(like):
        part = flat[at : at + sum(x.size for x in parts)]
        at += len(part)
        if name in like.gaussian:
            kappa, km, a, bb = part.reshape(4, -1)
            m = km / kappa
            g[name] = (m, kappa, a, np.maximum(bb - 0.5 * kappa * m * m, 1e-12))
        else:
            tables[name] = part.reshape(parts[0].shape)
    d = {c: tables[c] for c in like.discrete}
    if isinstance(like, Forest):
        return Forest(like.structure, {z: tables[z] for z in like.latents}, g, d)
    return LatentClass(tables[""], g, d, like.domains)


def _steps(model: LatentClass | Forest) -> tuple[Callable, Callable, Callable]:
    """Expectation and maximisation step and the divergences by node of a kind of model."""
    return (forest_e_step, forest_m_step, forest_divergences) if isinstance(model, Forest) else (e_step, m_step, parameter_divergences)


def update(batch: DataFrame, prior: LatentClass | Forest, start: LatentClass | Forest, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], steps: int = 20, threshold: float = 0.01, fixed: Mapping[str, object] | None = None, weight: str | None = None) -> LatentClass | Forest:
    """The posterior of one batch under a prior, from a start, by passes over the batch. fixed: parameters of attributes that are held; weight: the column of a batch that is counted()."""
    expect, maximise, apart = _steps(prior)
    prior, now, past = held(replace(prior), fixed), held(replace(start), fixed), -math.inf
    for _ in range(steps):
        stats = expect(batch, [now], numeric, domains, weight)[0]
        elbo = stats["bound"] - sum(apart(now, prior).values())
        gain, past = elbo - past, elbo
        now = held(maximise(stats, prior), fixed)
        now.elbo = elbo
        if gain < threshold:
            break
    return now


def drift_weight(push: float, kind: str = "exponential", centre: float = 0.5, spread: float = 0.3) -> float:
    """The mean on [0, 1] of a weight whose log density is push * w (exponential), or that plus a normal one's with the given centre and spread."""
    w = np.linspace(0.0, 1.0, 4001)
    log = push * w - (0.5 * ((w - centre) / spread) ** 2 if kind == "normal" else 0.0)
    if kind == "exponential" and abs(push) > 50:  # narrower than the grid: the far end does not matter
        return float(min(max(1 - 1 / push if push > 0 else -1 / push, 0.0), 1.0))
    p = np.exp(log - log.max())
    p[[0, -1]] /= 2
    return float((p * w).sum() / p.sum())


@dataclass
class StateTable:
    """Model states as rows of a Parquet table, one file set per batch id: replaying a batch changes nothing."""

    path: str
    model_id: str = "model"

    def save(self, spark: SparkSession, batch_id: int, model: LatentClass | Forest, elbo: float, score: float | None, weights: Mapping[str, float] | None = None) -> None:
        row = [(self.model_id, int(batch_id), natural(model).tolist(), float(elbo), score, dict(weights or {}))]
        df = spark.createDataFrame(row, "model_id string, batch_id long, natural array<double>, elbo double, predictive double, weights map<string, double>")
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={int(batch_id)}")

    def batches(self, spark: SparkSession) -> list[int]:
        """The ids of the batches that are there, from the folder's names."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        return sorted(int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(where) if f.getPath().getName().startswith("batch_id="))

    def newest(self, spark: SparkSession, batch_id: int):
        """The row of one batch."""
        return spark.read.parquet(f"{self.path}/batch_id={batch_id}").first()

    def rows(self, spark: SparkSession) -> list:
        return [self.newest(spark, i) for i in self.batches(spark)]


def updater(state: StateTable, prior: LatentClass | Forest, start: LatentClass | Forest, numeric: Sequence[str], domains: Mapping[str, Sequence[str]] | None = None,
            rule: str = "bayes", total: float | None = None, rate: float | Callable[[int], float] = lambda t: (1 + t) ** -0.75, drift_prior: float = 0.1, steps: int = 20,
            weights: str = "one", weight_prior: str = "exponential", centre: float = 0.5, spread: float = 0.3, fixed: Mapping[str, object] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch, for a latent class model or a forest of latents.

    bayes: a batch's posterior is the next one's prior. stochastic: natural parameters move by `rate` towards prior
    plus the batch's statistics scaled to `total` rows (a fixed `total` is the memory of a population model). drift:
    the prior of a batch is (1 - w) prior + w last posterior; w is the mean of a distribution on [0, 1] that is pushed by
    how much nearer the batch's posterior is to the last one than to the prior: exponential (by drift_prior beforehand) or, with weight_prior normal,
    a normal one about `centre`. weights: one for all parameters, or `each`, a weight for every latent and attribute (saved by name).
    fixed: parameters of attributes that are held. Every batch is first scored by the state before it (predictive log-likelihood), then learnt.
    """
    domains = dict(domains or {})
    expect, maximise, apart = _steps(prior)
    if weights not in ("one", "each") or weight_prior not in ("exponential", "normal"):
        raise ValueError("weights are one or each, their prior exponential or normal")
    prior, start = held(replace(prior), fixed), held(replace(start), fixed)
    sizes = node_sizes(prior)

    def drifted(batch: DataFrame, last: LatentClass | Forest, weight: str | None) -> tuple[LatentClass | Forest, dict[str, float]]:
        w, p0, p1, model = dict.fromkeys(sizes, 0.5), natural(prior), natural(last), last
        for _ in range(10):
            each = np.repeat(list(w.values()), list(sizes.values()))
            model = update(batch, from_natural((1 - each) * p0 + each * p1, prior), last, numeric, domains, steps, fixed=fixed, weight=weight)
            away, near = apart(model, prior), apart(model, last)
            push = {c: away[c] - near[c] for c in sizes}
            if weights == "one":
                push = dict.fromkeys(sizes, sum(push.values()))
            moved = {c: drift_weight(x + (drift_prior if weight_prior == "exponential" else 0.0), weight_prior, centre, spread) for c, x in push.items()}
            settled = max(abs(moved[c] - w[c]) for c in sizes) < 1e-3
            w = moved
            if settled:
                break
        return model, w

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = state.batches(spark)
        if batch_id in seen:
            return
        last = held(from_natural(np.array(state.newest(spark, seen[-1])["natural"]), prior), fixed) if seen else None
        batch, weight = counted(batch, numeric, domains)
        batch, found, many = batch.persist(), None, F.col(weight) if weight else F.lit(1)
        try:
            n = batch.agg(F.sum(many)).first()[0]
            if not n:
                return
            score = None
            if last:
                scored = forest_log_likelihood(batch, last.expected(domains)) if isinstance(last, Forest) else row_log_likelihood(batch, last.expected())
                score = scored.agg(F.sum(F.col("log_likelihood") * many)).first()[0]
            if rule == "stochastic":
                stats = expect(batch, [last or start], numeric, domains, weight)[0]
                new = natural(maximise(stats, prior)) - natural(prior)
                rho = rate(len(seen)) if callable(rate) else rate
                old = natural(last or prior)
                model, elbo = held(from_natural((1 - rho) * old + rho * (natural(prior) + (total or n) / n * new), prior), fixed), stats["bound"]
            elif rule == "drift" and last is not None:
                model, found = drifted(batch, last, weight)
                elbo = model.elbo
            else:
                model = update(batch, last or prior, last or start, numeric, domains, steps, fixed=fixed, weight=weight)
                elbo = model.elbo
            state.save(spark, batch_id, model, elbo, score, found)
        finally:
            batch.unpersist()

    return on_batch


def prequential(rows: DataFrame, by: str, on_batch: Callable[[DataFrame, int], None], state: StateTable) -> DataFrame:
    """(batch_id, elbo, predictive) of a table that is tested and then learnt batch by batch: `by` numbers its batches (fixed_batches() gives such numbers)."""
    for r in rows.select(by).distinct().orderBy(by).collect():  # a row per batch
        if r[0] is not None:
            on_batch(rows.filter(F.col(by) == r[0]), r[0])
    return rows.sparkSession.read.parquet(f"{state.path}/batch_id=*").select("batch_id", "elbo", "predictive")


def run_stream(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes all available input, in micro-batches as the source cuts them."""
    stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _fit_frame(b: pd.DataFrame, prior: LatentClass, start: LatentClass, numeric: Sequence[str], domains: Mapping[str, Sequence[str]], steps: int) -> LatentClass:
    """The posterior of the rows of one frame under a prior."""
    x, now = _columns(b, numeric, domains), start
    for _ in range(steps):
        rho = _log_rho(now, x, len(b))
        e = np.exp(rho - rho.max(axis=1, keepdims=True))
        r = e / e.sum(axis=1, keepdims=True)
        stats = {"r": r.sum(axis=0)}
        for c in numeric:
            ok = ~np.isnan(x[c])
            stats[c] = np.stack([r[ok].sum(axis=0), r[ok].T @ x[c][ok], r[ok].T @ x[c][ok] ** 2])
        for c, d in domains.items():
            ok = x[c] >= 0
            stats[c] = np.stack([np.bincount(x[c][ok], r[ok, s], len(d)) for s in range(now.states)])
        now = m_step(stats, prior)
    return now


def batch_deltas(rows: DataFrame, batch: str, prior: LatentClass, start: LatentClass, numeric: Sequence[str], domains: Mapping[str, Sequence[str]] | None = None, steps: int = 20) -> DataFrame:
    """(batch, n, delta) of a table or of a stream: what each batch of rows adds to the natural parameters of the prior.

    Batches (numbers in column `batch`) are fitted in parallel, each against the same prior. A task holds one frame of a batch (spark.sql.execution.arrow.maxRecordsPerBatch
    rows), whatever the batch's or partition's size: later frames of a batch continue from its posterior so far. On a stream the posteriors are
    state, keyed by batch, so rows of a batch may come in several micro-batches; output mode update. Null numbers are left out.
    """
    domains, schema = dict(domains or {}), "batch long, n long, delta array<double>"
    shared = rows.sparkSession.sparkContext.broadcast((prior, start))
    named = rows.filter(F.col(batch).isNotNull()).select(F.col(batch).cast("long").alias("_batch"), *numeric, *domains)

    def go_on(frames, flat: np.ndarray | None, n: int) -> tuple[np.ndarray | None, int]:
        first, begin = shared.value
        for b in frames:
            if len(b):
                old = first if flat is None else from_natural(flat, first)
                flat, n = natural(_fit_frame(b, old, begin if n == 0 else old, numeric, domains, steps)), n + len(b)
        return flat, n

    def row(key: tuple, flat: np.ndarray, n: int) -> pd.DataFrame:
        return pd.DataFrame({"batch": [key[0]], "n": [n], "delta": [(flat - natural(shared.value[0])).tolist()]})

    if not rows.isStreaming:

        def whole(batches):
            held_key, flat, n = None, None, 0
            for b in batches:
                for key, part in b.groupby("_batch", sort=True):
                    if held_key is not None and key != held_key:
                        yield row((held_key,), flat, n)
                        flat, n = None, 0
                    held_key = key
                    flat, n = go_on([part], flat, n)
            if held_key is not None:
                yield row((held_key,), flat, n)

        return named.repartition("_batch").sortWithinPartitions("_batch").mapInPandas(whole, schema)

    def stateful(key, frames, state):
        flat, n = (np.array(state.get[0]), state.get[1]) if state.exists else (None, 0)
        flat, n = go_on(frames, flat, n)
        if flat is not None:
            state.update((flat.tolist(), n))
            yield row(key, flat, n)

    return named.groupBy("_batch").applyInPandasWithState(stateful, schema, "flat array<double>, n long", "update", "NoTimeout")


def add_deltas(deltas: DataFrame, prior: LatentClass) -> LatentClass:
    """The prior and all batches' deltas; of a batch that is there several times (as a stream updates it) the one with most rows counts."""
    last = deltas.groupBy("batch").agg(F.max_by("delta", "n").alias("delta"))
    rows = last.select(F.posexplode("delta").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row per parameter
    flat = natural(prior)
    for r in rows:
        flat[r["i"]] += r["v"]
    return from_natural(flat, prior)


def run_deltas(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes a stream of batch_deltas() below path, a folder for each micro-batch: one that is run again replaces its own."""
    sink = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/epoch={i}"))
    sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def parallel_bayes_update(batch: DataFrame, prior: LatentClass, start: LatentClass, numeric: Sequence[str], domains: Mapping[str, Sequence[str]] | None = None, steps: int = 20, blocks: int = 16) -> LatentClass:
    """Blocks of rows (dealt by a hash of the columns) fit against the same prior in parallel; the differences posterior - prior add up."""
    columns = [*numeric, *(domains or {})]
    dealt = batch.select(*columns).withColumn("_block", F.pmod(F.xxhash64(*columns), F.lit(blocks)))
    return add_deltas(batch_deltas(dealt, "_block", prior, start, numeric, domains, steps), prior)


def stream_ml_stats(stream: DataFrame, child: str, parents: Sequence[str] = ()) -> DataFrame:
    """Running n, sum_x, sum_xx per configuration: a stateful aggregation over the stream."""
    x = F.col(child).cast("double")
    return stream.filter(F.col(child).isNotNull()).groupBy(*parents).agg(F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_xx"))


