"""Queries over sources, sinks and streams: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators import forest, parameters, scoring
from partita.functions.draws import uniform_sql
from partita.plans.models import DOMAINS, GIVEN, GIVEN_FOREST, TYPES, _forest_sql, _given_sql, marked_orders
from partita.plans.preparation import HOLED, _round, holed
from partita.plans.registry import Tables, query
from partita.sources import tables as io
from partita.sources.scratch import shared_path
from partita.streaming import updates


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def a1_delimited(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "delimited")
    rows = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    io.write_delimited(rows, path)
    return io.read_delimited(t.spark, path, rows.schema)


@query(f"SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM {HOLED}")
def a3_arff_folder(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "arff")
    io.write_arff_folder(holed(t), path)
    return io.read_arff_folder(t.spark, path)


@query(f"WITH {_given_sql()} SELECT o_orderkey, 'z' AS latent, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS label FROM t")
def a8_posteriors(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "posteriors")
    io.write_posteriors(scoring.posterior(holed(t), GIVEN), path, "o_orderkey", ["z"])
    return t.spark.read.parquet(path).select("o_orderkey", "latent", "label")


@query(f"WITH {_given_sql()} SELECT o_orderkey, round(total, 6) AS log_likelihood FROM t")
def a9_model_round_trip(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "model")
    io.save_model(t.spark, GIVEN, path)
    model = io.load_model(t.spark, path, t.orders.columns)
    return _round(scoring.row_log_likelihood(holed(t), model).select("o_orderkey", "log_likelihood"), 6, "log_likelihood")


@query(f"WITH {_forest_sql()} SELECT o_orderkey, round(total, 6) AS log_likelihood FROM t")
def a9_forest_round_trip(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "forest")
    io.save_forest(t.spark, GIVEN_FOREST, path)
    model = io.load_forest(t.spark, path, t.orders.columns)
    return _round(scoring.forest_log_likelihood(holed(t), model).select("o_orderkey", "log_likelihood"), 6, "log_likelihood")


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN concat(o_orderstatus, ', it''s \\ ', o_orderkey % 3, ' %') ELSE o_orderstatus END AS note FROM orders")
def a2_arff_table(t: Tables) -> DataFrame:
    """Text cells with commas, quotes, blanks, per cents and backslashes survive."""
    path, key = shared_path(t.spark, "arff-table"), F.col("o_orderkey")
    odd = F.concat("o_orderstatus", F.lit(", it's \\ "), (key % 3).cast("string"), F.lit(" %"))
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.when(key % 5 == 1, odd).when(key % 5 != 0, F.col("o_orderstatus")).alias("note"))
    io.write_arff_table(rows, path)
    return io.read_arff_table(t.spark, path)


def _event_stream(t: Tables, files: int = 4) -> DataFrame:
    """The events as a stream of `files` micro-batches in the order of their ids."""
    path = shared_path(t.spark, "stream")
    t.events.select("event_id", "event_type", "value").repartitionByRange(files, "event_id").write.parquet(path)
    return t.spark.readStream.schema("event_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS sum_x, round(sum(value * value), 3) AS sum_xx FROM events GROUP BY 1")
def h7_stream_stats(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "stats")
    running = updates.stream_ml_stats(_event_stream(t), "value", ["event_type"])
    sink = running.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(path))
    sink.option("checkpointLocation", shared_path(t.spark, "at")).trigger(availableNow=True).start().awaitTermination()
    return _round(_round(t.spark.read.parquet(path), 4, "sum_x"), 3, "sum_xx")


def _learn(t: Tables, rule: str, **options) -> DataFrame:
    domains = {"event_type": TYPES}
    prior = parameters.class_prior(t.events, 2, ["value"], domains)
    start = parameters._start(prior, parameters.np.random.default_rng(0))
    state = updates.StateTable(shared_path(t.spark, f"state-{rule}"))
    on_batch = updates.updater(state, prior, start, ["value"], domains, rule, steps=6, **options)
    updates.run_stream(_event_stream(t), on_batch, shared_path(t.spark, "at"))
    return t.spark.read.parquet(f"{state.path}/batch_id=*").select("batch_id", "elbo", "predictive")


@query()
def h1_stream_bayes(t: Tables) -> DataFrame:
    return _learn(t, "bayes")


def _one_state_sql(weight: str) -> str:
    """Batches of events by event_id % 4 in a model of one state: natural parameters are the prior and the batches' sums, times a weight that may depend on
    the number b of the state's batch, t of the added one and its rows n. What they predict for the next batch follows."""
    counts = ", ".join(f"count(*) FILTER (event_type = '{v}') AS c{i}" for i, v in enumerate(TYPES))
    added = ", ".join(f"any_value(a{i}) + coalesce(sum({weight} * c{i}), 0) AS a{i}" for i in range(len(TYPES)))
    prior = ", ".join(f"(count(*) FILTER (event_type = '{v}') + 1.0) / (count(*) + {len(TYPES)}) AS a{i}" for i, v in enumerate(TYPES))
    cases = " ".join(f"WHEN '{v}' THEN ln(a{i} / ({' + '.join(f'a{j}' for j in range(len(TYPES)))}))" for i, v in enumerate(TYPES))
    return f"""WITH p AS (SELECT avg(value) AS m0, var_pop(value) / 2 AS b0, {prior} FROM events),
      s AS (SELECT event_id % 4 AS t, count(*) AS n, sum(value) AS sx, sum(value * value) AS sxx, {counts} FROM events GROUP BY 1),
      k AS (SELECT b, any_value(b0) AS b0, 1 + sum({weight} * n) AS kappa, any_value(m0) + sum({weight} * sx) AS km, 0.5 + sum({weight} * n) / 2 AS a, any_value(b0) + 0.5 * any_value(m0) ** 2 + 0.5 * sum({weight} * sxx) AS bb, {added}
            FROM s, p, (SELECT unnest(range(4)) AS b) WHERE t <= b GROUP BY b),
      v AS (SELECT *, km / kappa AS mean, (bb - 0.5 * km * km / kappa) / a AS variance FROM k),
      g AS (SELECT event_id % 4 AS b, sum(-0.5 * ln(2 * pi() * variance) - (value - mean) ** 2 / (2 * variance) + CASE event_type {cases} END) AS predictive FROM events JOIN v ON v.b + 1 = event_id % 4 GROUP BY 1)
      SELECT v.b AS batch_id, round(kappa, 4) AS kappa, round(mean, 6) AS mean, round(variance, 4) AS variance, round(predictive, 2) AS predictive FROM v LEFT JOIN g USING (b)"""


def _one_state(t: Tables, rule: str, **options) -> DataFrame:
    """Events learnt in four batches by a model of one state, whose steps are exact: state and prediction of every batch."""
    domains = {"event_type": TYPES}
    prior = parameters.class_prior(t.events, 1, ["value"], domains)
    state = updates.StateTable(shared_path(t.spark, f"one-{rule}"))
    on_batch = updates.updater(state, prior, prior, ["value"], domains, rule, steps=2, **options)
    rows = t.events.withColumn("part", F.col("event_id") % 4)
    seen = updates.prequential(rows, "part", on_batch, state)
    models = [(r["batch_id"], updates.from_natural(parameters.np.array(r["natural"]), prior)) for r in t.spark.read.parquet(f"{state.path}/batch_id=*").collect()]  # a row per batch
    found = [(b, float(m.gaussian["value"][1][0]), float(m.gaussian["value"][0][0]), float(m.gaussian["value"][3][0] / m.gaussian["value"][2][0])) for b, m in models]
    out = t.spark.createDataFrame(found, "batch_id long, kappa double, mean double, variance double").join(seen.drop("elbo"), "batch_id")
    return _round(_round(_round(out, 4, "kappa", "variance"), 6, "mean"), 2, "predictive")


@query(_one_state_sql("1.0"))
def h6_prequential(t: Tables) -> DataFrame:
    """Every batch is predicted by the posterior of those before it, then learnt."""
    return _one_state(t, "bayes")


@query(_one_state_sql("((1.0 + t) ** -0.75 * coalesce((SELECT exp(sum(ln(1 - (1.0 + u) ** -0.75))) FROM (SELECT unnest(range(t + 1, b + 1)) AS u)), 1.0) * (SELECT count(*) FROM events) / n)"))
def h3_stochastic_steps(t: Tables) -> DataFrame:
    """Natural gradient steps of falling size towards the prior and a batch scaled to the whole table."""
    return _one_state(t, "stochastic", total=float(t.events.count()))


@query(_one_state_sql("(0.3 * 0.7 ** (b - t) * 1000.0 / n)"))
def h4_population_steps(t: Tables) -> DataFrame:
    """Steps of a fixed size towards a population of 1000 rows."""
    return _one_state(t, "stochastic", total=1000.0, rate=0.3)


def _events_state(t: Tables) -> tuple:
    domains = {"event_type": TYPES}
    prior = parameters.class_prior(t.events, 2, ["value"], domains)
    return prior, parameters._start(prior, parameters.np.random.default_rng(0)), domains


@query()
def h2_parallel_bayes(t: Tables) -> DataFrame:
    """Batches of 500 events come in a stream, each is fitted by itself, and their differences from the prior add up."""
    prior, start, domains = _events_state(t)
    stream = _event_stream(t).withColumn("part", F.floor(F.col("event_id") / 500))
    path = shared_path(t.spark, "deltas")
    updates.run_deltas(updates.batch_deltas(stream, "part", prior, start, ["value"], domains, 6), path, shared_path(t.spark, "at"))
    model = updates.add_deltas(t.spark.read.parquet(path), prior).expected("cluster")
    return scoring.hard_assign(t.events, model).groupBy("cluster").agg(F.count("*").alias("n"))


@query("SELECT event_id // 500 AS batch, count(*) AS n, round(sum(value), 4) AS sum_x, round(sum(value * value), 3) AS sum_xx FROM events GROUP BY 1")
def h2_batch_deltas(t: Tables) -> DataFrame:
    """What batches of 500 events of a stream add to the prior of a model of one state: their counts and sums."""
    prior, _, domains = _events_state(t)
    prior = parameters.class_prior(t.events, 1, ["value"], domains)
    stream = _event_stream(t).withColumn("part", F.floor(F.col("event_id") / 500))
    path = shared_path(t.spark, "deltas")
    updates.run_deltas(updates.batch_deltas(stream, "part", prior, prior, ["value"], domains, 1), path, shared_path(t.spark, "at"))
    last = t.spark.read.parquet(path).groupBy("batch").agg(F.max_by("delta", "n").alias("d"), F.max("n").alias("n"))
    return last.select("batch", "n", F.round(F.col("d")[2], 4).alias("sum_x"), F.round(2 * F.col("d")[4], 3).alias("sum_xx"))


@query()
def h5_drift_weights(t: Tables) -> DataFrame:
    """A weight for the latent and each attribute: values are doubled in the last batch."""
    prior, start, domains = _events_state(t)
    state = updates.StateTable(shared_path(t.spark, "weights"))
    on_batch = updates.updater(state, prior, start, ["value"], domains, "drift", weights="each", weight_prior="normal", steps=4)
    part = F.col("event_id") % 3
    updates.prequential(t.events.select("event_type", part.alias("part"), F.when(part == 2, 2 * F.col("value")).otherwise(F.col("value")).alias("value")), "part", on_batch, state)
    return t.spark.read.parquet(f"{state.path}/batch_id=*").select("batch_id", F.explode("weights").alias("node", "weight"))


@query()
def h1_stream_forest(t: Tables) -> DataFrame:
    """A forest of two latents learnt from a stream of orders."""
    rows = marked_orders(t).select("o_orderkey", *DOMAINS)
    path = shared_path(t.spark, "orders")
    rows.repartitionByRange(3, "o_orderkey").write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    structure = forest.Structure({"a": 2, "b": 2}, {"b": "a"}, {"big": "a", "o_orderstatus": "b", "late": "b", "o_orderpriority": forest.ALONE})
    known, weight = forest.counted(rows, (), DOMAINS)
    prior = forest.forest_prior(parameters.class_prior(known, 1, (), DOMAINS, weight=weight), structure)
    state = updates.StateTable(shared_path(t.spark, "forest-state"))
    updates.run_stream(stream, updates.updater(state, prior, forest.forest_start(prior, parameters.np.random.default_rng(0)), (), DOMAINS, steps=6), shared_path(t.spark, "at"))
    return t.spark.read.parquet(f"{state.path}/batch_id=*").select("batch_id", "elbo", "predictive")


@query()
def h3_stochastic(t: Tables) -> DataFrame:
    return _learn(t, "stochastic", total=float(t.events.count()))


@query()
def h4_population(t: Tables) -> DataFrame:
    return _learn(t, "stochastic", total=1000.0, rate=0.3)


@query()
def h5_drift(t: Tables) -> DataFrame:
    return _learn(t, "drift")


def _drawn(name: str) -> str:
    return uniform_sql("row_id", "'" + name.replace("'", "''") + "'", "0")


@query(f"""WITH r AS (SELECT unnest(range((SELECT count(*) FROM orders))) AS row_id),
     z AS (SELECT row_id, CASE WHEN {_drawn("z")} < 0.4 THEN 0 ELSE 1 END AS z, {_drawn("o_totalprice")} AS u, {_drawn("o_totalprice'")} AS v, {_drawn("o_orderstatus")} AS s, {_drawn("o_totalprice?")} AS hu, {_drawn("o_orderstatus?")} AS hs FROM r)
     SELECT row_id, z, CASE WHEN hu >= 0.05 THEN round(CASE z WHEN 0 THEN 120000.0 + 60000.0 * sqrt(-2 * ln(u)) * cos(2 * pi() * v) ELSE 330000.0 + 90000.0 * sqrt(-2 * ln(u)) * cos(2 * pi() * v) END, 2) END AS o_totalprice,
       CASE WHEN hs >= 0.05 THEN CASE WHEN z = 0 THEN CASE WHEN s < 0.5 THEN 'F' WHEN s < 0.8 THEN 'O' ELSE 'P' END ELSE CASE WHEN s < 0.25 THEN 'F' WHEN s < 0.6 THEN 'O' ELSE 'P' END END END AS o_orderstatus FROM z""")
def i6_forward_sample(t: Tables) -> DataFrame:
    """As many rows as there are orders, drawn from the given model."""
    return _round(scoring.forward_sample(t.spark, t.orders.count(), GIVEN, hide=0.05), 2, "o_totalprice")


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders")
def a6_metrics(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "runs")
    one = t.orders.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).first()
    io.write_metrics(t.spark, path, n=one["n"], mean=one["mean"])
    return t.spark.read.json(path).select("n", "mean")
