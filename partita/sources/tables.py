"""Sources and sinks: delimited files, ARFF tables and folders, metrics, matrices, posteriors, models."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partita.operators.scoring import ForestModel, MixtureModel


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ";") -> DataFrame:
    """A file with a header; `?` and empty cells are null, NaN becomes null."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "?").option("emptyValue", None)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_delimited(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "?").csv(path)


_ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^']*)'|\"(?:[^\"]*)\"|\S+)\s+(.*)", re.IGNORECASE)


def arff_schema(lines: Sequence[str]) -> T.StructType:
    """The columns that header lines declare: numbers as doubles, value lists as strings that keep them as metadata."""
    fields = []
    for line in lines:
        if not (m := _ATTRIBUTE.match(line.strip())):
            continue
        name, kind = m[1].strip("'\""), m[2].strip()
        if kind.startswith("{"):
            words = re.findall(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,]+", kind.strip()[1:].rpartition("}")[0])
            states = [re.sub(r"\\(.)", r"\1", w[1:-1]) if w[0] in "'\"" else w for w in (x.strip() for x in words) if w]
            fields.append(T.StructField(name, T.StringType(), True, {"states": states}))
        elif re.match(r"(real|numeric|integer)\b", kind, re.IGNORECASE):
            bounds = re.findall(r"[-+0-9.eE]+", kind.partition("[")[2])
            fields.append(T.StructField(name, T.DoubleType(), True, {"bounds": [float(b) for b in bounds[:2]]} if len(bounds) > 1 else None))
        else:
            fields.append(T.StructField(name, T.StringType()))
    if not fields:
        raise ValueError("the header declares no attribute")
    return T.StructType(fields)


_CELL = r",(?:\s*'(?:[^'\\]|\\.)*'\s*|\s*\"(?:[^\"\\]|\\.)*\"\s*|[^,]*)"


def _quoted(value: Column) -> Column:
    """A text cell, in quotes where a comma, quote, blank, backslash, per cent or brace in it, or its being empty or ?, needs them."""
    marked = F.concat(F.lit("'"), F.regexp_replace(value, r"(['\\])", r"\\$1"), F.lit("'"))
    return F.when(value.rlike(r"[,'\"\s%{}\\]") | value.isin("", "?"), marked).otherwise(value)


def _typed(body: DataFrame, schema: T.StructType) -> DataFrame:
    """Comma rows (column value) as typed columns; a row with another number of cells is an error."""
    # a cell ends at a comma outside quotes; a backslash keeps the mark behind it
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(_CELL), F.lit(0)), lambda c: F.substring(c, 2, 1 << 30))
    width = len(schema)
    right = F.when(F.size(cells) == width, cells).otherwise(F.raise_error(F.concat(F.lit(f"a row does not have {width} cells: "), F.col("value"))).cast("array<string>"))
    rows = body.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("%")).select(right.alias("c"))
    out = []
    for i, f in enumerate(schema):
        cell = F.trim(F.col("c")[i])
        plain = F.regexp_replace(F.regexp_replace(cell, "^(['\"])(.*)\\1$", "$2"), r"\\(.)", "$1")
        cell = F.when(~cell.isin("?", ""), F.when(cell.rlike("^['\"]"), plain).otherwise(cell))
        out.append(cell.cast(f.dataType).alias(f.name, metadata=f.metadata or {}))
    return rows.select(*out)


def read_arff_table(spark: SparkSession, path: str) -> DataFrame:
    """One ARFF file: the header's lines are read by the driver, the rows by tasks."""
    text = spark.read.text(path)
    head = text.filter(F.ltrim(F.lower("value")).startswith("@")).collect()
    schema = arff_schema([r["value"] for r in head])
    return _typed(text.filter(~F.ltrim("value").startswith("@")), schema)


def _arff_lines(df: DataFrame) -> tuple[list[str], DataFrame]:
    """The attribute lines of a table, and its rows as comma lines with ? for null; cells and states are quoted where they must be."""

    def quoted(text: str) -> str:
        return "'" + re.sub(r"(['\\])", r"\\\1", text) + "'" if text in ("", "?") or re.search(r"[,'\"\s%{}\\]", text) else text

    lines, cells = [], []
    for f in df.schema:
        name, cell = quoted(f.name), F.col(f"`{f.name}`").cast("string")
        if isinstance(f.dataType, T.StringType):
            states = (f.metadata or {}).get("states") or sorted(r[0] for r in df.select(f"`{f.name}`").distinct().collect() if r[0] is not None)
            lines.append(f"@attribute {name} {{{','.join(map(quoted, states))}}}")
            cell = _quoted(cell)
        else:
            lines.append(f"@attribute {name} real")
        cells.append(F.coalesce(cell, F.lit("?")))
    return lines, df.select(F.concat_ws(",", *cells).alias("value"))


def _write_lines(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_arff_table(df: DataFrame, path: str, relation: str = "table") -> None:
    """One ARFF table as a folder of text files: one has the header, the others the rows. read_arff_table() reads it, or the files put together.

    String columns need their states in the metadata, or they are gathered (a row per state). A text cell must not hold a line end.
    """
    lines, rows = _arff_lines(df)
    _write_lines(df.sparkSession, [f"@relation {relation}", *lines, "@data"], path)
    rows.write.mode("append").text(path)


def write_arff_folder(df: DataFrame, path: str, relation: str = "table") -> None:
    """A folder: attributes.txt and name.txt directories of one line list each, and data/ of comma rows with ? for null.

    String columns need their states in the metadata, or they are gathered (a row per state).
    """
    lines, rows = _arff_lines(df)
    _write_lines(df.sparkSession, lines, f"{path}/attributes.txt")
    _write_lines(df.sparkSession, [f"@relation {relation}"], f"{path}/name.txt")
    rows.write.mode("overwrite").text(f"{path}/data")


def read_arff_folder(spark: SparkSession, path: str) -> DataFrame:
    schema = arff_schema([r["value"] for r in spark.read.text(f"{path}/attributes.txt").collect()])
    return _typed(spark.read.text(f"{path}/data"), schema)


def write_metrics(spark: SparkSession, path: str, **metrics) -> None:
    """Appends one row of run metrics."""
    spark.createDataFrame([metrics]).write.mode("append").json(path)


def matrix(cells: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """Long cells as a square table with a column c_<j> per column index."""
    named = cells.select(F.concat(F.lit("c_"), F.col(i).cast("string")).alias("row"), F.concat(F.lit("c_"), F.col(j).cast("string")).alias("_j"), F.col(v).alias("_v"))
    return named.groupBy("row").pivot("_j").agg(F.first("_v"))


def write_matrix(cells: DataFrame, path: str, i: str = "i", j: str = "j", v: str = "v") -> None:
    matrix(cells, i, j, v).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_posteriors(df: DataFrame, path: str, key: str, latents: Sequence[str]) -> None:
    """One partition per latent: row key, probabilities and label."""
    cells = [F.struct(F.lit(z).alias("latent"), F.col(f"{z}_probs").alias("probs"), (F.array_position(f"{z}_probs", F.array_max(f"{z}_probs")) - 1).cast("int").alias("label")) for z in latents]
    df.select(key, F.inline(F.array(*cells))).write.mode("overwrite").partitionBy("latent").parquet(path)


def model_tables(spark: SparkSession, model: MixtureModel, model_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, params) of a model."""
    z = model.latent
    nodes = [(model_id, z, "discrete", True, [str(s) for s in range(model.states)])]
    nodes += [(model_id, c, "gaussian", False, None) for c in model.gaussian] + [(model_id, c, "discrete", False, list(p[0])) for c, p in model.discrete.items()]
    edges = [(model_id, z, c) for c in [*model.gaussian, *model.discrete]]
    params = [(model_id, z, "", str(s), float(w)) for s, w in enumerate(model.weights)]
    for c, p in model.gaussian.items():
        params += [(model_id, c, f"{z}={s}", n, float(x)) for s, mv in enumerate(p) for n, x in zip(("mean", "variance"), mv, strict=True)]
    for c, p in model.discrete.items():
        params += [(model_id, c, f"{z}={s}", v, float(x)) for s, d in enumerate(p) for v, x in d.items()]
    return (
        spark.createDataFrame(nodes, "model_id string, node string, kind string, latent boolean, states array<string>"),
        spark.createDataFrame(edges, "model_id string, parent string, child string"),
        spark.createDataFrame(params, "model_id string, node string, config string, param string, value double"),
    )


def save_model(spark: SparkSession, model: MixtureModel, path: str, model_id: str = "model") -> None:
    for name, df in zip(("model_nodes", "model_edges", "model_params"), model_tables(spark, model, model_id), strict=True):
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> MixtureModel:
    """A saved model; with columns, one whose attributes are not among them is an error."""
    nodes = spark.read.parquet(f"{path}/model_nodes").collect()
    latent = next(n for n in nodes if n["latent"])
    observed = {n["node"]: n for n in nodes if not n["latent"]}
    if columns is not None and (absent := sorted(set(observed) - set(columns))):
        raise ValueError(f"the table lacks attributes of the model: {', '.join(absent)}")
    by: dict[tuple, float] = {(r["node"], r["config"], r["param"]): r["value"] for r in spark.read.parquet(f"{path}/model_params").collect()}
    z, k = latent["node"], len(latent["states"])
    g = {c: [(by[c, f"{z}={s}", "mean"], by[c, f"{z}={s}", "variance"]) for s in range(k)] for c, n in observed.items() if n["kind"] == "gaussian"}
    d = {c: [{v: by[c, f"{z}={s}", v] for v in n["states"]} for s in range(k)] for c, n in observed.items() if n["kind"] == "discrete"}
    return MixtureModel([by[z, "", str(s)] for s in range(k)], g, d, z)


def save_forest(spark: SparkSession, model: ForestModel, path: str, model_id: str = "model") -> None:
    """A model of several latents in the same three tables: an edge per parent, a row per parameter and parent state."""
    nodes = [(model_id, z, "discrete", True, [str(s) for s in range(k)]) for z, k in model.cards.items()]
    nodes += [(model_id, c, "gaussian", False, None) for c in model.gaussian] + [(model_id, c, "discrete", False, list(v[0])) for c, v in model.discrete.items()]
    edges = [(model_id, p, c) for c, p in [*model.up.items(), *model.of.items()] if p]

    def configs(parent: str, values):
        return [(f"{parent}={s}" if parent else "", v) for s, v in enumerate(values)]

    params = [(model_id, z, at, str(s), float(p)) for z, rows in model.latents.items() for at, row in configs(model.up.get(z, ""), rows) for s, p in enumerate(row)]
    params += [(model_id, c, at, n, float(x)) for c, v in model.gaussian.items() for at, pair in configs(model.of[c], v) for n, x in zip(("mean", "variance"), pair, strict=True)]
    params += [(model_id, c, at, n, float(x)) for c, v in model.discrete.items() for at, table in configs(model.of[c], v) for n, x in table.items()]
    kinds = ("model_id string, node string, kind string, latent boolean, states array<string>", "model_id string, parent string, child string", "model_id string, node string, config string, param string, value double")
    for name, rows, kind in zip(("model_nodes", "model_edges", "model_params"), (nodes, edges, params), kinds, strict=True):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_forest(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> ForestModel:
    """A saved model of several latents; with columns, one whose attributes are not among them is an error."""
    nodes = {n["node"]: n for n in spark.read.parquet(f"{path}/model_nodes").collect()}
    parent = {e["child"]: e["parent"] for e in spark.read.parquet(f"{path}/model_edges").collect()}
    by = {(r["node"], r["config"], r["param"]): r["value"] for r in spark.read.parquet(f"{path}/model_params").collect()}
    observed = [c for c, n in nodes.items() if not n["latent"]]
    if columns is not None and (absent := sorted(set(observed) - set(columns))):
        raise ValueError(f"the table lacks attributes of the model: {', '.join(absent)}")
    configs = lambda c: [f"{parent[c]}={s}" for s in nodes[parent[c]]["states"]] if c in parent else [""]
    cards = {z: len(n["states"]) for z, n in nodes.items() if n["latent"]}
    return ForestModel(
        cards,
        {z: parent[z] for z in cards if z in parent},
        {c: parent.get(c, "") for c in observed},
        {z: [[by[z, at, s] for s in nodes[z]["states"]] for at in configs(z)] for z in cards},
        {c: [(by[c, at, "mean"], by[c, at, "variance"]) for at in configs(c)] for c in observed if nodes[c]["kind"] == "gaussian"},
        {c: [{v: by[c, at, v] for v in nodes[c]["states"]} for at in configs(c)] for c in observed if nodes[c]["kind"] == "discrete"},
    )
