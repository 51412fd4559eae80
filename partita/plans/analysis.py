"""Queries over comparison, missing-data and dependence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.functions.draws import normal_sql, uniform_sql
from partita.operators import compare, dependence, missing
from partita.plans.preparation import HOLED, _round, holed
from partita.plans.registry import Tables, query

_RANKED = """ranked AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM base),
     ties AS (SELECT sum(t * t * t - t) AS tie, sum(t) AS n FROM (SELECT count(*)::DOUBLE AS t FROM base GROUP BY x))"""


@query(f"""WITH base AS (SELECT l_linestatus AS g, l_quantity AS x FROM lineitem), {_RANKED},
     s AS (SELECT count(*) FILTER (g = 'F')::DOUBLE AS n1, count(*) FILTER (g = 'O')::DOUBLE AS n2, sum(r) FILTER (g = 'F') AS r1 FROM ranked)
     SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, r1 - n1 * (n1 + 1) / 2 AS u,
       round(greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))), 6) AS z FROM s, ties""")
def d1_mann_whitney(t: Tables) -> DataFrame:
    return _round(compare.mann_whitney_stat(t.lineitem, "l_linestatus", "l_quantity", "F", "O"), 6, "z")


@query(f"""WITH base AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), {_RANKED},
     s AS (SELECT g, sum(r) AS rs, count(*) AS c FROM ranked GROUP BY g)
     SELECT count(*) AS groups, any_value(n)::BIGINT AS total, round((12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / c) - 3 * (any_value(n) + 1)) / (1 - any_value(tie) / (any_value(n) ** 3 - any_value(n))), 5) AS h FROM s, ties""")
def d2_kruskal_wallis(t: Tables) -> DataFrame:
    return _round(compare.kruskal_wallis_stat(t.customer, "c_mktsegment", "c_acctbal"), 5, "h")


@query("""WITH p AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS ss FROM customer GROUP BY 1),
     w AS (SELECT count(*) AS groups, sum(n) - count(*) AS dof, sum(ss) / (sum(n) - count(*)) AS mse FROM p)
     SELECT x.g AS a, y.g AS b, round(y.m - x.m, 4) AS difference, round(abs(y.m - x.m) / sqrt(mse / 2 * (1.0 / x.n + 1.0 / y.n)), 6) AS q, groups, dof::BIGINT AS dof FROM p x JOIN p y ON x.g < y.g, w""")
def d3_tukey(t: Tables) -> DataFrame:
    return _round(_round(compare.tukey_stat(t.customer, "c_mktsegment", "c_acctbal"), 4, "difference"), 6, "q")


@query("""WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2),
     e AS (SELECT n, sum(n) OVER (PARTITION BY quality) * sum(n) OVER (PARTITION BY toxic) / sum(n) OVER () AS e FROM c)
     SELECT 1 AS dof, round(sum((abs(n - e) - least(0.5, abs(n - e))) ** 2 / e), 6) AS chi2 FROM e""")
def d4_chi2_independence(t: Tables) -> DataFrame:
    return _round(compare.chi2_independence_stat(t.labels, "quality", "toxic"), 6, "chi2")


@query("""WITH c AS (SELECT l_returnflag AS g, l_linenumber AS c, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 2) GROUP BY 1, 2), t AS (SELECT g, sum(n) AS t FROM c GROUP BY 1),
     p AS (SELECT x.g AS a, y.g AS b, x.t AS ta, y.t AS tb FROM t x JOIN t y ON x.g < y.g),
     k AS (SELECT p.*, coalesce(l.n, 0) AS na, coalesce(r.n, 0) AS nb FROM p CROSS JOIN (SELECT DISTINCT c FROM c) v LEFT JOIN c l ON l.g = a AND l.c = v.c LEFT JOIN c r ON r.g = b AND r.c = v.c),
     q AS (SELECT *, ta * (na + nb) / (ta + tb) AS ea, tb * (na + nb) / (ta + tb) AS eb FROM k WHERE na + nb > 0)
     SELECT a, b, count(*) - 1 AS dof, round(sum((na - ea) ** 2 / ea + (nb - eb) ** 2 / eb), 6) AS chi2 FROM q GROUP BY a, b""")
def d4_chi2_pairwise(t: Tables) -> DataFrame:
    """Every pair of return flags; one of them lacks a line number."""
    rows = t.lineitem.filter("not (l_returnflag = 'A' and l_linenumber = 2)")
    return _round(compare.chi2_pairwise_stat(rows, "l_returnflag", "l_linenumber"), 6, "chi2")


@query("""WITH s AS (SELECT l_returnflag, 100.0 * count(*) FILTER (l_linestatus = 'F') / sum(count(*) FILTER (l_linestatus = 'F')) OVER () AS o,
       100.0 * count(*) FILTER (l_linestatus = 'O') / sum(count(*) FILTER (l_linestatus = 'O')) OVER () AS e FROM lineitem GROUP BY 1)
     SELECT count(*) AS categories, round(sum((o - e) ** 2 / e), 6) AS chi2 FROM s""")
def d5_chi2_goodness(t: Tables) -> DataFrame:
    return _round(compare.chi2_goodness_of_fit_stat(t.lineitem, "l_linestatus", "l_returnflag", "F", "O"), 6, "chi2")


_PARTS, _COVS = ("l_returnflag", "l_linestatus"), ("l_quantity", "l_discount")


def _d6() -> str:
    out = []
    for p, groups in (("l_returnflag", 3), ("l_linestatus", 2)):
        for c in _COVS:
            base = f"""WITH base AS (SELECT {p} AS g, {c}::DOUBLE AS x FROM lineitem), {_RANKED},
              s AS (SELECT g, sum(r) AS rs, count(*)::DOUBLE AS c, avg(x) AS m, var_pop(x) * count(*) AS ss FROM ranked GROUP BY g)"""
            head = f"SELECT '{p}' AS partition, '{c}' AS covariate,"
            if groups == 2:
                out.append(f"""{base} {head} 'mann_whitney' AS test, a.g AS a, b.g AS b, round(a.rs - a.c * (a.c + 1) / 2, 4) AS statistic,
                  round(greatest(abs(a.rs - a.c * (a.c + 1) / 2 - a.c * b.c / 2) - 0.5, 0) / sqrt(a.c * b.c / 12 * ((n + 1) - tie / (n * (n - 1)))), 4) AS z, 2 AS groups, 1 AS dof
                  FROM s a JOIN s b ON a.g < b.g, ties""")
                continue
            out.append(f"""{base} {head} 'kruskal_wallis' AS test, NULL AS a, NULL AS b,
              round((12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / c) - 3 * (any_value(n) + 1)) / (1 - any_value(tie) / (any_value(n) ** 3 - any_value(n))), 4) AS statistic, NULL AS z, count(*) AS groups, count(*) - 1 AS dof FROM s, ties""")
            out.append(f"""{base}, w AS (SELECT sum(ss) / (sum(c) - count(*)) AS mse, sum(c) - count(*) AS dof FROM s) {head} 'tukey' AS test, a.g AS a, b.g AS b,
              round(abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.c + 1 / b.c)), 4) AS statistic, NULL AS z, 3 AS groups, dof::BIGINT AS dof FROM s a JOIN s b ON a.g < b.g, w""")
        out.append(f"""WITH n AS (SELECT {p} AS g, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
          e AS (SELECT a.g, b.v, coalesce(n.n, 0) AS n, a.r * b.c / (SELECT sum(n) FROM n) AS e FROM (SELECT g, sum(n) AS r FROM n GROUP BY 1) a CROSS JOIN (SELECT v, sum(n) AS c FROM n GROUP BY 1) b LEFT JOIN n ON n.g = a.g AND n.v = b.v)
          SELECT '{p}' AS partition, 'l_linenumber' AS covariate, 'chi2' AS test, NULL AS a, NULL AS b, round(sum((n - e) ** 2 / e), 4) AS statistic, NULL AS z, count(DISTINCT g) AS groups, (count(DISTINCT g) - 1) * (count(DISTINCT v) - 1) AS dof FROM e""")
    return " UNION ALL ".join(f"SELECT * FROM ({q})" for q in out)


@query(_d6())
def d6_compare_partitions(t: Tables) -> DataFrame:
    return _round(compare.compare_partitions(t.lineitem, _PARTS, _COVS, ["l_linenumber"]), 4, "statistic", "z")


_E = ["o_totalprice", "o_orderpriority"]


@query(f"""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL AND o_orderpriority IS NULL THEN 'o_totalprice,o_orderpriority' WHEN o_totalprice IS NULL THEN 'o_totalprice' ELSE 'o_orderpriority' END AS missing
     FROM {HOLED} WHERE o_totalprice IS NULL OR o_orderpriority IS NULL""")
def e1_locate_missing(t: Tables) -> DataFrame:
    return missing.locate_missing(holed(t), "o_orderkey", _E).withColumn("missing", F.array_join("missing", ","))


_MASK = """(SELECT o_orderkey, attribute FROM (SELECT o_orderkey, unnest(['o_totalprice', 'o_orderpriority']) AS attribute FROM orders)
     ORDER BY md5(concat_ws(':', o_orderkey, attribute, '0')), o_orderkey, attribute LIMIT (SELECT CAST(floor(count(*) * 2 * 0.1 + 1e-9) AS BIGINT) FROM orders))"""


def _mask(t: Tables) -> DataFrame:
    return missing.hide_cells(t.orders, "o_orderkey", _E, 0.1)


@query(f"SELECT o_orderkey, attribute FROM {_MASK}")
def e2_hide_cells(t: Tables) -> DataFrame:
    return _mask(t)


@query(f"""WITH h AS {HOLED}, m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM h),
     w AS (SELECT v, sum(n + 1) OVER (ORDER BY v) / sum(n + 1) OVER () AS reach, row_number() OVER (ORDER BY v DESC) AS last FROM (SELECT o_orderpriority AS v, count(*) AS n FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1))
     SELECT o_orderkey, o_orderstatus, round(coalesce(o_totalprice, mean + sd * sqrt(-2 * ln({uniform_sql("o_orderkey", "'o_totalprice'", "0")})) * cos(2 * pi() * {uniform_sql("o_orderkey", "'o_totalprice'", "1")})), 2) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT min(v) FROM w WHERE {uniform_sql("o_orderkey", "'o_orderpriority'", "0")} < reach OR last = 1)) AS o_orderpriority FROM h, m""")
def e3_impute_marginal(t: Tables) -> DataFrame:
    return _round(missing.impute_marginal(holed(t), "o_orderkey", ["o_totalprice"], ["o_orderpriority"]), 2, "o_totalprice")


@query(f"""WITH h AS {HOLED}, m AS (SELECT avg(o_totalprice) AS mean FROM h), p AS (SELECT o_orderpriority AS mode FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
     SELECT o_orderkey, o_orderstatus, round(coalesce(o_totalprice, mean), 4) AS o_totalprice, coalesce(o_orderpriority, mode) AS o_orderpriority FROM h, m, p""")
def e4_impute_expected(t: Tables) -> DataFrame:
    return _round(missing.impute_expected(holed(t), ["o_totalprice"], ["o_orderpriority"]), 4, "o_totalprice")


#: Truth, mask and imputed cells of the quality measures in long form.
_CELLS = f"""mask AS {_MASK}, h AS (SELECT o.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN o_totalprice END AS price, CASE WHEN b.o_orderkey IS NULL THEN o_orderpriority END AS prio, o_totalprice, o_orderpriority,
       a.o_orderkey IS NOT NULL AS hid_price, b.o_orderkey IS NOT NULL AS hid_prio
     FROM orders o LEFT JOIN mask a ON a.o_orderkey = o.o_orderkey AND a.attribute = 'o_totalprice' LEFT JOIN mask b ON b.o_orderkey = o.o_orderkey AND b.attribute = 'o_orderpriority'),
     s AS (SELECT avg(price) AS mean FROM h), md AS (SELECT prio AS mode FROM h WHERE prio IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


def _imputed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth, mask = t.orders.select("o_orderkey", *_E), _mask(t)
    lost = missing.apply_mask(truth, "o_orderkey", _E, mask)
    return truth, missing.impute_expected(lost, ["o_totalprice"], ["o_orderpriority"]), mask


@query(f"WITH {_CELLS} SELECT round(avg(CASE WHEN o_orderpriority = mode THEN 1.0 ELSE 0 END), 8) AS accuracy FROM h, md WHERE hid_prio")
def e6_impute_accuracy(t: Tables) -> DataFrame:
    truth, guess, mask = _imputed(t)
    return _round(missing.impute_accuracy(truth, guess, mask, "o_orderkey", ["o_orderpriority"]), 8, "accuracy")


@query(f"WITH {_CELLS} SELECT round(avg((o_totalprice - mean) ** 2) / 1e6, 4) AS mse_millions FROM h, s WHERE hid_price")
def e7_impute_mse(t: Tables) -> DataFrame:
    truth, guess, mask = _imputed(t)
    return missing.impute_mse(truth, guess, mask, "o_orderkey", ["o_totalprice"]).select(F.round(F.col("mse") / 1e6, 4).alias("mse_millions"))


_NRMSE = "(SELECT sqrt(avg((o_totalprice - mean) ** 2)) FROM h, s WHERE hid_price) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders)"


@query(f"WITH {_CELLS} SELECT round({_NRMSE}, 8) AS nrmse")
def e8_impute_nrmse(t: Tables) -> DataFrame:
    truth, guess, mask = _imputed(t)
    return _round(missing.impute_nrmse(truth, guess, mask, "o_orderkey", ["o_totalprice"]), 8, "nrmse")


@query(f"WITH {_CELLS} SELECT round(({_NRMSE} + (SELECT avg(CASE WHEN o_orderpriority = mode THEN 0.0 ELSE 1 END) FROM h, md WHERE hid_prio)) / 2, 8) AS avg_error")
def e9_impute_avg_error(t: Tables) -> DataFrame:
    truth, guess, mask = _imputed(t)
    return _round(missing.impute_avg_error(truth, guess, mask, "o_orderkey", ["o_totalprice"], ["o_orderpriority"]), 8, "avg_error")


_COUNTS = "c AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {t} GROUP BY 1, 2), p AS (SELECT x, y, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM c)"


def _counts(x: str, y: str, table: str) -> str:
    return _COUNTS.format(x=x, y=y, t=table)


@query(f"WITH {_counts('l_returnflag', 'l_linestatus', 'lineitem')} SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, round(sum(p * ln(p / (px * py))), 8) AS mi FROM p")
def f1_mutual_info_discrete(t: Tables) -> DataFrame:
    return _round(dependence.mutual_info_discrete(t.lineitem, "l_returnflag", "l_linestatus"), 8, "mi")


def _psi(n: str) -> str:
    """Digamma of a whole number."""
    return f"(coalesce(list_sum(list_transform(range(1, ({n})::BIGINT), lambda i: 1.0 / i)), 0) - 0.5772156649015329)"


def _continuous_sql(x: str, y: str) -> str:
    gap = "greatest(abs(a.x - b.x), abs(a.y - b.y))"
    return f"""(WITH p AS (SELECT p_partkey AS k, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM part),
      d AS (SELECT a.k, {gap} AS d, row_number() OVER (PARTITION BY a.k ORDER BY {gap}, b.k) AS r FROM p a JOIN p b ON a.k <> b.k), e AS (SELECT p.*, d.d AS eps FROM p JOIN d USING (k) WHERE r = 3),
      c AS (SELECT e.k, greatest(count(*) FILTER (q.x < e.x + e.eps AND q.x > e.x - e.eps) - 1, 0) AS nx, greatest(count(*) FILTER (q.y < e.y + e.eps AND q.y > e.y - e.eps) - 1, 0) AS ny FROM e CROSS JOIN p q GROUP BY e.k)
      SELECT round(greatest(0, {_psi("count(*)")} + {_psi("3")} - avg({_psi("nx + 1")} + {_psi("ny + 1")})), 6) AS mi FROM c)"""


def _mixed_sql(g: str, x: str) -> str:
    gap = "abs(a.x - b.x)"
    return f"""(WITH p AS (SELECT {g} AS g, {x}::DOUBLE AS x FROM part), v AS (SELECT g, x, count(*) AS n, count(*) OVER (PARTITION BY g) AS distinct_values FROM p GROUP BY g, x),
      d AS (SELECT a.g, a.x, a.n, a.distinct_values, {gap} AS d, row_number() OVER (PARTITION BY a.g, a.x ORDER BY {gap}) AS r FROM v a JOIN v b ON a.g = b.g AND a.x <> b.x),
      e AS (SELECT g, x, n, distinct_values, d AS eps FROM d WHERE r = 3 AND distinct_values > 3),
      m AS (SELECT e.g, e.x, any_value(e.n) AS n, any_value(distinct_values) AS dv, greatest(count(*) FILTER (q.x < e.x + e.eps AND q.x > e.x - e.eps) - 1, 0) AS m FROM e CROSS JOIN p q GROUP BY e.g, e.x),
      t AS (SELECT count(*) AS t FROM p)
      SELECT round(greatest(0, sum(n * ({_psi("3")} + {_psi("t")} - {_psi("dv")} - {_psi("m + 1")})) / any_value(t)), 6) AS mi FROM m, t)"""


@query(f"SELECT * FROM {_continuous_sql('p_size', 'p_retailprice')}")
def f2_mutual_info_continuous(t: Tables) -> DataFrame:
    mi = dependence.mutual_info_continuous(t.part, "p_partkey", "p_size", "p_retailprice")
    return t.spark.createDataFrame([(round(mi, 6),)], "mi double")


def _noisy_sql(name: str, value: str) -> str:
    return f"""({value} + 1e-6 * greatest(1, (SELECT avg({value}) FROM part)) * {normal_sql("p_partkey", f"'{name}'", "0")})"""


@query(f"SELECT * FROM {_continuous_sql(_noisy_sql('size', 'p_size % 3'), _noisy_sql('price', 'p_size % 2 + p_partkey % 2'))}")
def f2_mutual_info_jittered(t: Tables) -> DataFrame:
    """Columns of few values, whose ties are parted by noise."""
    rows = t.part.select("p_partkey", (F.col("p_size") % 3).alias("size"), (F.col("p_size") % 2 + F.col("p_partkey") % 2).alias("price"))
    mi = dependence.mutual_info_continuous(rows, "p_partkey", "size", "price", jitter=1e-6)
    return t.spark.createDataFrame([(round(mi, 6),)], "mi double")


@query(f"SELECT * FROM {_mixed_sql('p_brand', 'p_retailprice')}")
def f3_mutual_info_mixed(t: Tables) -> DataFrame:
    return _round(dependence.mutual_info_mixed(t.part, "p_brand", "p_retailprice"), 6, "mi")


@query(f"""SELECT 'p_size' AS a, 'p_retailprice' AS b, mi FROM {_continuous_sql('p_size', 'p_retailprice')} UNION ALL
     SELECT 'p_brand', 'p_size', mi FROM {_mixed_sql('p_brand', 'p_size')} UNION ALL SELECT 'p_brand', 'p_retailprice', mi FROM {_mixed_sql('p_brand', 'p_retailprice')}""")
def f4_mutual_info_by_type(t: Tables) -> DataFrame:
    found = dependence.mutual_info_by_type(t.part, "p_partkey", ["p_brand"], ["p_size", "p_retailprice"])
    return t.spark.createDataFrame([(a, b, round(mi, 6)) for a, b, mi in found], "a string, b string, mi double")


_DISCRETE = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]


def _matrix_sql(columns: list[str], table: str) -> str:
    one = "SELECT '{a}' AS a, '{b}' AS b, sum(p * ln(p / (px * py))) AS mi FROM (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {t} GROUP BY 1, 2))"
    return " UNION ALL ".join(one.format(a=a, b=b, t=table) for i, a in enumerate(columns) for b in columns[i + 1 :])


@query(f"SELECT a, b, round(mi, 8) AS mi FROM ({_matrix_sql(_DISCRETE, 'lineitem')})")
def f4_mutual_info_matrix(t: Tables) -> DataFrame:
    return _round(dependence.mutual_info_matrix(t.lineitem, _DISCRETE), 8, "mi")


@query(f"SELECT a, b, round(mi, 8) AS mi FROM ({_matrix_sql(_DISCRETE, 'lineitem')}) ORDER BY mi DESC, a, b LIMIT 3")
def f5_top_pairs(t: Tables) -> DataFrame:
    return _round(dependence.top_pairs(dependence.mutual_info_matrix(t.lineitem, _DISCRETE), 3), 8, "mi")


@query("""SELECT key_q, key, round(d, 6) AS distance, rank FROM (SELECT a.s_suppkey AS key_q, b.s_suppkey AS key, abs(a.s_acctbal - b.s_acctbal) + abs(a.s_nationkey - b.s_nationkey) AS d,
       row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal) + abs(a.s_nationkey - b.s_nationkey), b.s_suppkey) AS rank
     FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey) WHERE rank <= 3""")
def f6_knn_join(t: Tables) -> DataFrame:
    rows = t.supplier.withColumn("v", F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")))
    return _round(dependence.knn_join(rows, rows, "s_suppkey", "v", 3, "manhattan"), 6, "distance")


@query("""SELECT a.p_partkey AS key_q, b.p_partkey AS key, round(sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2), 6) AS distance
     FROM part a JOIN part b ON a.p_partkey <> b.p_partkey WHERE sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) <= 1.5""")
def f7_radius_join(t: Tables) -> DataFrame:
    """Distances are rounded before the pairs of vectors become pairs of rows."""
    return dependence.all_pairs(_round(dependence.radius_pairs(t.part, t.part, "p_partkey", ["p_size", "p_retailprice"], 1.5), 6, "distance"))


@query("""SELECT key_q, key, round(d, 6) AS distance, rank FROM (SELECT a.p_partkey AS key_q, b.p_partkey AS key, greatest(abs(a.p_size - b.p_size), abs(a.p_retailprice - b.p_retailprice)) AS d,
       row_number() OVER (PARTITION BY a.p_partkey ORDER BY greatest(abs(a.p_size - b.p_size), abs(a.p_retailprice - b.p_retailprice)), b.p_partkey) AS rank
     FROM (SELECT * FROM part WHERE p_partkey % 3 <> 1) a JOIN (SELECT * FROM part WHERE p_size <> 7) b ON a.p_partkey <> b.p_partkey) WHERE rank <= 4""")
def f6_knn_holed(t: Tables) -> DataFrame:
    """Queries and base differ; vectors without a size are null or hold a null and are left out."""
    point = F.array(F.when(F.col("p_size") != 7, F.col("p_size")).cast("double"), F.col("p_retailprice"))
    base = t.part.select("p_partkey", point.alias("v"))
    asked = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 1, F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))).alias("v"))
    return _round(dependence.knn_join(asked, base, "p_partkey", "v", 4, "chebyshev", cell=256), 6, "distance")


@query("""SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS manhattan,
     round(list_max(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS chebyshev FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f8_distance(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", *[F.round(dependence.distance(F.col("x"), F.col("y"), m), 6).alias(m) for m in ("euclidean", "manhattan", "chebyshev")])


@query(f"""WITH {_counts('o_orderstatus', 'o_orderpriority', 'orders')}, h AS (SELECT -sum(p * ln(px)) AS h_x, -sum(p * ln(py)) AS h_y, -sum(p * ln(p)) AS h_xy FROM p)
     SELECT round(h_x, 8) AS h_x, round(h_y, 8) AS h_y, round(h_xy, 8) AS h_xy, round(h_xy - h_y, 8) AS h_x_given_y, round(h_x + h_y - h_xy, 8) AS mi, round((h_x + h_y - h_xy) / sqrt(h_x * h_y), 8) AS nmi, round((h_x + h_y - h_xy) / h_x, 8) AS nmi_x FROM h""")
def f9_entropy_family(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("x"), F.col("o_orderpriority").alias("y")).agg(F.count("*").alias("n"))
    out = dependence.entropy_family(counts)
    return _round(out, 8, *out.columns)


@query("""WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, l_linenumber AS z, count(*) AS n FROM lineitem GROUP BY ALL)
     SELECT round(sum(n / t * ln(n * nz / (nxz * nyz))), 8) AS cmi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz FROM c)""")
def f9_conditional_mutual_info(t: Tables) -> DataFrame:
    return _round(dependence.conditional_mutual_info(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber"), 8, "cmi")


@query("""WITH p AS (SELECT l_linenumber AS s, count(*) / sum(count(*)) OVER () AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), q AS (SELECT l_linenumber AS s, count(*) / sum(count(*)) OVER () AS w FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
     SELECT round(sum(p.w * ln(p.w / q.w)), 8) AS kl FROM p JOIN q USING (s)""")
def f9_kl_divergence(t: Tables) -> DataFrame:
    of = lambda f: t.lineitem.filter(F.col("l_linestatus") == f).groupBy("l_linenumber").agg(F.count("*").alias("w"))
    return _round(dependence.kl_divergence(of("F"), of("O"), "l_linenumber", "w"), 8, "kl")


@query(f"""WITH m AS ({_matrix_sql(_DISCRETE, 'lineitem')}), b AS (SELECT a, b, mi FROM m UNION ALL SELECT b, a, mi FROM m), g AS (SELECT * FROM (VALUES ('l_returnflag', 1), ('l_linestatus', 1), ('l_linenumber', 2), ('l_tax', 2)) v(attribute, grp))
     SELECT x.grp AS gx, y.grp AS gy, round(max(mi), 8) AS single, round(min(mi), 8) AS complete, round(avg(mi), 8) AS average FROM b JOIN g x ON x.attribute = a JOIN g y ON y.attribute = b WHERE x.grp < y.grp GROUP BY 1, 2""")
def f11_group_linkage(t: Tables) -> DataFrame:
    groups = t.spark.createDataFrame(list(zip(_DISCRETE, [1, 1, 2, 2], strict=True)), "attribute string, grp int")
    return _round(dependence.group_linkage(dependence.mutual_info_matrix(t.lineitem, _DISCRETE), groups), 8, "single", "complete", "average")


@query("""WITH e AS (SELECT 'a' AS model, n_regionkey AS parent, n_name AS child FROM nation UNION ALL SELECT 'b', n_nationkey % 5, n_name FROM nation UNION ALL SELECT 'c', n_nationkey % 4, n_name FROM nation),
     p AS (SELECT DISTINCT model, concat(parent, ':', string_agg(child, '|' ORDER BY child)) AS part FROM e GROUP BY model, parent), s AS (SELECT model, count(*) AS n FROM p GROUP BY 1)
     SELECT x.model AS a, y.model AS b, (x.n + y.n - 2 * (SELECT count(*) FROM p u JOIN p v USING (part) WHERE u.model = x.model AND v.model = y.model)) / 2 AS distance FROM s x JOIN s y ON x.model < y.model""")
def j11_robinson_foulds(t: Tables) -> DataFrame:
    tree = lambda m, p: t.nation.select(F.lit(m).alias("model"), p.cast("int").alias("parent"), F.col("n_name").alias("child"))
    key = F.col("n_nationkey")
    return dependence.robinson_foulds(tree("a", F.col("n_regionkey")).unionByName(tree("b", key % 5)).unionByName(tree("c", key % 4)))
