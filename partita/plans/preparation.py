"""Queries over preparation and descriptive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators import describe, prepare
from partita.plans.registry import Tables, query
from partita.sources import tables as io

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_FLAGS = {"A": "accepted", "N": "none", "R": "returned"}


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT p_size, p_partkey, p_retailprice FROM part")
def b1_project(t: Tables) -> DataFrame:
    return prepare.project(t.part, ["p_size", "p_partkey", "p_retailprice"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, l_extendedprice FROM lineitem")
def b2_select_by_pattern(t: Tables) -> DataFrame:
    return prepare.select_by_pattern(t.lineitem, "l_", ["quantity"])


@query("SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, try_cast(o_orderstatus AS DOUBLE) AS status FROM orders")
def b3_to_numeric(t: Tables) -> DataFrame:
    cut = t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_orderstatus").alias("status"))
    return prepare.to_numeric(cut, ["level", "status"])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS score FROM lineitem")
def b4_composite_score(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(prepare.composite_score(["l_quantity", "l_discount", "l_tax"]), 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 0.2, 6) AS score FROM lineitem")
def b5_scale_by_max(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(prepare.composite_score(["l_discount", "l_tax"], 0.2), 6).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END AS flag,
          CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS flag_rank FROM lineitem""")
def b6_recode(t: Tables) -> DataFrame:
    return prepare.recode(t.lineitem, "l_returnflag", _FLAGS, "flag").select("l_orderkey", "l_linenumber", "flag", "flag_rank")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def b7_attach(t: Tables) -> DataFrame:
    return prepare.attach(t.documents.select("doc_id", "source"), t.labels, "doc_id").select("doc_id", "source", "quality", "toxic")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def b8_filter_and_map(t: Tables) -> DataFrame:
    kept = t.lineitem.filter((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "R"))
    return kept.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def holed(t: Tables) -> DataFrame:
    """orders with holes made by rule: price where the key divides by 7, priority where it divides by 5."""
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", "o_orderstatus", F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    )


HOLED = """(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
            CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


@query(f"SELECT * FROM {HOLED} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def b9_drop_missing(t: Tables) -> DataFrame:
    return holed(t).dropna("any")


@query(" UNION ALL ".join(f"SELECT '{c}' AS attribute, min({c}) AS low, max({c}) AS high FROM lineitem" for c in NUMBERS))
def b10_attribute_bounds(t: Tables) -> DataFrame:
    return prepare.attribute_bounds(t.lineitem, NUMBERS)


@query("SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS weight FROM lineitem GROUP BY ALL")
def b11_compact_weighted(t: Tables) -> DataFrame:
    return prepare.compact_weighted(t.lineitem, ["l_returnflag", "l_linestatus", "l_quantity"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat(o_orderkey, ':0')), o_orderkey LIMIT 500")
def b12_bottom_k_sample(t: Tables) -> DataFrame:
    return prepare.bottom_k_sample(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query("SELECT c_custkey, c_acctbal FROM customer")
def b13_shuffle_rows(t: Tables) -> DataFrame:
    return prepare.shuffle_rows(t.customer.select("c_custkey", "c_acctbal"), "c_custkey")


@query("""WITH w AS (SELECT c_custkey, 1 + c_custkey % 3 AS weight FROM customer),
     cases AS (SELECT c_custkey, weight, unnest(range(1, weight + 1)) AS c FROM w),
     drawn AS (SELECT c_custkey FROM cases ORDER BY md5(concat_ws(':', c_custkey, c, '0')), c_custkey, c LIMIT 700)
     SELECT c_custkey, count(*) AS weight, 'train' AS part FROM drawn GROUP BY c_custkey
     UNION ALL
     SELECT w.c_custkey, w.weight - coalesce(d.n, 0), 'test' FROM w LEFT JOIN (SELECT c_custkey, count(*) AS n FROM drawn GROUP BY 1) d USING (c_custkey)
     WHERE w.weight > coalesce(d.n, 0)""")
def b14_split_weighted(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", (1 + F.col("c_custkey") % 3).alias("weight"))
    train, test = prepare.split_weighted(rows, "c_custkey", "weight", 700)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS batch FROM events")
def b15_fixed_batches(t: Tables) -> DataFrame:
    return prepare.fixed_batches(t.events.select("event_id"), "event_id", 300)


@query("""WITH m AS (SELECT sum(l_quantity * l_discount) / sum(l_quantity) AS md, sum(l_quantity * l_tax) / sum(l_quantity) AS mt FROM lineitem)
     SELECT 'l_discount' AS a, 'l_discount' AS b, round(md, 6) AS mean_a, round(md, 6) AS mean_b, round(sum(l_quantity * (l_discount - md) * (l_discount - md)) / sum(l_quantity), 8) AS covariance FROM lineitem, m GROUP BY md, mt
     UNION ALL SELECT 'l_discount', 'l_tax', round(md, 6), round(mt, 6), round(sum(l_quantity * (l_discount - md) * (l_tax - mt)) / sum(l_quantity), 8) FROM lineitem, m GROUP BY md, mt
     UNION ALL SELECT 'l_tax', 'l_tax', round(mt, 6), round(mt, 6), round(sum(l_quantity * (l_tax - mt) * (l_tax - mt)) / sum(l_quantity), 8) FROM lineitem, m GROUP BY md, mt""")
def b16_weighted_moments(t: Tables) -> DataFrame:
    return _round(_round(prepare.weighted_moments(t.lineitem, ["l_discount", "l_tax"], "l_quantity"), 6, "mean_a", "mean_b"), 8, "covariance")


@query(" UNION ALL ".join(f"SELECT '{c}' AS attribute, count({c}) AS n, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS sd, round(min({c}), 2) AS low, round(quantile_cont({c}, 0.5), 2) AS median, round(max({c}), 2) AS high FROM lineitem" for c in NUMBERS))
def c1_describe_table(t: Tables) -> DataFrame:
    return describe.describe_table(t.lineitem, NUMBERS)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[:i]))
def c2_correlation_matrix(t: Tables) -> DataFrame:
    return _round(describe.correlation_matrix(t.lineitem, NUMBERS), 6, "r")


@query(" UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) - count({c}) AS missing, count({c}) AS present FROM {HOLED}" for c in ("o_orderstatus", "o_totalprice", "o_orderpriority")))
def c3_missing_profile(t: Tables) -> DataFrame:
    return describe.missing_profile(holed(t), ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def c4_value_counts(t: Tables) -> DataFrame:
    return describe.value_counts(t.orders, "o_orderpriority")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 2) AS mean, round(stddev_samp(c_acctbal), 2) AS sd FROM customer GROUP BY 1")
def c5_group_mean_std(t: Tables) -> DataFrame:
    return describe.group_mean_std(t.customer, "c_mktsegment", "c_acctbal")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 2) AS of_category,
          round(100 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 2) AS of_group FROM orders GROUP BY 1, 2""")
def c6_category_share(t: Tables) -> DataFrame:
    return describe.category_share(t.orders, "o_orderstatus", "o_orderpriority")


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3, avg(c_acctbal) AS mean FROM customer GROUP BY 1)
     SELECT c_mktsegment, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(mean, 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high
     FROM customer JOIN q USING (c_mktsegment) WHERE c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def c7_boxplot_stats(t: Tables) -> DataFrame:
    return _round(describe.boxplot_stats(t.customer, "c_mktsegment", "c_acctbal"), 4, "q1", "median", "q3", "mean")


@query("""SELECT g.l_returnflag, c.l_linestatus, count(l.l_orderkey) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) g, (SELECT DISTINCT l_linestatus FROM lineitem) c
     LEFT JOIN lineitem l ON l.l_returnflag = g.l_returnflag AND l.l_linestatus = c.l_linestatus GROUP BY 1, 2""")
def c8_contingency_table(t: Tables) -> DataFrame:
    return describe.contingency_table(t.lineitem, "l_returnflag", "l_linestatus")


@query("""SELECT concat('c_', n_regionkey) AS row, count(*) FILTER (n_nationkey % 3 = 0) AS c_0, count(*) FILTER (n_nationkey % 3 = 1) AS c_1, count(*) FILTER (n_nationkey % 3 = 2) AS c_2 FROM nation GROUP BY 1""")
def a7_matrix(t: Tables) -> DataFrame:
    cells = t.nation.groupBy("n_regionkey", (F.col("n_nationkey") % 3).alias("j")).agg(F.count("*").alias("n"))
    return io.matrix(cells, "n_regionkey", "j", "n").fillna(0)
