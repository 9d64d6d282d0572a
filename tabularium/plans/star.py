"""Statement families that users run on ingested tables, over the star schema.

Every family is SQL text that goes through the guarded run; Catalyst does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabularium.operators.sqlguard import run_guarded
from tabularium.plans.contract import contract


def _guarded(spark: SparkSession, sf: str, sql: str, *tables: str) -> DataFrame:
    return run_guarded(spark, sql, {name: f"{sf}/{name}.parquet" for name in tables})


_FILTER = """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size_class
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.03 AND 0.07"""


@contract("sql_filter_project", _FILTER)
def sql_filter_project(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, arithmetic and CASE."""
    return _guarded(spark, sf, _FILTER, "lineitem")


_STAR = """SELECT r_name, n_name, p_type, count(*) AS items,
CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
GROUP BY r_name, n_name, p_type"""


@contract("sql_join_star", _STAR)
def sql_join_star(spark: SparkSession, sf: str) -> DataFrame:
    """Star join; small sides are broadcast by their statistics."""
    return _guarded(spark, sf, _STAR, "lineitem", "orders", "customer", "nation", "region", "part")


_SEMI = """SELECT c_custkey, finished IS NOT NULL AS has_finished FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey AS finished FROM orders WHERE o_orderstatus = 'F') f ON finished = c_custkey
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"""


@contract(
    "sql_semi_anti",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_finished
    FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def sql_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with and without a partner."""
    return _guarded(spark, sf, _SEMI, "customer", "orders")


_THETA = """SELECT c_mktsegment, count(*) AS orders FROM orders JOIN
(SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment) bands
ON o_totalprice >= low AND o_totalprice < high GROUP BY c_mktsegment"""


@contract("sql_theta_join", _THETA)
def sql_theta_join(spark: SparkSession, sf: str) -> DataFrame:
    """Inequality join of orders with the balance band of every segment. The
    bands, one row per segment, are the small side that Spark broadcasts."""
    return _guarded(spark, sf, _THETA, "orders", "customer")


_HAVING = """SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS priorities, max(o_totalprice) AS largest
FROM orders GROUP BY o_custkey HAVING count(*) >= 8"""


@contract("sql_group_having", _HAVING)
def sql_group_having(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping with HAVING and a distinct aggregate."""
    return _guarded(spark, sf, _HAVING, "orders")


_OVER = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_WINDOW = f"""SELECT o_orderkey, o_custkey, CAST(row_number() OVER ({_OVER}) AS INT) AS place, lag(o_orderkey) OVER ({_OVER}) AS previous,
round(sum(o_totalprice) OVER ({_OVER} ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders"""


@contract("sql_window", _WINDOW)
def sql_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rank, lag and a running sum per customer, all in one window."""
    return _guarded(spark, sf, _WINDOW, "orders")


_TOP = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"


@contract("sql_topk", _TOP)
def sql_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Order with limit, through the guard."""
    return _guarded(spark, sf, _TOP, "orders")


_SETS = """SELECT 'both' AS kind, k FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier) a
UNION ALL SELECT 'unused part', k FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem) b
UNION ALL SELECT 'nation', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) c"""


@contract("sql_set_ops", _SETS)
def sql_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """INTERSECT, EXCEPT and UNION."""
    return _guarded(spark, sf, _SETS, "lineitem", "supplier", "part", "customer")


_ABOVE = """SELECT p_type, count(*) AS parts, round(avg(p_retailprice), 4) AS mean FROM part p
WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)
AND p_size >= (SELECT avg(p_size) FROM part) GROUP BY p_type ORDER BY p_type"""


@contract("sql_subquery", _ABOVE)
def sql_subquery(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar and correlated subqueries, through the guard."""
    return _guarded(spark, sf, _ABOVE, "part")
