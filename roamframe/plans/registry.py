"""Registry of named queries and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The commerce graph as common table expressions: v(vid, kind) and e(label, src, dst).
COMMERCE_SQL = """
v AS (
    SELECT 'region:' || r_regionkey AS vid, 'region' AS kind FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, 'part' FROM part
    UNION ALL SELECT 'order:' || o_orderkey, 'order' FROM orders
), e AS (
    SELECT 'in_region' AS label, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
    UNION ALL SELECT 'lives_in', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'based_in', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
    UNION ALL SELECT 'placed', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
    UNION ALL SELECT DISTINCT 'contains', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
    UNION ALL SELECT DISTINCT 'supplies', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem
)"""
NEXT_SQL = """
e AS (
    SELECT * FROM (SELECT 'order:' || o_orderkey AS src,
        'order:' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL
)"""
TRADE_SQL = """
e AS (
    SELECT 'nation:' || a AS src, 'nation:' || b AS dst, n AS doc FROM (
        SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM (
            SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
            WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)) WHERE r <= 2
)"""
PLACED_SQL = """
e AS (
    SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
)"""
FOLLOWS_SQL = """
f AS (
    SELECT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL
), e AS (SELECT src, dst, count(*) AS doc FROM f GROUP BY 1, 2)"""


def query(sql: str | None = None, given: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL over the common table expressions ``given``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{given.strip()}" if given else ""
            more = sql.strip()
            if head and more.startswith(","):
                ORACLE_SQL[f.__name__] = f"{head}{more}"
            else:
                ORACLE_SQL[f.__name__] = f"{head}\n{more}".strip()
        return f

    return add


def commerce_query(sql: str) -> Callable[[Query], Query]:
    return query(sql, COMMERCE_SQL)


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for given rows."""

    def lit(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"
