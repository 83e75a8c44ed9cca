"""Registry of queries with their SQL, and the SQL of the bound relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The bindings of ``veduta.binding`` as SQL.
RELATIONS = {
    "ev": "SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS event_type, o_orderstatus AS status, o_custkey AS venue_id, o_totalprice AS price FROM orders",
    "pr": "SELECT l_orderkey AS event_id, l_linenumber AS position, l_partkey AS work_id FROM lineitem",
    "cr": "SELECT l_orderkey AS event_id, l_linenumber AS position, l_suppkey AS artist_id, l_returnflag AS role FROM lineitem",
    "wk": "SELECT p_partkey AS work_id, p_name AS title, p_brand AS composer, p_type AS kind FROM part",
    "ar": "SELECT s_suppkey AS artist_id, s_name AS artist_name FROM supplier",
    "ve": "SELECT c_custkey AS venue_id, c_name AS venue, c_mktsegment AS organization, n_name AS city, r_name AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "li": "SELECT conv_id AS page, turn AS line_no, role, text FROM conversations",
}


def query(name: str, sql: str | None = None, using: str = "") -> Callable[[Query], Query]:
    """Registers a query; ``using`` names the relations that its SQL needs, put before it as CTEs."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            ctes = ", ".join(f"{r} AS ({RELATIONS[r]})" for r in using.split())
            if ctes:
                body = f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
            SQL[name] = body
        return f

    return register
