"""Registered queries with, where SQL can state them, an equal query for a second engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.plans.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

# Moves exact rounding ties the same way in both engines, whatever their last bit.
NUDGE = 1.00000000001

# The test views of footfall.plans.adapters as SQL, in dependency order.
VIEWS: dict[str, str] = {
    "interactions": """SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE o_custkey END AS user_id, l_suppkey AS business_id,
 CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST((l_orderkey * 7 + l_linenumber * 61) % 1440 AS INT) AS ts,
 CASE WHEN l_returnflag = 'R' THEN 'checkin' ELSE 'review' END AS interaction_type,
 CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(1 + CAST(l_quantity AS INT) % 5 AS DOUBLE) END AS stars
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "reviews": "SELECT * FROM interactions WHERE user_id IS NOT NULL",
    "businesses": """SELECT s_suppkey AS business_id, s_name AS name, n_name AS city, r_name AS state,
 CAST(39.9 AS DOUBLE) + ((s_suppkey * 37) % 100) * CAST(0.001 AS DOUBLE) AS latitude,
 CAST(-75.2 AS DOUBLE) + ((s_suppkey * 53) % 100) * CAST(0.001 AS DOUBLE) + (s_suppkey // 100) * CAST(0.1 AS DOUBLE) AS longitude,
 CAST(1 + (s_suppkey % 9) * 0.5 AS DOUBLE) AS stars, CAST((s_suppkey * 13) % 200 AS INT) AS review_count,
 CASE s_suppkey % 5 WHEN 0 THEN 'Coffee & Tea, Food' WHEN 1 THEN 'Hotels, Resorts' WHEN 2 THEN 'Restaurants, Bars'
 WHEN 3 THEN 'Dinner Theater' ELSE NULL END AS categories
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "pois": """SELECT p_partkey AS poi_id, CAST(39.9 AS DOUBLE) + ((p_partkey * 41) % 1000) * CAST(0.0001 AS DOUBLE) AS lat,
 CAST(-75.2 AS DOUBLE) + ((p_partkey * 59) % 1000) * CAST(0.0001 AS DOUBLE) + (p_partkey // 2000) * CAST(0.1 AS DOUBLE) AS lon,
 p_type || ' ' || p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'food' ELSE 'hotels' END AS category FROM part""",
    "friendships": """SELECT x.o_custkey AS a, y.o_custkey AS b FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1""",
    "social_edges": "SELECT DISTINCT LEAST(a, b) AS user_a, GREATEST(a, b) AS user_b FROM friendships WHERE a <> b",
    "both_ways": "SELECT user_a AS u, user_b AS w FROM social_edges UNION ALL SELECT user_b, user_a FROM social_edges",
    "checkins_b": """SELECT o_custkey + 1000000 AS b_user_id, l_partkey AS poi_id, l_suppkey AS business_id,
 CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(l_orderkey % 96 AS INT) AS utc_ts, CAST(-300 AS INT) AS tz_offset_min
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "visits_a": """SELECT o_custkey AS user_id, l_partkey AS place_id,
 CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST((l_orderkey * 7 + l_linenumber * 61) % 1440 AS INT) AS ts
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'""",
    "visits_b": "SELECT b_user_id AS user_id, poi_id AS place_id, utc_ts AS ts FROM checkins_b",
    "ballots": """SELECT o_orderkey AS persona_id, o_orderpriority AS domain, o_orderstatus AS archetype,
 (CAST(trunc(o_totalprice) AS BIGINT) % 1000) / CAST(1000 AS DOUBLE) AS ndcg,
 (CAST(trunc(o_totalprice) AS BIGINT) % 777) / CAST(777 AS DOUBLE) AS stars_ndcg,
 CAST(o_custkey % 2 AS INT) AS pairwise_win, CAST(o_orderkey % 11 AS DOUBLE) AS revisit_score,
 (o_custkey % 97) / CAST(97 AS DOUBLE) AS model_revisit_signal, o_custkey AS person_id FROM orders""",
}


def view(name: str, sql: str) -> None:
    """A named SQL building block that oracles may read."""
    VIEWS[name] = sql


def _used(sql: str, seen: set[str]) -> set[str]:
    for name, body in VIEWS.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            seen.add(name)
            _used(body, seen)
    return seen


def with_views(sql: str) -> str:
    body = sql.strip()
    used = _used(body, set())
    ctes = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in used]
    if not ctes:
        return body
    lead = ",\n".join(ctes)
    recursive = body[:15].upper().startswith("WITH RECURSIVE")
    if body[:5].upper() == "WITH ":
        rest = body[15:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{lead},\n{rest.strip()}"
    return f"WITH {lead}\n{body}"


def query(name: str, covers: str, sql: str | None = None, rnd: str = "", digits: int = 6):
    """Register a query over :class:`Tables`; ``covers`` lists the inventory ids it exercises.

    ``rnd`` names the double columns both engines round, since they add floating point numbers in any order.
    """
    columns = rnd.split()

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.withColumns({c: F.round(F.col(c).cast("double") * NUDGE, digits) for c in columns}) if columns else out

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            text = with_views(sql)
            if columns:
                # Adding 0.0 turns a rounded minus zero into zero.
                fixed = ", ".join(f"ROUND(CAST({c} AS DOUBLE) * {NUDGE!r}e0, {digits}) + 0.0 AS {c}" for c in columns)
                text = f"SELECT * REPLACE ({fixed}) FROM (\n{text}\n) AS q"
            ORACLES[name] = text
        return fn

    return wrap
