"""Registration of queries and the inputs they derive from the given tables.

A derivation is one SQL text for Spark and DuckDB; `{table}` is a given table, `[name]` another derivation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DERIVED = {
    "obs": "SELECT user_id AS station, ts AS time, event_type AS kind, value, event_id, 25 + user_id % 25 AS lat, -125 + user_id % 59 AS lon FROM {events}",
    "frame": "SELECT user_id AS series, ts AS time, event_id AS key FROM {events} WHERE event_type = 'view'",
    "site": "SELECT s_suppkey AS site, s_name AS name, -125 + s_suppkey % 59 AS lon, 25 + (s_suppkey * 7) % 25 AS lat FROM {supplier}",
    "place": "SELECT c_custkey AS place, c_name AS name, -125 + c_custkey % 59 AS lon, 25 + (c_custkey * 7) % 25 AS lat, c_acctbal AS acctbal FROM {customer}",
    "cell": "SELECT l_partkey % 64 AS i, (l_suppkey % 32) * 2 + l_linenumber % 2 AS j, SUM(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2",
    "member": "SELECT l_partkey % 64 AS i, (l_suppkey % 32) * 2 + l_linenumber % 2 AS j, l_orderkey % 31 AS member, SUM(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2, 3",
    "field": "SELECT l_partkey % 64 AS i, (l_suppkey % 32) * 2 + l_linenumber % 2 AS j, AVG(l_quantity) - 25 AS u, AVG(l_tax * 500) - 20 AS v, 250 + AVG(l_discount * 500) AS t, 100 * AVG(l_tax) / 0.08 AS rh, AVG(l_extendedprice) / 10 AS cape, AVG(l_quantity) * 8 - 100 AS srh, COUNT(*) AS n FROM {lineitem} GROUP BY 1, 2",
    "grid": "SELECT l_suppkey AS run, 6 * l_linenumber AS hour, l_partkey % 4 AS i, l_orderkey % 3 AS j, AVG(l_quantity) AS q, AVG(ROUND(l_discount * 100)) AS d, AVG(ROUND(l_tax * 100)) AS x, CAST(COUNT(*) AS DOUBLE) AS n FROM {lineitem} GROUP BY 1, 2, 3, 4",
    "scene": "SELECT event_id AS scene, ts AS time, -130 + event_id % 40 AS west, 20 + event_id % 27 AS south, -120 + event_id % 40 AS east, 28 + event_id % 27 AS north FROM {events} WHERE event_type = 'view'",
    "mosaic": "SELECT event_id AS frame, ts AS time FROM {events} WHERE event_type = 'click'",
    "run_cell": "SELECT l_suppkey AS run, l_partkey % 12 AS i, l_orderkey % 12 AS j, SUM(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2, 3",
    "accumulation": "SELECT run, hour, SUM(q) OVER (PARTITION BY run ORDER BY hour) AS value FROM (SELECT l_suppkey AS run, l_linenumber * 3 AS hour, SUM(l_quantity) AS q FROM {lineitem} GROUP BY 1, 2) AS x",
    "gate0": "SELECT l_suppkey % 16 AS sweep, (l_orderkey % 720) * 0.5 + 0.25 AS azimuth, l_partkey % 60 AS gate, CASE WHEN (l_orderkey % 720 + l_partkey % 60) % 11 = 0 THEN 0 ELSE MAX(CAST(FLOOR(l_quantity) AS INT)) + 1 END AS code FROM {lineitem} GROUP BY 1, 2, 3, (l_orderkey % 720 + l_partkey % 60) % 11",
    "gate": "SELECT sweep, CAST(azimuth AS DOUBLE) AS azimuth, gate, CAST(code AS INT) AS code, CASE WHEN code >= 2 THEN (code - 30) / CAST(2 AS DOUBLE) END AS value, 2000 + gate * 250 AS range_m FROM [gate0] AS g",
    "pixel": "SELECT i AS row, j AS col, 190 + value % 90 AS t13, 190 + value % 90 - value % 5 AS t15, 190 + value % 90 - 10 + value % 13 AS t8 FROM [cell] AS c",
    "flash": "SELECT ts AS time, user_id % 12 AS row, event_id % 20 AS col FROM {events} WHERE event_type = 'error'",
    "alert": "SELECT o_orderkey AS id, o_orderdate AS sent, o_orderkey % 5 + 1 AS days, CASE o_orderpriority WHEN '1-URGENT' THEN 'Tornado Warning' WHEN '2-HIGH' THEN 'Severe Thunderstorm Warning' WHEN '3-MEDIUM' THEN 'Flash Flood Warning' WHEN '4-NOT SPECIFIED' THEN 'Tornado Watch' ELSE 'Frost Advisory' END AS event, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS ref, o_orderstatus = 'P' AS cancel FROM {orders}",
    "polygon": "SELECT n_nationkey AS poly, -120.0 + 2 * n_nationkey AS cx, 30.0 + n_nationkey % 15 AS cy FROM {nation}",
    "report": "SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 'TORNADO' WHEN 1 THEN 'FUNNEL CLOUD' WHEN 2 THEN 'HAIL' WHEN 3 THEN 'HEAVY SNOW' WHEN 4 THEN 'FLASH FLOOD' WHEN 5 THEN 'TSTM WND DMG' WHEN 6 THEN 'LIGHTNING' ELSE 'NON-TSTM WND GST' END AS typetext, n_chars, source, substr(text, 1, 40) AS remark FROM {documents}",
    "profile": "SELECT l_suppkey AS profile, 1000 - 25 * (l_partkey % 30) AS p, AVG(l_quantity) - 20 AS u, AVG(l_tax * 500) - 20 AS v, 30 - (l_partkey % 30) * 2.5 + AVG(l_discount) * 20 AS t, 22 - (l_partkey % 30) * 3 + AVG(l_tax) * 20 AS td, (l_partkey % 30) * 300.0 AS zagl FROM {lineitem} GROUP BY 1, 2, l_partkey % 30",
}


def derivation(name: str, source) -> str:
    text = re.sub(r"\[(\w+)\]", lambda m: f"({derivation(m[1], source)})", DERIVED[name])
    return re.sub(r"\{(\w+)\}", lambda m: source(m[1]), text)


def sql(body: str) -> str:
    """DuckDB text: `[name]` becomes the derivation, everything else stays."""
    return re.sub(r"\[(\w+)\]", lambda m: f"({derivation(m[1], lambda t: t)})", body)


class Inputs:
    """t('events') reads a given table, d('obs') derives an input from the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def d(self, name: str) -> DataFrame:
        names: set[str] = set()
        text = derivation(name, lambda t: names.add(t) or "{" + t + "}")
        return self.spark.sql(text, **{n: self.t(n) for n in names})


def query(name: str, oracle: str | None = None):
    def put(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return put
