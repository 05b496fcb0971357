"""Registered queries: a name, the function that builds the DataFrame, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The panel of readings as SQL: hundredths as integers, so that sums do not depend on their order.
READINGS_SQL = """
r AS (SELECT CAST(user_id AS VARCHAR) AS sensor_id, event_type AS network, user_id % 3 AS city, ts,
             CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hr, CAST(round(value * 100) AS BIGINT) AS cents
      FROM events WHERE value IS NOT NULL),
d AS (SELECT sensor_id, city, date, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n, count(DISTINCT hr) AS hours,
             CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS value
      FROM r GROUP BY sensor_id, city, date),
b AS (SELECT min(date) AS lo, max(date) AS hi FROM r),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
s AS (SELECT DISTINCT sensor_id, city FROM r),
grid AS (SELECT s.sensor_id, s.city, days.date, d.value, coalesce(d.hours, 0) AS hours
         FROM s CROSS JOIN days LEFT JOIN d ON d.sensor_id = s.sensor_id AND d.date = days.date)
"""
SITES_SQL = """
site AS (SELECT sensor_id, city, id, 23.70 + ((id * 7919) % 1000) / CAST(4000 AS DOUBLE) AS lat, 90.35 + ((id * 104729) % 1000) / CAST(4000 AS DOUBLE) AS lon
         FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sensor_id, user_id % 3 AS city, user_id AS id FROM events WHERE value IS NOT NULL))
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` may start from the tables of ``READINGS_SQL``."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put
