"""The engine's inputs drawn from the test tables: a lattice from ``orders``, lines from ``events``, a river tree from ``customer``.

Every row of a table is used. The lattice has ``SX`` columns and as many rows as the orders fill, padded to an odd number; the
samples of the last row that no order fills are missing data. ``SQL`` says the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SX = 65


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Cells ``row, col, cell, h`` (integer)``, code`` (0 to 15)``, kind, lake_id``, and the lattice's rows and columns."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    h = F.round(F.col("o_totalprice") * 100).cast("long")
    cells = orders.select(
        F.floor(key / SX).cast("int").alias("row"),
        (key % SX).cast("int").alias("col"),
        key.alias("cell"),
        h.alias("h"),
        (F.floor(h / 100000) % 16).cast("int").alias("code"),
        F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("kind"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 7 + 1).otherwise(0).cast("int").alias("lake_id"),
    )
    last = orders.agg(F.max("o_orderkey")).first()[0]
    rows = (last if last is not None else 0) // SX + 1
    return cells, 2 * (rows // 2) + 1, SX


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seg_id, ord`` (from 0)``, x, y, z, lake_id`` of a line for each user's events in order of time."""
    events = table(spark, sf_dir, "events")
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    place = F.row_number().over(along) - 1
    return events.select(F.col("user_id").alias("seg_id"), place.alias("ord"), F.col("value").alias("x"), (place * 3).cast("double").alias("y"), F.floor(F.col("value") * 100).cast("long").alias("z"), F.when(F.col("event_type").isin("error", "view"), F.col("event_id") % 3).otherwise(0).cast("int").alias("lake_id"))


def rivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seg_id, downstream, unit, area_km2, length, order`` and integer ends of a river for each customer, a binary tree."""
    key = F.col("c_custkey")
    at = lambda k, m: ((key * k) % m).cast("int")
    return table(spark, sf_dir, "customer").select(
        key.alias("seg_id"),
        F.when(key > 0, F.floor(key / 2)).alias("downstream"),
        F.col("c_nationkey").alias("unit"),
        F.floor("c_acctbal").cast("long").alias("area_km2"),
        (F.lit(64) * (key % 4 + 1)).alias("length"),
        (key % 5 + 1).cast("int").alias("order"),
        at(7, 40).alias("x0"),
        at(11, 37).alias("y0"),
        at(13, 40).alias("x1"),
        at(5, 37).alias("y1"),
    )


#: Common table expressions ``dim``, ``cells``, ``lines``, ``rivers``.
SQL = {
    "dim": "dim AS (SELECT 65 AS sx, (2 * ((max(o_orderkey) // 65 + 1) // 2) + 1)::INTEGER AS sy FROM orders)",
    "cells": """cells AS (SELECT (o_orderkey // 65)::INTEGER AS row, (o_orderkey % 65)::INTEGER AS col, o_orderkey AS cell, round(o_totalprice * 100)::BIGINT AS h,
        ((round(o_totalprice * 100)::BIGINT // 100000) % 16)::INTEGER AS code, CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS kind,
        (CASE WHEN o_orderstatus = 'O' THEN o_custkey % 7 + 1 ELSE 0 END)::INTEGER AS lake_id FROM orders)""",
    "lines": """lines AS (SELECT user_id AS seg_id, ord, value AS x, (ord * 3)::DOUBLE AS y, floor(value * 100)::BIGINT AS z,
        (CASE WHEN event_type IN ('error', 'view') THEN event_id % 3 ELSE 0 END)::INTEGER AS lake_id
        FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS ord FROM events))""",
    "rivers": """rivers AS (SELECT c_custkey AS seg_id, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS downstream, c_nationkey AS unit, floor(c_acctbal)::BIGINT AS area_km2,
        64 * (c_custkey % 4 + 1) AS length, (c_custkey % 5 + 1)::INTEGER AS "order", (c_custkey * 7 % 40)::INTEGER AS x0, (c_custkey * 11 % 37)::INTEGER AS y0,
        (c_custkey * 13 % 40)::INTEGER AS x1, (c_custkey * 5 % 37)::INTEGER AS y1 FROM customer)""",
}


def sql(query: str, *names: str) -> str:
    """``query`` after the expressions it needs; a query that begins with a comma goes on with its own."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + query
