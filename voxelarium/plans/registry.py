"""Registered queries: a callable on ``(spark, sf_dir)`` and, where SQL can say it, its equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding zero removes the sign of ``-0.0``."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


# Views of the test tables in the SQL dialect of the check.
VOX = """vox AS (
  SELECT vec_id AS case_id, CAST(p // 16 AS INTEGER) AS modality, CAST((p % 16) // 4 AS INTEGER) AS x,
         CAST((p % 4) // 2 AS INTEGER) AS y, CAST(p % 2 AS INTEGER) AS z, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings))"""
VOX64 = """vox64 AS (
  SELECT vec_id AS case_id, CAST(p // 16 AS INTEGER) AS x, CAST((p % 16) // 4 AS INTEGER) AS y,
         CAST(p % 4 AS INTEGER) AS z, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings))"""
SCAN = """scan AS (
  SELECT user_id AS patient, CAST(ts AS DATE) AS day,
         CAST(user_id * 100 + (day(ts) - 1) // 7 AS BIGINT) AS case_id, event_type AS modality, value
  FROM events)"""
SEG = """seg AS (
  SELECT l_orderkey AS case_id, l_linenumber AS vox, CAST(l_quantity AS INTEGER) % 5 AS label FROM lineitem)"""
LAB = """lab AS (
  SELECT l.doc_id AS case_id, l.quality AS grade, d.n_chars AS wt_volume,
         CASE WHEN l.toxic = 1 THEN d.n_chars % 97 ELSE 0 END AS et_volume
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
PRED = """pred AS (
  SELECT event_id AS case_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label,
         (value - 40.0::DOUBLE) / 20.0::DOUBLE AS logit
  FROM events)"""
HIST = """hist AS (
  SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, round(avg(value), 6) AS val_loss
  FROM events GROUP BY ALL)"""
