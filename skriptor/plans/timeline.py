"""Queries over time: volumes by window and sessions of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.plans import sql
from skriptor.session import load_spread as load
from skriptor.sources import files
from skriptor.streaming import watch


def volume_by_week(spark: SparkSession, d: str) -> DataFrame:
    return watch.volume_by_time(load(spark, d, "documents"), "saved_at", width="7 days")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return watch.sessions(load(spark, d, "events"))


def event_days(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").where("ts is not null")
    return rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


def corpus_listing(spark: SparkSession, d: str) -> DataFrame:
    return files.listed(load(spark, d, "documents").select("doc_id", "path"), extensions=["md", "html"])


def recoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text as bytes of one of several encodings, found out and decoded again."""
    codes = spark.createDataFrame([(0, "utf-8"), (1, "windows-1251"), (2, "KOI8-R")], "k int, code string")
    raw = load(spark, d, "documents").where("text is not null").withColumn("k", F.when(F.col("lang") == "ru", 1).when(F.col("lang") == "en", 0).otherwise(2)).join(F.broadcast(codes), "k")
    content = F.when(F.col("k") == 0, F.encode("text", "utf-8")).otherwise(_encoded(F.col("text"), F.col("k")))
    got = files.decoded(raw.select("doc_id", F.col("text").alias("original"), F.lit("a.txt").alias("path"), content.alias("content")))
    return got.groupBy("encoding").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("text") == F.col("original"), 1)).alias("restored"))


def _encoded(text, k):
    @F.pandas_udf("binary")
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x.encode(("utf-8", "cp1251", "koi8-r")[i], "replace") for x, i in zip(t, n)])

    return run(text, k)


QUERIES = {f.__name__: f for f in (volume_by_week, event_sessions, event_days, corpus_listing, recoded)}

ORACLE = {
    "volume_by_week": f"""SELECT time_bucket(INTERVAL 7 DAY, CAST(saved_at AS TIMESTAMP), TIMESTAMP '1970-01-01') AS begin, time_bucket(INTERVAL 7 DAY, CAST(saved_at AS TIMESTAMP), TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS "end",
count(*) AS texts, sum(coalesce(len({sql.all_matches('text', T.COUNT_TOKEN)}), 0))::BIGINT AS words FROM documents WHERE saved_at IS NOT NULL GROUP BY ALL""",
    "event_days": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id AS user, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n""",
    "corpus_listing": f"""SELECT doc_id, path FROM documents WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('md', 'html')
AND NOT list_has_any(string_split(path, '/'), {files.W.SERVICE_FOLDERS!r})""",
}
