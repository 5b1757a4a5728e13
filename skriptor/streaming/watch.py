"""A landing folder as a stream: per-text statistics and volume by time, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.operators import stats


def watch(spark: SparkSession, folder: str, schema: str, files_each: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def streamed_stats(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str | None = None) -> DataFrame:
    """``text_stats`` of a stream; stateless."""
    return stats.text_stats(texts, id_col, text_col, lang)


def volume_by_time(texts: DataFrame, time_col: str, text_col: str = "text", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(begin, end, texts, words) of tumbling windows; rows later than ``late`` are dropped in a stream."""
    words = F.regexp_count(F.col(text_col), F.lit(stats.T.COUNT_TOKEN)).cast("long")
    rows = texts.where(F.col(time_col).isNotNull()).select(F.col(time_col).cast("timestamp").alias("t"), F.coalesce(words, F.lit(0)).alias("words"))
    out = rows.withWatermark("t", late).groupBy(F.window("t", width)).agg(F.count(F.lit(1)).alias("texts"), F.sum("words").alias("words"))
    return out.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "texts", "words")


def sessions(events: DataFrame, user_col: str = "user_id", time_col: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, begin, end, events) of runs of events less than ``gap`` apart; works on streams and tables."""
    rows = events.where(F.col(user_col).isNotNull() & F.col(time_col).isNotNull())
    out = rows.groupBy(F.col(user_col), F.session_window(F.col(time_col).cast("timestamp"), gap)).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col(user_col).alias("user"), F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "events")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived, written as Parquet; what a checkpoint has seen is not read again."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
