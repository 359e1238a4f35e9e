"""Streaming forms: incident counts by day and stage, and queries against a standing corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import from_counts


def daily_counts(incidents: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, stage, incidents) in windows of a day; rows later than the watermark are dropped by the stream."""
    timed = incidents.withColumn("at", F.to_timestamp("recorded_at")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", "1 day"), "stage").agg(F.count(F.lit(1)).alias("incidents"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "stage", "incidents")


def stream_queries(queries: DataFrame, corpus: DataFrame, metric: str = "jaccard", threshold: float = 0.7):
    """A foreachBatch function's work: candidates of one micro-batch of query tokens in the corpus tokens."""
    n_q = queries.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_a")).withColumnRenamed("app_id", "a")
    n_c = corpus.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_b")).withColumnRenamed("app_id", "b")
    shared = queries.withColumnRenamed("app_id", "a").join(corpus.withColumnRenamed("app_id", "b"), ["layer", "token"]).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(n_q, "a").join(n_c, "b").withColumn("score", from_counts(metric, F.col("shared"), F.col("n_a"), F.col("n_b")))
    return scored.where(F.col("score") >= threshold).select("a", "b", "score")
