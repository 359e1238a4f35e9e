"""Sinks: exports of pairs, candidates, signatures and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a detailed result, missing ones are written as null.
DETAILED = ("pair_id", "app_a", "app_b", "full_similarity_score", "library_reduced_score", "status", "analysis_failed_reason", "views_used", "evidence")


def export_detailed(pairs: DataFrame, path: str) -> None:
    """Pair rows as JSON lines with all required fields and whatever others they have."""
    out = pairs.withColumns({c: F.lit(None).cast("string") for c in DETAILED if c not in pairs.columns})
    out = out.withColumn("pair_id", F.coalesce("pair_id", F.concat_ws("__", "app_a", "app_b")))
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_scored_csv(pairs: DataFrame, path: str) -> DataFrame:
    """Writes (pair_id, score, label) and returns (count, least, greatest); the first score that is there counts."""
    have = [F.col(c) for c in ("final_score", "post_fix_score", "retrieval_score", "score") if c in pairs.columns]
    label = F.coalesce(F.col("label"), F.lit("unknown")) if "label" in pairs.columns else F.lit("unknown")
    out = pairs.select(F.concat_ws("__", "app_a", "app_b").alias("pair_id"), F.coalesce(*have).alias("score"), label.alias("label"))
    out.write.mode("overwrite").option("header", True).csv(path)
    return out.agg(F.count(F.lit(1)).alias("count"), F.min("score").alias("least"), F.max("score").alias("greatest"))


def export_results_csv(rows: DataFrame, path: str) -> None:
    """Numbers with six decimals, nulls empty."""
    out = rows.select(*(F.format_string("%.6f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))
    out.select(*(F.when(F.col(c) == "null", None).otherwise(F.col(c)).alias(c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c) for c in rows.columns)).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def export_signatures(records: DataFrame, path: str, version: str) -> None:
    """One JSON line for each app in the order of app_id: layers, sorted signature tokens, version, status."""
    tokens = F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries("layers"), lambda e: F.transform(e["value"], lambda t: F.concat_ws(":", e["key"], t))))))
    out = records.select("app_id", "layers", F.coalesce(tokens, F.array().cast("array<string>")).alias("screening_signature"), F.lit(version).alias("signature_version"), F.when(F.col("layers").isNull() | (F.size("layers") == 0), "error").otherwise("ok").alias("status"))
    out.orderBy("app_id").write.mode("overwrite").json(path)


def evidence_markdown(rows: DataFrame) -> DataFrame:
    """(pair_id, markdown): the evidence array of each pair as a table."""
    line = lambda e: F.format_string("| %s | %s | %s | %.4f |", e["source_stage"], e["signal_type"], e["ref"], e["magnitude"])
    head = "| stage | signal | ref | magnitude |\n| --- | --- | --- | --- |"
    return rows.select("pair_id", F.when(F.size("evidence") > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform("evidence", line), "\n"))).otherwise("no evidence").alias("markdown"))
