"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None) -> DataFrame:
    """(id, label): the smallest vertex that `id` reaches, for each vertex of an edge.

    Minimum labels travel over the edges and are then followed one step
    (pointer jumping), so that rounds grow with the logarithm of the longest
    path.  Each round is two joins and one pre-aggregated minimum; no
    neighbour list is ever gathered.  Null ends and loops are left out; an
    empty edge table gives an empty result.
    """
    tables = tables or Tables(edges.sparkSession)
    kept = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = tables.keep(kept.union(kept.select("b", "a")).distinct())
    labels = tables.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"), (F.col("m") < F.col("a")).alias("moved")))
    while labels.where("moved").limit(1).count():
        far = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "id")
        near = labels.select("id", "label").join(far, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        now = F.least("label", "up")
        after = tables.keep(near.join(up, "label", "left").select("id", now.alias("label"), (now < F.col("was")).alias("moved")))
        tables.drop(labels)
        labels = after
    tables.drop(both)
    return tables.seen_as(labels, labels.select("id", "label"))
