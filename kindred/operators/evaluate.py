"""Evaluation: confusion counts, sweeps, calibration, agreement, bootstrap and summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.runtime import cut_lineage


def safe(a: Column, b: Column) -> Column:
    """a / b to six digits, 0 if b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))


def measures(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fpr and youden to counts tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn), "fpr": safe(fp, fp + tn)})
    return out.withColumn("youden", F.round(safe(tp, tp + fn) - safe(fp, fp + tn), 6))


def roc_grid(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts and measures at each threshold (scores at the threshold count as positive), in one aggregation."""
    parts = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= t
        parts += [F.count_if(hit & (F.col("label") == 1)).alias(f"tp{i}"), F.count_if(hit & (F.col("label") == 0)).alias(f"fp{i}")]
    wide = scored.agg(*parts, F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)))
    rows = wide.select("p", "q", F.explode(each).alias("x")).select("x.threshold", "x.tp", "x.fp", (F.col("p") - F.col("x.tp")).alias("fn"), (F.col("q") - F.col("x.fp")).alias("tn"))
    return measures(rows)


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> tuple[DataFrame, dict]:
    """(`rows` with `before_<c>`, the sum of c over all rows before in an order, the sums over all rows).

    A range sort deals the rows out, each partition's offset is the sum over
    the partitions before it, and only a partition's rows are summed in order.
    Equal places in the order must not occur.
    """
    ordered = cut_lineage(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()))
    parts = sorted(ordered.groupBy("_p").agg(*(F.sum(c).alias(c) for c in sums)).collect())  # one row for each partition
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ordered
    totals = {}
    for c in sums:
        held, starts = 0, []
        for r in parts:
            starts += [F.lit(r["_p"]), F.lit(held)]
            held += r[c] or 0
        totals[c] = held
        first = F.element_at(F.create_map(*starts), F.col("_p")) if starts else F.lit(0)
        out = out.withColumn(f"before_{c}", first + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop("_p"), totals


def roc_observed(scored: DataFrame) -> DataFrame:
    """Counts and measures at each observed score, from running sums over the distinct scores."""
    by = scored.groupBy(F.col("score").alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    sums, total = running(by, [F.desc("threshold")], ["p", "q"])
    tp, fp = F.col("before_p") + F.col("p"), F.col("before_q") + F.col("q")
    return measures(sums.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.lit(total["p"]) - tp).alias("fn"), (F.lit(total["q"]) - fp).alias("tn")))


def operating_point(roc: DataFrame) -> DataFrame:
    """The row with the greatest (f1, youden, -fpr, threshold)."""
    return roc.orderBy(F.desc("f1"), F.desc("youden"), "fpr", F.desc("threshold")).limit(1)


def simplex(layers: list[str], steps: int) -> list[dict[str, float]]:
    """All weights in steps of 1 / steps that add up to 1."""

    def parts(n: int, left: int) -> list[list[int]]:
        return [[left]] if n == 1 else [[i, *rest] for i in range(left + 1) for rest in parts(n - 1, left - i)]

    return [dict(zip(layers, (x / steps for x in p), strict=True)) for p in parts(len(layers), steps)]


def weight_search(wide: DataFrame, layers: list[str], steps: int = 20, thresholds: int = 100) -> DataFrame:
    """Best weights and threshold by F1: `wide` has a column for each layer and label 0 or 1.

    Grid points meet rows by an explode of a fixed array, scores fall into
    `thresholds` bins, and running sums over bins give every threshold's F1.
    """
    grid = simplex(layers, steps)
    points = F.array(*(F.struct(F.lit(i).alias("point"), *(F.lit(w[x]).alias(x) for x in layers)) for i, w in enumerate(grid)))
    rows = wide.select("label", *(F.col(x).alias(f"_{x}") for x in layers), F.explode(points).alias("g"))
    score = sum((F.col(f"g.{x}") * F.col(f"_{x}") for x in layers), F.lit(0.0))
    binned = rows.select("g.*", "label", F.floor(score * thresholds + 1e-9).alias("bin")).groupBy("point", *layers, "bin").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    down = Window.partitionBy("point").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("point")
    counts = binned.select(*layers, "point", (F.col("bin") / thresholds).alias("threshold"), F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), (F.sum("p").over(whole) - F.sum("p").over(down)).alias("fn"), (F.sum("q").over(whole) - F.sum("q").over(down)).alias("tn"))
    return measures(counts).orderBy(F.desc("f1"), F.desc("youden"), "fpr", F.desc("threshold"), "point").limit(1)


def split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """`rows` with `part` train or test: by label, in the order of a hash of key and seed, at least one in train."""
    by = Window.partitionBy("label")
    place = F.row_number().over(by.orderBy(F.xxhash64(F.lit(seed), key), key))
    size = F.count(F.lit(1)).over(by)
    return rows.withColumn("part", F.when(place <= F.greatest(F.lit(1), F.floor(size * share)), "train").otherwise("test"))


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(n, observed, expected, kappa) of two raters; kappa is 1 if chance alone agrees fully."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).count()
    both = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("count")).otherwise(0)).alias("same"))
    margins = cells.select(F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v"), F.col("count").alias("c")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v"), F.col("count").alias("c")))).alias("m")).groupBy("m.v").agg(F.sum(F.when(F.col("m.side") == "x", F.col("m.c")).otherwise(0)).alias("nx"), F.sum(F.when(F.col("m.side") == "y", F.col("m.c")).otherwise(0)).alias("ny"))
    chance = margins.agg(F.sum(F.col("nx") * F.col("ny")).alias("products"))
    out = both.join(chance).withColumns({"observed": F.col("same") / F.col("n"), "expected": F.col("products") / (F.col("n") * F.col("n"))})
    return out.select("n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.when(F.col("expected") >= 1, 1.0).otherwise(F.round((F.col("observed") - F.col("expected")) / (1 - F.col("expected")), 6)).alias("kappa"))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the mean rank of equal values."""
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    sums, _ = running(ties, [F.asc(value)], ["_n"])
    return rows.join(sums.select(value, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(out)), value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho) with tied ranks averaged; 1 if neither side varies, 0 if one does not."""
    ranked = average_ranks(average_ranks(rows.select(a, b), a, "_ra"), b, "_rb")
    got = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("r"), F.var_pop("_ra").alias("va"), F.var_pop("_rb").alias("vb"))
    return got.select("n", F.when((F.col("va") == 0) & (F.col("vb") == 0), 1.0).when((F.col("va") == 0) | (F.col("vb") == 0), 0.0).otherwise(F.round("r", 6)).alias("rho"))


def bootstrap(rows: DataFrame, value: str, key: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(median, low, high): median and 95 % interval of the resampled mean.

    Each row enters each resample a Poisson(1) number of times that follows from
    a hash of its key and the resample.  One pass adds up, for each task, the
    sums of all resamples.
    """
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, times = np.zeros(resamples), np.zeros(resamples)
        salts = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            for h, v in zip(pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["v"].to_numpy(float), strict=True):
                x = salts ^ h
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
                n = np.searchsorted(cuts, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")
                total += n * v
                times += n
        yield pd.DataFrame({"resample": np.arange(resamples), "total": total, "times": times})

    parts = rows.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(value).cast("double").alias("v")).mapInPandas(sums, "resample long, total double, times double")
    means = parts.groupBy("resample").agg((F.sum("total") / F.nullif(F.sum("times"), F.lit(0.0))).alias("mean"))
    return means.agg(*(F.round(F.percentile("mean", F.lit(q)), 6).alias(n) for q, n in ((0.5, "median"), (0.025, "low"), (0.975, "high"))))


def summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, median, population deviation, p90 and p95 (nearest rank), least and greatest."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop(v), 6).alias("deviation"),
        F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {value})").alias("p90"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.min(v).alias("least"), F.max(v).alias("greatest"),
    )


def shortlist_recall(clones: DataFrame, shortlist: DataFrame, total_pairs: int) -> DataFrame:
    """(clones, hits, recall, shortlist, shortlist_ratio) of candidate pairs (a, b)."""
    hits = clones.join(shortlist.select("a", "b"), ["a", "b"], "left_semi")
    one = clones.agg(F.count(F.lit(1)).alias("clones")).join(hits.agg(F.count(F.lit(1)).alias("hits"))).join(shortlist.agg(F.count(F.lit(1)).alias("shortlist")))
    return one.select("clones", "hits", safe(F.col("hits"), F.col("clones")).alias("recall"), "shortlist", (F.round(F.col("shortlist") / F.lit(max(total_pairs, 1)), 6)).alias("shortlist_ratio"))


def sample_by_hash(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows by the order of a hash, sorted by key: the same ones on any cluster."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).orderBy(key)


def recall_by_class(expected: DataFrame, found: DataFrame, classes: list[str]) -> DataFrame:
    """(kind, expected, hits, recall) of pairs (a, b, kind) among found pairs (a, b); a class without pairs has recall 0."""
    each = expected.join(found.select("a", "b").distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("hits"))
    named = expected.sparkSession.createDataFrame([(c,) for c in classes], "kind string")
    return named.join(each, "kind", "left").na.fill(0).select("kind", "expected", "hits", safe(F.col("hits"), F.col("expected")).alias("recall"))


def recall_grid(clones: DataFrame, candidates, settings: list[tuple[int, int]], total_pairs: int, target: float = 0.9) -> DataFrame:
    """(num_perm, bands, status, recall, false_negative_rate, shortlist, shortlist_ratio, balanced), a row for each setting.

    `candidates(num_perm, bands)` gives the shortlist (a, b).  A setting whose
    bands do not divide num_perm keeps a row with its status; `balanced` marks
    the shortest list whose recall reaches the target.
    """
    out = None
    for num_perm, bands in settings:
        where = {"num_perm": F.lit(num_perm), "bands": F.lit(bands)}
        if bands <= 0 or num_perm % bands:
            row = clones.sparkSession.range(1).select(F.lit("invalid").alias("status"), *(F.lit(None).cast(t).alias(n) for n, t in (("recall", "double"), ("shortlist", "long"), ("shortlist_ratio", "double"))))
        else:
            row = shortlist_recall(clones, candidates(num_perm, bands), total_pairs).select(F.lit("ok").alias("status"), F.col("recall").cast("double").alias("recall"), "shortlist", F.col("shortlist_ratio").cast("double").alias("shortlist_ratio"))
        row = row.withColumns(where)
        out = row if out is None else out.unionByName(row)
    reached = F.when(F.col("recall") >= target, F.struct("shortlist", "num_perm", "bands"))
    best = out.agg(F.min(reached).alias("best"))
    return out.join(F.broadcast(best)).select("num_perm", "bands", "status", "recall", F.round(1 - F.col("recall"), 6).alias("false_negative_rate"), "shortlist", "shortlist_ratio", F.coalesce((F.col("best.num_perm") == F.col("num_perm")) & (F.col("best.bands") == F.col("bands")), F.lit(False)).alias("balanced"))  # one row is broadcast


def calibrate_on_splits(train: DataFrame, test: DataFrame, thresholds: list[float], margin: float = 0.02) -> DataFrame:
    """(threshold, train_f1, test_f1, difference, within_margin): the operating point of the training part, measured on the test part."""
    point = operating_point(roc_grid(train, thresholds)).select("threshold", F.col("f1").alias("train_f1"))
    there = roc_grid(test, thresholds).select("threshold", F.col("f1").alias("test_f1"))
    both = point.join(there, "threshold")
    return both.select("threshold", "train_f1", "test_f1", F.round(F.col("test_f1") - F.col("train_f1"), 6).alias("difference"), (F.col("test_f1") <= F.col("train_f1") + margin).alias("within_margin"))


def weight_vectors(wide: DataFrame, vectors: dict[str, dict[str, float]], threshold: float = 0.5) -> DataFrame:
    """(config, tp, fp, fn, tn, f1, margin, mean_clone, mean_other) for each named weight vector over columns of scores, in one pass."""
    score = lambda w: sum((F.lit(x) * F.coalesce(F.col(c), F.lit(0.0)) for c, x in w.items()), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(n).alias("config"), score(w).alias("score")) for n, w in vectors.items()))
    rows = wide.select("label", F.explode(each).alias("x")).select("label", "x.config", "x.score")
    hit, clone = F.col("score") >= threshold, F.col("label") == 1
    got = rows.groupBy("config").agg(F.count_if(hit & clone).alias("tp"), F.count_if(hit & ~clone).alias("fp"), F.count_if(~hit & clone).alias("fn"), F.count_if(~hit & ~clone).alias("tn"), F.coalesce(F.avg(F.when(clone, F.col("score"))), F.lit(0.0)).alias("m1"), F.coalesce(F.avg(F.when(~clone, F.col("score"))), F.lit(0.0)).alias("m0"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return got.select("config", "tp", "fp", "fn", "tn", F.round(f1, 4).alias("f1"), F.round(F.col("m1") - F.col("m0"), 4).alias("margin"), F.round("m1", 4).alias("mean_clone"), F.round("m0", 4).alias("mean_other"))
