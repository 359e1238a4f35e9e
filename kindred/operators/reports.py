"""Pair generators, comparisons of runs, and reports over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled_pairs(apps: DataFrame) -> DataFrame:
    """(a, b, label) of apps (app_id, package, signer) that share a package: 1 if the signing key is the same too.

    Null keys never match.  Pairs of other packages are all 0 and are left to a
    sampler.
    """
    side = lambda x: apps.select(F.col("app_id").alias(x), "package", F.col("signer").alias(f"s_{x}"))
    return side("a").join(side("b"), "package").where("a < b").select("a", "b", F.coalesce(F.col("s_a") == F.col("s_b"), F.lit(False)).cast("int").alias("label"))


def group_representatives(apps: DataFrame, group: str = "package") -> DataFrame:
    """(group, a, b): the smallest and the greatest app of each group of two or more."""
    return apps.groupBy(group).agg(F.min("app_id").alias("a"), F.max("app_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select(group, "a", "b")


def version_pairs(apps: DataFrame, group: str = "package", version: str = "version") -> DataFrame:
    """(group, a, b, step): each version with the next (1) and the one after (2)."""
    w = Window.partitionBy(group).orderBy(version, "app_id")
    both = apps.select(group, F.col("app_id").alias("a"), F.array(F.struct(F.lit(1).alias("step"), F.lead("app_id", 1).over(w).alias("b")), F.struct(F.lit(2).alias("step"), F.lead("app_id", 2).over(w).alias("b"))).alias("n"))
    return both.select(group, "a", F.explode("n").alias("x")).select(group, "a", "x.b", "x.step").where("b is not null")


def dual_ranking(rows: DataFrame, group: str, key: str, plain: str, reduced: str) -> DataFrame:
    """Ranks by both scores within a group, and whether they differ."""
    rank = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), key)).cast("long")
    out = rows.withColumns({"rank_plain": rank(plain), "rank_reduced": rank(reduced)})
    return out.withColumn("ranking_changed", F.col("rank_plain") != F.col("rank_reduced"))


def step_over_previous(rows: DataFrame, order: str, seconds: str, gain: float = 1.10) -> DataFrame:
    """Rows with speed-up against the first row and against the row before, and whether the last gain is enough."""
    w = Window.orderBy(order)
    first = F.first(seconds).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.withColumns({"speedup": F.round(first / F.col(seconds), 6), "step": F.round(F.lag(seconds).over(w) / F.col(seconds), 6)})
    return out.withColumn("worth_it", F.coalesce(F.col("step") >= gain, F.lit(True)))


def merge_noise(elements: DataFrame, limit: int = 10) -> DataFrame:
    """(category, action, reason, n, elements): elements of each group, distinct and sorted, at most `limit` shown."""
    grouped = elements.groupBy("category", "action", "reason").agg(F.count_distinct("element").alias("n"), F.array_sort(F.collect_set("element")).alias("all"))
    return grouped.select("category", "action", "reason", "n", F.slice("all", 1, limit).alias("elements"))


def combination_counts(rows: DataFrame, key: list[str], part: str) -> DataFrame:
    """(combination, n): how often each sorted set of parts occurs among keys."""
    sets = rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(part)), "+").alias("combination"))
    return sets.groupBy("combination").agg(F.count(F.lit(1)).alias("n"))


def faithfulness(features: Column, important: Column) -> Column:
    """(faithfulness, sufficiency, comprehensiveness) of the features that a hint names.

    A row's score is the sum of absolute feature values over their total;
    sufficiency is what the named ones hold of it, comprehensiveness what is
    lost without them, faithfulness the share of named features that hold any.
    """
    size = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + F.abs(v))
    named = F.map_filter(features, lambda k, _: F.array_contains(important, k))
    total = size(features)
    held = F.when(total > 0, F.round(size(named) / total, 6)).otherwise(0.0)
    useful = F.size(F.filter(important, lambda k: F.coalesce(F.abs(F.try_element_at(features, k)), F.lit(0.0)) > 0))
    return F.struct(F.when(F.size(important) > 0, F.round(useful / F.size(important), 6)).otherwise(0.0).alias("faithfulness"), held.alias("sufficiency"), held.alias("comprehensiveness"))


#: Channels of a hint and the words that point to them, the first that is met counts.
CHANNELS = (("signing", "sign|certificate"), ("obfuscation", "obfusc"), ("library", "librar|sdk"), ("component", "component|activity|service|receiver|provider"), ("resource", "resource|icon|layout"), ("code", "code|method|class"))


def channel(text: Column) -> Column:
    """The channel that a hint's text speaks of, null for none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(CHANNELS):
        out = F.when(F.lower(text).rlike(words), name).otherwise(out)
    return out


def detector_quality(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, coverage) of detected (app_id, tpl_id) against the truth, over all apps."""
    hit = predicted.select("app_id", "tpl_id").distinct().withColumn("p", F.lit(1)).join(truth.select("app_id", "tpl_id").distinct().withColumn("t", F.lit(1)), ["app_id", "tpl_id"], "full_outer")
    got = hit.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"), F.count_distinct(F.when(F.col("p").isNotNull(), F.col("app_id"))).alias("covered"), F.count_distinct(F.when(F.col("t").isNotNull(), F.col("app_id"))).alias("apps"))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return got.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(F.col("covered"), F.col("apps")).alias("coverage"))


def replay_deltas(before: DataFrame, after: DataFrame, key: list[str], value: str, segment: str) -> DataFrame:
    """(segment, n, mean_before, mean_after, mean_delta, least_delta, greatest_delta) of two scorings of the same pairs."""
    return delta_summary(before.select(*key, segment, F.col(value).alias("x")).join(after.select(*key, F.col(value).alias("y")), key), segment)


def delta_summary(both: DataFrame, segment: str) -> DataFrame:
    """replay_deltas of rows that hold both scores, x before and y after."""
    d = F.col("y") - F.col("x")
    return both.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), *(F.round(f(c), 6).alias(n) for n, f, c in (("mean_before", F.avg, F.col("x")), ("mean_after", F.avg, F.col("y")), ("mean_delta", F.avg, d), ("least_delta", F.min, d), ("greatest_delta", F.max, d))))


def shortcut_control(shortcuts: DataFrame, verified: DataFrame, threshold: float, share: float = 0.1, seed: int = 42) -> DataFrame:
    """(sampled, below, fpr): a hashed sample of shortcut pairs (at least one), verified in full."""
    n = shortcuts.count()
    sample = shortcuts.orderBy(F.xxhash64(F.lit(seed), "pair_id"), "pair_id").limit(max(1, -(-int(n * share * 1_000_000) // 1_000_000)))
    got = sample.join(verified.where("status <> 'analysis_failed'"), "pair_id").agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("score") < threshold).alias("below"))
    return got.select("sampled", "below", F.when(F.col("sampled") == 0, 0.0).otherwise(F.round(F.col("below") / F.col("sampled"), 6)).alias("fpr"))
