"""Library masks, noise gates and the scores that leave library tokens out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity
from kindred.operators.simjoin import longest_prefix

# Package prefixes that mark library code.
LIBRARY_PREFIXES = (
    "android", "androidx", "com.airbnb", "com.bumptech", "com.facebook", "com.google", "com.squareup", "dagger", "io.reactivex", "java", "javax",
    "kotlin", "kotlinx", "okhttp3", "okio", "org.apache", "org.bouncycastle", "org.intellij", "org.jetbrains", "org.json", "retrofit2", "rx",
)


def noise_gate(records: DataFrame, reject_triggers: list[str], triggers: str = "envelope_triggers") -> tuple[DataFrame, DataFrame]:
    """(passed, rejected): rejected records have a trigger of the list; the reason is the first in the list's order.

    Without triggers, or with an empty list, everything passes.  The two parts
    are disjoint and cover the input.
    """
    reason = F.lit(None).cast("string")
    for trigger in reversed(reject_triggers):
        reason = F.when(F.array_contains(F.coalesce(F.col(triggers), F.array().cast("array<string>")), trigger), trigger).otherwise(reason)
    marked = records.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def effective_triggers(row: Column, envelope: Column, warnings: Column, gate: Column, packers: Column, ad_sdk: Column) -> Column:
    """All triggers of a record in order of precedence, repeats kept; `fake` and `adware` come from runtime findings."""
    none = F.array().cast("array<string>")
    fake = F.when((gate == "blocked") | (F.size(F.coalesce(packers, none)) > 0), F.array(F.lit("fake"))).otherwise(none)
    adware = F.when(ad_sdk, F.array(F.lit("adware"))).otherwise(none)
    return F.concat(*(F.coalesce(x, none) for x in (row, envelope, warnings)), fake, adware)


def apply_token_mask(tokens: DataFrame, mask: DataFrame) -> DataFrame:
    """Tokens without those in the mask (layer, token)."""
    return tokens.join(mask.select("layer", "token").distinct(), ["layer", "token"], "left_anti").select(tokens.columns)


def apply_prefix_mask(tokens: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Tokens whose text after the first colon is not a masked package or inside one.

    A package covers what equals it or goes on with a dot or a slash.
    """
    marked = tokens.withColumn("_path", F.translate(F.when(F.col("token").contains(":"), F.expr("substring(token, instr(token, ':') + 1)")).otherwise(F.col("token")), "/", "."))
    found = longest_prefix(marked, prefixes, name="_path", prefix="prefix")
    return found.where("matched_prefix is null").select(tokens.columns)


def reduced_score(tokens: DataFrame, pairs: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """(a, b, library_reduced_score): Jaccard over all layers' tokens without the library tokens of either side.

    `library` (layer, token) replaces the default, the tokens of layer
    `library` of both sides.  Nothing left on either side scores 0.
    """
    if library is None:
        left = tokens.where("layer <> 'library'")
    else:
        left = apply_token_mask(tokens.where("layer <> 'library'"), library)
    keyed = left.select("app_id", F.xxhash64("layer", "token").alias("key")).distinct()
    sets = keyed.groupBy("app_id").agg(F.collect_set("key").alias("set"))
    none = F.array().cast("array<bigint>")
    both = pairs.join(sets.select(F.col("app_id").alias("a"), F.col("set").alias("x")), "a", "left").join(sets.select(F.col("app_id").alias("b"), F.col("set").alias("y")), "b", "left")
    score = similarity.jaccard(F.coalesce("x", none), F.coalesce("y", none))
    return both.select("a", "b", score.alias("library_reduced_score"))


def reduced_of_counts(layers: list[str]) -> Column:
    """reduced_score of a row of blocks.group_counts."""
    total = lambda c: sum((F.col(f"{c}_{i}") for i, x in enumerate(layers) if x != "library"), F.lit(0))
    return similarity.from_counts("jaccard", total("shared"), total("n_a"), total("n_b"))


def gate_decision(packers: Column, obfuscators: Column, manipulators: Column) -> Column:
    """(gate_status, library_detector) from classifier findings, packers first."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    status = F.when(some(packers), "blocked").when(some(obfuscators) | some(manipulators), "needs_detector").otherwise("clean")
    return F.struct(status.alias("gate_status"), F.when(some(packers), "none").when(some(obfuscators) | some(manipulators), "library_detector").otherwise("prefix_catalog").alias("detector"))


def arbitrate(library: Column, total: Column) -> Column:
    """(noise_status, confidence_status) from the share of library elements."""
    share = library / F.nullif(total, F.lit(0))
    return F.struct(
        F.when(total == 0, "blocked").when(share >= 0.5, "noisy").when(share > 0, "unknown").otherwise("clean").alias("noise_status"),
        F.when(total == 0, "blocked").when((share > 0) & (share < 0.5), "partial").otherwise("success").alias("status"),
    )


#: Categories of files in order of priority.
NOISE_CATEGORIES = ("unstable", "packaging", "autogenerated", "library", "app_specific")


def classify_file(path: Column, library_packages: tuple[str, ...] = LIBRARY_PREFIXES) -> Column:
    """(category, reason) of a file path; the first rule that holds counts."""
    name = F.element_at(F.split(path, "/"), -1)
    dotted = F.translate(F.regexp_replace(path, r"^smali(_classes[0-9]+)?/", ""), "/", ".")
    library = F.lit(False)
    for prefix in library_packages:
        library = library | (dotted == prefix) | dotted.startswith(prefix + ".")
    rules = (
        ("unstable", path.startswith("META-INF/") | name.rlike(r"\.(RSA|DSA|EC|SF|MF)$"), "signing data"),
        ("packaging", name.isin("AndroidManifest.xml", "resources.arsc", "apktool.yml") | path.startswith("original/"), "packaging file"),
        ("autogenerated", name.rlike(r"^(R|R\$.*|BuildConfig|Manifest)\.(smali|class|java)$") | name.contains("$$Lambda"), "generated class"),
        ("library", library, "library package"),
    )
    category, reason = F.lit("app_specific"), F.lit("application file")
    for kind, holds, why in reversed(rules):
        category, reason = F.when(holds, kind).otherwise(category), F.when(holds, why).otherwise(reason)
    return F.struct(category.alias("category"), reason.alias("reason"))


def noise_summary(files: DataFrame) -> DataFrame:
    """One row per app with the number of files of each category, zeros included."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in NOISE_CATEGORIES]
    return files.groupBy("app_id").agg(*counts)
