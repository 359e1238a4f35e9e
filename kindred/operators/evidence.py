"""Evidence records, their summaries, and what they are taken to mean.

An evidence record is a struct (source_stage, signal_type, magnitude, ref) with
the magnitude between 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import clamp_unit

EVIDENCE = "struct<source_stage:string,signal_type:string,magnitude:double,ref:string>"
STAGES = ("screening", "pairwise", "signing")


def record(stage: Column | str, signal: Column | str, magnitude: Column, ref: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(stage).alias("source_stage"), lit(signal).alias("signal_type"), clamp_unit(magnitude).alias("magnitude"), ref.alias("ref"))


def from_layers(layers: Column, stage: str = "screening") -> Column:
    """A record for each named layer of a map from layer to score."""
    named = F.filter(F.map_entries(layers), lambda e: F.trim(e["key"]) != "")
    return F.transform(named, lambda e: record(stage, "layer_score", e["value"], F.trim(e["key"])))


def summarise(records: Column) -> Column:
    """(total, mean_magnitude, dominant) of an array of records; the dominant ref has the greatest magnitude, then the first letter, then place in the array."""
    best = F.array_max(F.transform(records, lambda e, i: F.struct(e["magnitude"].alias("m"), (-F.ascii(e["ref"])).alias("c"), (-i).alias("i"), e["ref"].alias("ref"))))
    mean = F.aggregate(records, F.lit(0.0), lambda acc, e: acc + e["magnitude"]) / F.size(records)
    return F.struct(F.size(records).cast("long").alias("total"), F.round(mean, 6).alias("mean_magnitude"), best["ref"].alias("dominant"))


def from_pair(views: Column, layer_scores: Column, full: Column, reduced: Column, signature_score: Column, failed: Column) -> Column:
    """Evidence of a verified pair: a record for each view, and one for the signature.

    A view's own score counts if it is there, else the reduced or the full
    score; failed pairs have none.
    """
    general = F.coalesce(reduced, full)
    by_view = F.transform(views, lambda v: record("pairwise", "layer_score", F.coalesce(F.try_element_at(layer_scores, v), general), v))
    signing = F.when(signature_score.isNotNull(), F.array(record("signing", "signature_match", signature_score, F.lit("apk_signature")))).otherwise(F.array().cast(f"array<{EVIDENCE}>"))
    return F.when(failed, F.array().cast(f"array<{EVIDENCE}>")).otherwise(F.concat(F.filter(by_view, lambda e: e["magnitude"].isNotNull()), signing))


def merge(first: Column, second: Column) -> Column:
    """Both lists, the first of records with the same stage, signal and ref kept."""
    none = F.array().cast(f"array<{EVIDENCE}>")
    both = F.filter(F.concat(F.coalesce(first, none), F.coalesce(second, none)), lambda e: e["source_stage"].isNotNull() & e["signal_type"].isNotNull() & e["ref"].isNotNull())
    same = lambda x, y: (x["source_stage"] == y["source_stage"]) & (x["signal_type"] == y["signal_type"]) & (x["ref"] == y["ref"])
    return F.aggregate(both, none, lambda acc, e: F.when(F.exists(acc, lambda o: same(o, e)), acc).otherwise(F.concat(acc, F.array(e))))


def summary(rows: DataFrame, top: int = 5) -> DataFrame:
    """(pair_id, total, screening, pairwise, signing, mean_magnitude, top) from exploded records with `pos`."""
    e = F.col("evidence")
    ranked = F.array_sort(F.collect_list(F.struct((-e["magnitude"]).alias("m"), F.col("pos"), e.alias("e"))))
    stages = [F.count_if(e["source_stage"] == s).alias(s) for s in STAGES]
    out = rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("total"), *stages, F.round(F.avg(e["magnitude"]), 6).alias("mean_magnitude"), ranked.alias("_r"))
    return out.withColumn("top", F.transform(F.slice("_r", 1, top), lambda x: x["e"])).drop("_r")


def taxonomy(e: Column) -> Column:
    """Kind of change that a record stands for; the first rule that holds counts."""
    signal, ref, size = F.trim(e["signal_type"]), F.trim(F.coalesce(e["ref"], F.lit(""))), e["magnitude"]
    return (
        F.when(signal.isNull() | (signal == "") | size.isNull(), "UnknownType")
        .when(signal == "signature_match", F.when(size <= 0, "CertificateMismatch").otherwise("UnknownType"))
        .when((signal == "obfuscation_shift") | (ref == "obfuscation"), "ObfuscationShift")
        .when((signal == "api_call_change") | (ref == "api"), "NewMethodCall")
        .when((ref == "native") | ref.endswith(".so") | ref.contains(".so:"), "NativeLibChange")
        .when(ref == "library", "LibraryImpact")
        .when(ref == "component", "ComponentChange")
        .when(ref == "resource", "ResourceChange")
        .when((ref == "metadata") & F.lower(signal).contains("permission"), "PermissionChange")
        .when((ref == "code") & (size < 0.3), "CodeRemoval")
        .otherwise("UnknownType")
    )


def severity(count: Column, high: int, medium: int) -> Column:
    return F.when(count >= high, "high").when(count >= medium, "medium").otherwise("low")


def impact_severity(delta: Column) -> Column:
    """Severity of the difference between the full and the reduced score."""
    return F.when(F.abs(delta) >= 0.20, "high").when(F.abs(delta) >= 0.05, "medium").otherwise("low")


def change_hint(kind: str, left: Column, right: Column, high: int, medium: int, limit: int = 8) -> Column:
    """(kind, severity, added, removed) of two sets of names."""
    added, removed = F.array_sort(F.array_except(right, left)), F.array_sort(F.array_except(left, right))
    total = F.size(added) + F.size(removed)
    return F.struct(F.lit(kind).alias("kind"), severity(total, high, medium).alias("severity"), F.slice(added, 1, limit).alias("added"), F.slice(removed, 1, limit).alias("removed"))


def text(evidence: Column, limit: int = 20) -> Column:
    """Records as one line, in order of stage and falling magnitude."""
    place = lambda e: F.array_position(F.array(*(F.lit(s) for s in STAGES)), e["source_stage"])
    ordered = F.array_sort(F.transform(evidence, lambda e: F.struct(place(e).alias("p"), (-e["magnitude"]).alias("m"), e["signal_type"].alias("signal"), e["ref"].alias("ref"))))
    return F.array_join(F.transform(F.slice(ordered, 1, limit), lambda x: F.format_string("%s(%s)=%.2f", x["signal"], x["ref"], -x["m"])), "; ")


def _names(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.element_at(F.split(x, "/"), -1))


def permission_hint(left: Column, right: Column) -> Column:
    """Permissions that came or went, four of each shown."""
    only = lambda s: F.transform(F.filter(s, lambda x: x.startswith("permission:") | x.startswith("uses-permission:")), lambda x: F.regexp_replace(x, "^[^:]*:", ""))
    return change_hint("PermissionChange", only(left), only(right), 4, 1, 4)


def native_hint(left: Column, right: Column) -> Column:
    """Shared libraries among resource tokens that came or went, four of each shown by their file names."""
    only = lambda s: F.filter(s, lambda x: F.lower(x).contains(".so") | x.startswith("lib/"))
    found = change_hint("NativeLibChange", only(left), only(right), 3, 1, 4)
    return F.struct(found["kind"].alias("kind"), found["severity"].alias("severity"), _names(found["added"]).alias("added"), _names(found["removed"]).alias("removed"))


def certificate_hint(left: Column, right: Column) -> Column:
    """Signing files among resource tokens: any difference is high."""
    only = lambda s: F.filter(s, lambda x: x.contains("META-INF") | F.upper(x).contains("CERT") | F.upper(x).contains("RSA"))
    found = change_hint("CertificateMismatch", only(left), only(right), 1, 1, 4)
    return F.struct(found["kind"].alias("kind"), found["severity"].alias("severity"), _names(found["added"]).alias("added"), _names(found["removed"]).alias("removed"))


def _scored_hint(kind: str, left: Column, right: Column, jaccard: Column, counts: tuple[int, int], scores: tuple[float, float], limit: int) -> Column:
    plain = change_hint(kind, left, right, counts[0], counts[1], limit)
    total = F.size(F.array_except(left, right)) + F.size(F.array_except(right, left))
    marked = F.when((total >= counts[0]) | (jaccard < scores[0]), "high").when((total >= counts[1]) | (jaccard < scores[1]), "medium").otherwise("low")
    return F.struct(plain["kind"].alias("kind"), marked.alias("severity"), plain["added"].alias("added"), plain["removed"].alias("removed"))


def component_hint(left: Column, right: Column, jaccard: Column) -> Column:
    """Components that came or went: high from 6 or below a Jaccard of 0.1, medium from 2 or below 0.25."""
    kinds = lambda s: F.filter(s, lambda x: x.rlike("(Activity|Service|Receiver|Provider)$"))
    return _scored_hint("ComponentChange", kinds(left), kinds(right), jaccard, (6, 2), (0.10, 0.25), 8)


def resource_hint(left: Column, right: Column, jaccard: Column) -> Column:
    """Resources that came or went: high from 12 or below a Jaccard of 0.15, medium from 4 or below 0.35."""
    return _scored_hint("ResourceChange", left, right, jaccard, (12, 4), (0.15, 0.35), 8)


def removal_hint(left: Column, right: Column, is_library) -> Column:
    """Code of the first side that the second lacks, library code left out: high from 10, medium from 3, six shown."""
    own = lambda s: F.filter(s, lambda x: ~is_library(x))
    gone = F.array_sort(F.array_distinct(F.array_except(own(left), own(right))))
    none = F.array().cast("array<string>")
    return F.struct(F.lit("CodeRemoval").alias("kind"), severity(F.size(gone), 10, 3).alias("severity"), none.alias("added"), F.slice(gone, 1, 6).alias("removed"))


def new_code_hint(left: Column, right: Column, matched_left: Column, matched_right: Column, is_library) -> Column:
    """Graphs without a partner (by place from 0): at most four of the first side, eight in all; high from 6, medium from 3."""
    loose = lambda names, matched: F.transform(F.filter(F.transform(names, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~F.array_contains(matched, e["i"]) & ~is_library(e["x"])), lambda e: e["x"])
    first = F.slice(loose(left, matched_left), 1, 4)
    second = F.slice(loose(right, matched_right), F.lit(1), 8 - F.size(first))
    return F.struct(F.lit("NewMethodCall").alias("kind"), severity(F.size(first) + F.size(second), 6, 3).alias("severity"), second.alias("added"), first.alias("removed"))


def impact_hint(full: Column, reduced: Column) -> Column:
    """How far the library code moves the score."""
    none = F.array().cast("array<string>")
    return F.struct(F.lit("LibraryImpact").alias("kind"), impact_severity(full - reduced).alias("severity"), none.alias("added"), none.alias("removed"))


def obfuscation(detected_via: Column, signatures: Column, short: float = 0.5) -> Column:
    """Evidence of obfuscation: a library mask found by Jaccard (0.5), and short names in half of the methods or more (0.6)."""
    from kindred.functions.scalars import short_name_share

    none = F.array().cast(f"array<{EVIDENCE}>")
    one = lambda size, ref: F.array(record("pairwise", "obfuscation_shift", F.lit(size), F.lit(ref)))
    known = F.coalesce(signatures, F.array().cast("array<string>"))
    return F.concat(
        F.when(F.coalesce(F.lower(F.trim(detected_via)), F.lit("")) == "jaccard_v2", one(0.5, "jaccard_v2_libmask")).otherwise(none),
        F.when((F.size(known) > 0) & (short_name_share(known) >= short), one(0.6, "short_method_names")).otherwise(none),
    )


def session_hint(evidence: Column, top: int = 3) -> Column:
    """The records of the greatest magnitude as signal:ref=value, for raters."""
    sound = F.filter(evidence, lambda e: (F.trim(e["signal_type"]) != "") & (F.trim(e["ref"]) != "") & e["magnitude"].isNotNull())
    placed = F.array_sort(F.transform(sound, lambda e, i: F.struct((-F.abs(e["magnitude"])).alias("m"), i.alias("i"), e.alias("e"))))
    return F.array_join(F.transform(F.slice(placed, 1, top), lambda x: F.format_string("%s:%s=%.4f", F.trim(x["e"]["signal_type"]), F.trim(x["e"]["ref"]), x["e"]["magnitude"])), "; ")


def screening_explanation(rows: DataFrame, signals: str, retrieval_score: str, key: list[str], top: int = 3) -> DataFrame:
    """(key, matched_layers, dominant, confidence) of candidates with an array of signals (signal_id, layer, value, is_count, used).

    A signal's strength is its score cut at 1, or 1 - 1 / (n + 1) for a count,
    and 0.2 more if retrieval used it.  Of a signal that comes twice the
    stronger counts.  The `top` strongest dominate, used ones first on ties; if
    retrieval used none, the strongest counts as used.  Layers match from 0.35
    on, or the strongest does.
    """
    from kindred.functions.similarity import signal_strength

    each = rows.select(*key, retrieval_score, F.explode_outer(signals).alias("s"))
    plain = F.when(F.col("s.is_count"), signal_strength(F.col("s.value"), True)).otherwise(signal_strength(F.col("s.value")))
    strength = F.when(plain > 0, F.when(F.col("s.used"), F.least(plain + 0.2, F.lit(1.2))).otherwise(plain))
    known = each.select(*key, retrieval_score, F.col("s.signal_id").alias("signal_id"), F.col("s.layer").alias("layer"), F.when(strength.isNotNull(), F.col("s.used")).alias("used"), strength.alias("strength"))
    best = known.groupBy(*key, retrieval_score, "signal_id", "layer").agg(F.max("strength").alias("strength"), F.max("used").alias("used"))
    item = F.struct((-F.col("strength")).alias("order"), F.when(F.col("used"), 0).otherwise(1).alias("unused"), "signal_id", "layer", "strength")
    grouped = best.groupBy(*key, retrieval_score).agg(F.array_sort(F.collect_list(F.when(F.col("strength").isNotNull(), item))).alias("all"))
    marked = F.transform("all", lambda x, i: F.struct((i + 1).alias("rank"), x["signal_id"].alias("signal_id"), x["layer"].alias("layer"), ((x["unused"] == 0) | ((i == 0) & ~F.exists("all", lambda y: y["unused"] == 0))).alias("used_in_retrieval"), x["strength"].alias("strength")))
    strong = F.array_distinct(F.transform(F.filter("all", lambda x: x["strength"] >= 0.35), lambda x: x["layer"]))
    layers = F.when(F.size(strong) > 0, strong).when(F.size("all") > 0, F.array(F.get("all", F.lit(0))["layer"])).otherwise(F.array().cast("array<string>"))
    score = F.coalesce(F.col(retrieval_score), F.lit(0.0))
    confidence = F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")
    return grouped.select(*key, layers.alias("matched_layers"), F.slice(marked, 1, top).alias("dominant"), confidence.alias("confidence"))


def noise_of_pairs(pairs: DataFrame, noise: DataFrame) -> DataFrame:
    """`pairs` (a, b) with the noise rows (key, ...) that name the pair, in any known spelling, or one of its apps.

    Equi-joins only; a noise row that a pair meets more than once comes once.
    """
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    spelled = F.array(*(F.concat(x, F.lit(sep), y) for sep in ("::", "__", "|") for x, y in ((a, b), (b, a))), F.concat_ws("__", F.array_sort(F.array(a, b))), a, b)
    keyed = pairs.select("a", "b", F.explode(F.array_distinct(spelled)).alias("key"))
    return keyed.join(noise.distinct(), "key").drop("key").distinct()
