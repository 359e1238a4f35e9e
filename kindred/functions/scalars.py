"""Scalar expressions: buckets, parsing, coercion, hashes and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_bucket(value: Column) -> Column:
    """Bucket of a count: 0, 1_3, 4_7, 8_15, 16_31, 32_63, 64_plus."""
    return F.when(value <= 0, "0").when(value <= 3, "1_3").when(value <= 7, "4_7").when(value <= 15, "8_15").when(value <= 31, "16_31").when(value <= 63, "32_63").otherwise("64_plus")


def byte_bucket(value: Column) -> Column:
    """Bucket of a file size."""
    return F.when(value < 1024, "<1KB").when(value < 10 * 1024, "<10KB").when(value < 100 * 1024, "<100KB").when(value < 1024 * 1024, "<1MB").otherwise("1MB+")


def split_strings(value: Column, separators: str = r"[\n,|]") -> Column:
    """Parts of a list in one string, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(value, separators), lambda x: F.trim(x)), lambda x: x != "")


def day_key(stamp: Column) -> Column:
    """The first ten characters of an ISO stamp if they look like a date, else 'unknown'."""
    return F.when((F.substring(stamp, 5, 1) == "-") & (F.substring(stamp, 8, 1) == "-"), F.substring(stamp, 1, 10)).otherwise("unknown")


def hex_hash(value: Column) -> Column:
    """A 16-digit hexadecimal hash as a 64-bit integer, null for anything else."""
    return F.when(value.rlike("^[0-9a-fA-F]{16}$"), F.conv(value, 16, -10).cast("long"))


def package_version(app_id: Column) -> Column:
    """(package, version) of `package_123`, split at the last underscore before digits; version null without one."""
    found = F.regexp_extract(app_id, "^(.+)_([0-9]+)$", 1)
    return F.struct(F.when(found != "", found).otherwise(app_id).alias("package"), F.when(found != "", F.regexp_extract(app_id, "^(.+)_([0-9]+)$", 2)).alias("version"))


def short_name_share(signatures: Column) -> Column:
    """Share of method signatures with names of one or two letters."""
    known = F.filter(signatures, lambda s: s.isNotNull())
    return F.when(F.size(known) > 0, F.size(F.filter(known, lambda s: s.rlike(r"^[a-z]\$?[a-z$]?\("))) / F.size(known)).otherwise(0.0)


def ordered_union(*arrays: Column) -> Column:
    """All elements in order of first appearance, blanks and nulls dropped."""
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)), lambda x: x.isNotNull() & (F.trim(x) != "")))


def first_elements(values: Column, limit: int = 8) -> Column:
    """The first `limit` distinct elements in order."""
    return F.slice(F.array_distinct(values), 1, limit)


def drop_keys(values: Column, masked: Column) -> Column:
    """A map without the keys in the array `masked`."""
    return F.map_filter(values, lambda k, _: ~F.array_contains(masked, k))


def difference(a: Column, b: Column) -> Column:
    """(shared, added, removed) of two sets, each sorted."""
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("shared"), F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"))


def package_of_path(path: Column) -> Column:
    """Dotted package of a smali path; null for manifest, resources, assets and native code."""
    inside = F.regexp_extract(path, r"^smali(?:_classes[0-9]+)?/(.+)/[^/]+$", 1)
    return F.when(inside != "", F.replace(inside, F.lit("/"), F.lit(".")))


def manifest_fields(text: Column) -> Column:
    """(package, version_name, min_sdk, target_sdk, permissions, features) from manifest text by patterns.

    The first match counts for single values; a feature is what follows the last dot.
    """
    one = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    every = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))
    return F.struct(
        one(r'package="([^"]+)"').alias("package"), one(r'versionName="([^"]+)"').alias("version_name"),
        one(r'minSdkVersion="([0-9]+)"').alias("min_sdk"), one(r'targetSdkVersion="([0-9]+)"').alias("target_sdk"),
        every(r"([A-Za-z0-9_.]+\.permission\.[A-Z0-9_]+)").alias("permissions"),
        F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(android\.hardware\.[a-z0-9_.]+)"), F.lit(1)), lambda f: F.substring_index(f, ".", -1)))).alias("features"),
    )


def permission_group(permission: Column) -> Column:
    """Who made a permission, by ordered prefixes."""
    return F.when(permission.startswith("com.google."), "google").when(permission.startswith("com.facebook."), "facebook").when(permission.startswith("android."), "android").otherwise("third_party")
