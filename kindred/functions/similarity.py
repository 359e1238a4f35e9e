"""Set similarities as column expressions.

All take two array columns that hold sets (distinct, no nulls).  What happens
when one or both are empty differs by metric and is part of its definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sizes(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double"), F.size(b).cast("double")


def from_counts(metric: str, shared: Column, left: Column, right: Column) -> Column:
    """A metric from |A∩B|, |A| and |B|: what a token join gives without the sets themselves."""
    s, a, b = (x.cast("double") for x in (shared, left, right))
    name = canonical_metric(metric)
    if name == "shared_count":
        return s
    below = {"jaccard": a + b - s, "cosine": F.sqrt(a) * F.sqrt(b), "containment": F.least(a, b), "dice": (a + b) / 2, "overlap": F.greatest(a, b)}[name]
    return F.when(s > 0, s / below).otherwise(0.0)


#: Other names of the metrics; note that the overlap coefficient is containment here.
ALIASES = {
    "jaccard": "jaccard", "jac": "jaccard", "cosine": "cosine", "cos": "cosine", "containment": "containment", "cnt": "containment",
    "overlap_coefficient": "containment", "dice": "dice", "overlap": "overlap", "shared_count": "shared_count", "shared": "shared_count",
    "levenshtein": "levenshtein", "lev": "levenshtein",
}


def canonical_metric(name: str) -> str:
    try:
        return ALIASES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown similarity metric: {name}") from None


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """|A∩B| / |A∪B|; `both_empty` if there is nothing on either side."""
    s, n, m = _sizes(a, b)
    return F.when(n + m == 0, F.lit(float(both_empty))).otherwise(s / (n + m - s))


def set_metric(name: str, a: Column, b: Column) -> Column:
    """A screening metric by name or alias; 0 if either side is empty."""
    metric = canonical_metric(name)
    if metric == "levenshtein":
        return token_levenshtein(a, b)
    return from_counts(metric, *_sizes(a, b))


def tversky(a: Column, b: Column, alpha: float, beta: float) -> Column:
    """s / (s + alpha * |A-B| + beta * |B-A|); 1 if both are empty; with nothing below the line, 1 if equal else 0."""
    s, n, m = _sizes(a, b)
    below = s + alpha * (n - s) + beta * (m - s)
    value = F.when(below > 0, s / below).otherwise(F.when((n == s) & (m == s), 1.0).otherwise(0.0))
    return F.when(n + m == 0, 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def overlap_min(a: Column, b: Column) -> Column:
    """|A∩B| / min(|A|, |B|); 1 if both are empty, 0 if one is."""
    s, n, m = _sizes(a, b)
    return F.when(n + m == 0, 1.0).when(F.least(n, m) == 0, 0.0).otherwise(s / F.least(n, m))


def channels(a: Column, b: Column) -> Column:
    """The channels of one layer: jaccard, tversky_a, tversky_b, overlap_min; all 0 if both sides are empty."""
    empty = F.size(a) + F.size(b) == 0
    zero = lambda c: F.when(empty, 0.0).otherwise(c)
    return F.struct(
        zero(jaccard(a, b)).alias("jaccard"), zero(tversky(a, b, 1.0, 0.0)).alias("tversky_a"),
        zero(tversky(a, b, 0.0, 1.0)).alias("tversky_b"), zero(overlap_min(a, b)).alias("overlap_min"),
    )


def weighted_jaccard(a: Column, b: Column, weights: Column, unknown: float = 1.0) -> Column:
    """Sum of token weights in both over the sum in either; tokens that `weights` (a map) lacks weigh `unknown`."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, t: acc + F.greatest(F.coalesce(F.try_element_at(weights, t), F.lit(unknown)), F.lit(0.0)))
    either = total(F.array_sort(F.array_union(a, b)))
    return F.when(either > 0, total(F.array_sort(F.array_intersect(a, b))) / either).otherwise(0.0)


def idf(documents: Column, frequency: Column) -> Column:
    """ln(N / min(df, N)), never negative."""
    n = documents.cast("double")
    return F.greatest(F.ln(n / F.least(frequency.cast("double"), n)), F.lit(0.0))


def token_levenshtein(a: Column, b: Column) -> Column:
    """1 - d / max(|A|, |B|) with d the edit distance of the sorted token lists; 0 if both are empty.

    One row of the distance table at a time, folded over the left list.
    """
    left, right = F.array_sort(a), F.array_sort(b)
    n, m = F.size(a), F.size(b)

    def row(prev: Column, x: Column) -> Column:
        first = F.array(F.get(prev, F.lit(0)) + 1)
        cell = lambda acc, i: F.concat(acc, F.array(F.least(F.get(acc, i) + 1, F.get(prev, i + 1) + 1, F.get(prev, i) + F.when(F.get(right, i) == x, 0).otherwise(1))))
        return F.when(m > 0, F.aggregate(F.sequence(F.lit(0), m - 1), first, cell)).otherwise(first)

    start = F.sequence(F.lit(0), m)
    distance = F.element_at(F.aggregate(left, start, row), -1)
    return F.when(n + m == 0, 0.0).otherwise(1.0 - distance / F.greatest(n, m))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from key to weight, rounded to six digits; null stands for no data (0)."""
    keys = F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    dot = F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + F.element_at(a, k) * F.element_at(b, k))
    norm = lambda x: F.sqrt(F.aggregate(F.map_values(x), F.lit(0.0), lambda acc, v: acc + v * v))
    below = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (below == 0), 0.0).otherwise(F.round(dot / below, 6))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit integers."""
    return F.bit_count(a.bitwiseXOR(b))


def hit_probability(j: Column, num_perm: int, bands: int) -> Column:
    """Chance that two sets of Jaccard `j` share a band: 1 - (1 - j^r)^b."""
    if not 0 < bands <= num_perm or num_perm % bands:
        raise ValueError("bands must divide the number of permutations")
    return 1 - F.pow(1 - F.pow(j, F.lit(num_perm // bands)), F.lit(bands))


def signal_strength(value: Column, is_count: bool = False) -> Column:
    """A score cut at 1, or a count n as 1 - 1 / (n + 1)."""
    return 1 - 1 / (value + 1) if is_count else F.least(value.cast("double"), F.lit(1.0))


def clamp_unit(value: Column, default: float = 0.0) -> Column:
    """To double, cut to [0, 1]; `default` for what is no number."""
    number = F.coalesce(value.try_cast("double"), F.lit(default))
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))


def signature_match(a: Column, b: Column, lineage_a: Column | None = None, lineage_b: Column | None = None) -> Column:
    """(score, status) of two signing fingerprints: match, match_via_rotation, mismatch, missing or both_missing."""
    rotated = F.lit(False)
    if lineage_a is not None and lineage_b is not None:
        rotated = F.coalesce(F.array_contains(lineage_a, b) | F.array_contains(lineage_b, a) | F.arrays_overlap(lineage_a, lineage_b), F.lit(False))
    status = F.when(a.isNull() & b.isNull(), "both_missing").when(a.isNull() | b.isNull(), "missing").when(a == b, "match").when(rotated, "match_via_rotation").otherwise("mismatch")
    return F.struct(F.when(status.isin("match", "match_via_rotation"), 1.0).otherwise(0.0).alias("score"), status.alias("status"))
