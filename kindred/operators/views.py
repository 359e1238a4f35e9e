"""Per-layer views of apps: call chains, code fingerprints, components, resources, libraries, bit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import similarity


def markov_chain(calls: DataFrame, entity: str, order: str, state: str, within: list[str] | None = None) -> DataFrame:
    """(entity, from_state, to_state, prob): transitions between adjacent rows as shares of the from-state's.

    Entities without a transition have no row.
    """
    w = Window.partitionBy(entity, *(within or [])).orderBy(order)
    steps = calls.select(entity, F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state")).where("to_state is not null")
    counts = steps.groupBy(entity, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(entity, "from_state")
    return counts.select(entity, "from_state", "to_state", (F.col("n") / F.sum("n").over(total)).alias("prob"))


def chain_cosine(chains: DataFrame, pairs: DataFrame, entity: str) -> DataFrame:
    """(a, b, score, status): cosine of two chains as sparse vectors, to six digits."""
    norms = chains.groupBy(entity).agg(F.sqrt(F.sum(F.col("prob") * F.col("prob"))).alias("norm"))
    side = lambda name: chains.select(F.col(entity).alias(name), "from_state", "to_state", F.col("prob").alias(f"p_{name}"))
    dots = pairs.join(side("a"), "a").join(side("b"), ["b", "from_state", "to_state"]).groupBy("a", "b").agg(F.sum(F.col("p_a") * F.col("p_b")).alias("dot"))
    rows = pairs.join(dots, ["a", "b"], "left").join(norms.select(F.col(entity).alias("a"), F.col("norm").alias("n_a")), "a", "left").join(norms.select(F.col(entity).alias("b"), F.col("norm").alias("n_b")), "b", "left")
    status = F.when(F.col("n_a").isNull() & F.col("n_b").isNull(), "both_empty").when(F.col("n_a").isNull() | F.col("n_b").isNull(), "one_empty").otherwise("ok")
    score = F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), 0.0).otherwise(F.round(F.coalesce("dot", F.lit(0.0)) / (F.col("n_a") * F.col("n_b")), 6))
    return rows.select("a", "b", score.alias("score"), status.alias("status"))


def simhash(grams: DataFrame, entity: list[str], gram: str) -> DataFrame:
    """(entity, fingerprint): 64-bit SimHash of distinct grams; a bit is set on ties."""
    bits = F.xxhash64(gram)
    signs = [F.sum(F.when(F.getbit(bits, F.lit(i)) == 1, 1).otherwise(-1)).alias(f"b{i}") for i in range(64)]
    wide = grams.select(*entity, gram).distinct().groupBy(*entity).agg(*signs)
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") >= 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return wide.select(*entity, value.alias("fingerprint"))


def blake2b_simhash(sequences: DataFrame, key: list[str], tokens: str, k: int = 4) -> DataFrame:
    """`sequences` with `fingerprint`, 'S:' and the 16-digit SimHash of distinct k-shingles by BLAKE2b.

    Sequences of fewer than k tokens get 'B:' and the hash of the whole.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for seq in values:
            seq = [] if seq is None else [str(x) for x in seq]
            grams = {" ".join(seq[i : i + k]) for i in range(len(seq) - k + 1)}
            if not grams:
                out.append("B:" + hashlib.blake2b(" ".join(seq).encode(), digest_size=8).hexdigest())
                continue
            raw = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams), np.uint8).reshape(-1, 8)
            ones = np.unpackbits(raw, axis=1).sum(0)
            out.append("S:" + np.packbits(2 * ones >= len(grams)).tobytes().hex())
        return pd.Series(out, dtype=object)

    return sequences.withColumn("fingerprint", run(F.col(tokens)))


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """1 - hamming / 64 for two 'S:' fingerprints, 1 or 0 for equal or other 'B:' ones, 0 for mixed kinds."""
    value = lambda x: F.conv(F.substring(x, 3, 16), 16, -10).cast("long")
    return F.when(a.startswith("S:") & b.startswith("S:"), 1 - similarity.hamming(value(a), value(b)) / 64).when(a.startswith("B:") & (a == b), 1.0).otherwise(0.0)


def compare_methods(methods: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score, status) of methods (app_id, method_id, fingerprint): similarity summed over common ids over the larger count."""
    methods = methods.groupBy("app_id", "method_id").agg(F.min("fingerprint").alias("fingerprint"))
    sizes = methods.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    side = lambda name: methods.select(F.col("app_id").alias(name), "method_id", F.col("fingerprint").alias(f"f_{name}"))
    sums = pairs.join(side("a"), "a").join(side("b"), ["b", "method_id"]).groupBy("a", "b").agg(F.sum(fingerprint_similarity(F.col("f_a"), F.col("f_b"))).alias("total"))
    rows = pairs.join(sums, ["a", "b"], "left").join(sizes.select(F.col("app_id").alias("a"), F.col("n").alias("n_a")), "a", "left").join(sizes.select(F.col("app_id").alias("b"), F.col("n").alias("n_b")), "b", "left")
    none_a, none_b = F.col("n_a").isNull(), F.col("n_b").isNull()
    return rows.select("a", "b", F.when(none_a | none_b, 0.0).otherwise(F.round(F.coalesce("total", F.lit(0.0)) / F.greatest("n_a", "n_b"), 6)).alias("score"), F.when(none_a & none_b, "both_empty").when(none_a | none_b, "one_empty").otherwise("fuzzy_ok").alias("status"))


def methods_of_counts(shared: Column, n_a: Column, n_b: Column) -> tuple[Column, Column]:
    """(score, status) of compare_methods from the numbers of methods that are the same and of each side's, where fingerprints are equal or not."""
    none_a, none_b = n_a == 0, n_b == 0
    score = F.when(none_a | none_b, 0.0).otherwise(F.round(shared / F.greatest(n_a, n_b), 6))
    return score.alias("score"), F.when(none_a & none_b, "both_empty").when(none_a | none_b, "one_empty").otherwise("fuzzy_ok").alias("status")


def expand_filters(components: DataFrame) -> DataFrame:
    """(app_id, component, action, category, data, priority_bucket): every combination of each intent filter.

    A missing part is the empty string.
    """
    or_blank = lambda c, t="string": F.when(F.size(F.coalesce(c, F.array().cast(f"array<{t}>"))) > 0, c).otherwise(F.array(F.lit("")))
    rows = components.select("app_id", F.col("name").alias("component"), F.explode("filters").alias("f"))
    rows = rows.withColumn("action", F.explode(or_blank(F.col("f.actions")))).withColumn("category", F.explode(or_blank(F.col("f.categories")))).withColumn("data", F.explode(or_blank(F.col("f.data"))))
    bucket = F.when(F.coalesce("f.priority", F.lit(0)) == 0, "default").when(F.col("f.priority") > 0, "high").otherwise("low")
    return rows.select("app_id", "component", "action", "category", "data", bucket.alias("priority_bucket")).distinct()


#: Weights of the kinds of components.
COMPONENT_WEIGHTS = {"activities": 0.4, "services": 0.2, "receivers": 0.2, "providers": 0.1, "permissions": 0.1}


def compare_components(a: dict[str, Column], b: dict[str, Column], icc_a: Column | None = None, icc_b: Column | None = None) -> Column:
    """(score, status): Jaccard of each kind (both empty: 1) by weight, averaged with that of the filter tuples."""
    empty = F.lit(True)
    total = F.lit(0.0)
    for kind, weight in COMPONENT_WEIGHTS.items():
        empty = empty & (F.size(a[kind]) + F.size(b[kind]) == 0)
        total = total + weight * similarity.jaccard(a[kind], b[kind], both_empty=1.0)
    if icc_a is not None and icc_b is not None:
        total = (total + similarity.jaccard(icc_a, icc_b, both_empty=1.0)) / 2
    return F.struct(F.when(empty, 0.0).otherwise(total).alias("score"), F.when(empty, "both_empty").otherwise("ok").alias("status"))


def compare_resources(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, unchanged, modified, added, removed, score) of files (app_id, path, digest): diffs by path, Jaccard by path and digest."""
    left = pairs.join(files.select(F.col("app_id").alias("a"), "path", F.col("digest").alias("x")), "a")
    right = pairs.join(files.select(F.col("app_id").alias("b"), "path", F.col("digest").alias("y")), "b")
    both = left.join(right, ["a", "b", "path"], "full_outer")
    x, y = F.col("x"), F.col("y")
    counts = both.groupBy("a", "b").agg(F.count_if(x == y).alias("unchanged"), F.count_if(x != y).alias("modified"), F.count_if(x.isNull()).alias("added"), F.count_if(y.isNull()).alias("removed"))
    rows = pairs.join(counts, ["a", "b"], "left").na.fill(0, ["unchanged", "modified", "added", "removed"])
    union = F.col("unchanged") + 2 * F.col("modified") + F.col("added") + F.col("removed")
    return rows.withColumn("score", F.when(union == 0, 1.0).otherwise(F.col("unchanged") / union))


def compare_libraries(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard, weighted_overlap) of (app_id, package, n_classes); weighted: sum of the lesser over sum of the greater counts."""
    left = pairs.join(classes.select(F.col("app_id").alias("a"), "package", F.col("n_classes").alias("x")), "a")
    right = pairs.join(classes.select(F.col("app_id").alias("b"), "package", F.col("n_classes").alias("y")), "b")
    both = left.join(right, ["a", "b", "package"], "full_outer").na.fill(0, ["x", "y"])
    sums = both.groupBy("a", "b").agg(F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("s"), F.count(F.lit(1)).alias("u"), F.sum(F.least("x", "y")).alias("lo"), F.sum(F.greatest("x", "y")).alias("hi"))
    rows = pairs.join(sums, ["a", "b"], "left")
    return rows.select("a", "b", F.coalesce(F.col("s") / F.col("u"), F.lit(1.0)).alias("jaccard"), F.coalesce(F.col("lo") / F.col("hi"), F.lit(1.0)).alias("weighted_overlap"))


def bit_positions(sequences: DataFrame, entity: str, order: str, token: str, grams: int = 4, bits: int = 8192) -> DataFrame:
    """(entity, pos): set bits of the feature-hashed grams of a token sequence."""
    w = Window.partitionBy(entity).orderBy(order)
    parts = [F.lead(token, i).over(w) for i in range(grams)]
    rows = sequences.select(entity, *(p.alias(f"t{i}") for i, p in enumerate(parts))).where(f"t{grams - 1} is not null")
    digest = F.conv(F.substring(F.md5(F.concat_ws(" ", *(f"t{i}" for i in range(grams))).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.select(entity, (digest % bits).alias("pos")).distinct()


def sign_hash(vectors: DataFrame, key: str, embedding: str, bits: int = 64) -> DataFrame:
    """(key, hash): the signs of the first `bits` numbers of a vector as bits of one integer."""
    value = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(F.col(embedding), i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return vectors.select(key, value.alias("hash"))


def image_hashes(images: DataFrame, key: str, pixels: str, width: str, height: str) -> DataFrame:
    """(key, average_hash, difference_hash, wavelet_hash) of grey images as flat arrays, as 16-digit hexadecimal text."""

    def shrink(img: np.ndarray, h: int, w: int) -> np.ndarray:
        rows = np.array_split(np.arange(img.shape[0]), h) if img.shape[0] >= h else [np.array([min(i * img.shape[0] // h, img.shape[0] - 1)]) for i in range(h)]
        cols = np.array_split(np.arange(img.shape[1]), w) if img.shape[1] >= w else [np.array([min(i * img.shape[1] // w, img.shape[1] - 1)]) for i in range(w)]
        return np.array([[img[np.ix_(r, c)].mean() for c in cols] for r in rows])

    def hexed(mask: np.ndarray) -> str:
        return np.packbits(mask.ravel()).tobytes().hex()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, flat, w, h in zip(pdf[key], pdf[pixels], pdf[width], pdf[height], strict=True):
                img = np.asarray(flat, float).reshape(int(h), int(w))
                small, wide = shrink(img, 8, 8), shrink(img, 8, 9)
                big = shrink(img, 16, 16)
                low = (big[::2, ::2] + big[1::2, ::2] + big[::2, 1::2] + big[1::2, 1::2]) / 2  # one Haar step
                rows.append((k, hexed(small > np.median(small)), hexed(wide[:, 1:] > wide[:, :-1]), hexed(low > np.median(low))))
            yield pd.DataFrame(rows, columns=[key, "average_hash", "difference_hash", "wavelet_hash"])

    kind = dict(images.dtypes)[key]
    return images.select(key, pixels, width, height).mapInPandas(run, f"{key} {kind}, average_hash string, difference_hash string, wavelet_hash string")


def code_fingerprints(methods: DataFrame, k: int = 4) -> DataFrame:
    """(app_id, method_id, fingerprint) of scanned methods; of a method that comes twice, the first by file and place."""
    first = methods.where("method_id is not null").groupBy("app_id", "method_id").agg(F.min_by("opcodes", F.struct("file", "pos")).alias("opcodes"))
    return blake2b_simhash(first, ["app_id", "method_id"], "opcodes", k).select("app_id", "method_id", "fingerprint")


def compare_code(methods: DataFrame, pairs: DataFrame, k: int = 4) -> DataFrame:
    """(a, b, score, status): scanned methods compared from end to end."""
    return compare_methods(code_fingerprints(methods, k), pairs)


def framework_calls(methods: DataFrame) -> DataFrame:
    """(app_id, method, pos, family): the calls of each method in order, for markov_chain within a method."""
    return methods.where("size(families) > 0").select("app_id", F.concat_ws("#", "file", "pos").alias("method"), F.posexplode("families").alias("pos", "family"))


def icon_similarity(a: Column, b: Column) -> Column:
    """1 - hamming / 64 of two icon tokens with the same method (`dhash` where none is named), null otherwise."""
    method = lambda x: F.when(x.rlike("^icon_phash:[0-9a-fA-F]{16}$"), "dhash").when(x.rlike("^icon_phash:(whash|dhash):[0-9a-fA-F]{16}$"), F.split_part(x, F.lit(":"), F.lit(2)))
    value = lambda x: F.conv(F.element_at(F.split(x, ":"), -1), 16, -10).cast("long")
    return F.when(method(a) == method(b), 1 - similarity.hamming(value(a), value(b)) / 64)


#: Kinds of resource tokens and the names of their scores.
RESOURCE_SUBSETS = {"string": "res_strings_score", "drawable": "res_drawables_score", "layout": "res_layouts_score", "asset": "assets_bin_score"}


def compare_resource_subsets(counts: DataFrame, pairs: DataFrame, icons: DataFrame) -> DataFrame:
    """(a, b, a score for each subset, jaccard, icon_phash_similarity, combined_score, status).

    `counts` has (a, b, subset, shared, n_a, n_b), `icons` (app_id, icon).  The
    combined score is the mean over subsets that either side has and the icons
    if both have one; without any of these the status is both_empty, with all
    ok, else partial.
    """
    either = F.col("n_a") + F.col("n_b") - F.col("shared")
    known = counts.where(either > 0)
    one = [F.max(F.when(F.col("subset") == s, F.col("shared") / either)).alias(name) for s, name in RESOURCE_SUBSETS.items()]
    wide = known.groupBy("a", "b").agg(*one, F.sum("shared").alias("both"), F.sum(either).alias("either"))
    icon = lambda x: icons.select(F.col("app_id").alias(x), F.col("icon").alias(f"icon_{x}"))
    rows = pairs.select("a", "b").join(wide, ["a", "b"], "left").join(icon("a"), "a", "left").join(icon("b"), "b", "left")
    return _subset_rows(rows)


def resource_subsets_of_counts(counts: DataFrame, subsets: list[str]) -> DataFrame:
    """compare_resource_subsets of blocks.group_counts that carries icon, with the subset of each of its layers."""
    each = {RESOURCE_SUBSETS[s]: (F.col(f"shared_{i}"), F.col(f"n_a_{i}") + F.col(f"n_b_{i}") - F.col(f"shared_{i}")) for i, s in enumerate(subsets)}
    total = lambda x: F.nullif(sum((v[x] for v in each.values()), F.lit(0)), F.lit(0))
    return _subset_rows(counts.select("a", "b", "icon_a", "icon_b", *(F.when(e > 0, s / e).alias(x) for x, (s, e) in each.items()), total(0).alias("both"), total(1).alias("either")))


def _subset_rows(rows: DataFrame) -> DataFrame:
    """Combined scores and status of rows with a score for each subset, both, either, icon_a and icon_b."""
    rows = rows.withColumn("icon", icon_similarity(F.col("icon_a"), F.col("icon_b")))
    parts = F.filter(F.array(*RESOURCE_SUBSETS.values(), "icon"), lambda x: x.isNotNull())
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    status = F.when(F.size(parts) == 0, "both_empty").when(F.size(parts) == len(RESOURCE_SUBSETS) + 1, "ok").otherwise("partial")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "a", "b", *(zero(F.col(n)).alias(n) for n in RESOURCE_SUBSETS.values()), zero(F.col("both") / F.col("either")).alias("jaccard"), zero(F.col("icon")).alias("icon_phash_similarity"),
        F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(0.0).alias("combined_score"), status.alias("status"),
    )


def compare_library_sets(a: Column, b: Column) -> Column:
    """jaccard, tversky in both directions (0.9 and 0.1), overlap, and shared and own libraries of two sets."""
    empty = F.size(a) + F.size(b) == 0
    return F.struct(
        similarity.jaccard(a, b).alias("jaccard"), similarity.tversky(a, b, 0.9, 0.1).alias("tversky_ab"), similarity.tversky(a, b, 0.1, 0.9).alias("tversky_ba"), similarity.overlap_min(a, b).alias("overlap"),
        F.array_sort(F.array_intersect(a, b)).alias("shared"), F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"), F.when(empty, "both_empty").otherwise("ok").alias("status"),
    )


#: Weights of the parts of shared libraries' fingerprints.
NATIVE_WEIGHTS = {"imports": 0.35, "exports": 0.35, "strings": 0.20, "needed": 0.10}


def compare_native(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """(score, status): Jaccards of imported and exported names, strings and needed libraries by weight; empty on both sides: 0."""
    total, some = F.lit(0.0), F.lit(False)
    for part, weight in NATIVE_WEIGHTS.items():
        total = total + weight * similarity.jaccard(a[part], b[part])
        some = some | (F.size(a[part]) + F.size(b[part]) > 0)
    return F.struct(total.alias("score"), F.when(some, "ok").otherwise("empty").alias("status"))


def native_sets(libraries: DataFrame) -> DataFrame:
    """(app_id, imports, exports, strings, needed): the parts of all of an app's shared libraries as sets."""
    return libraries.groupBy("app_id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(p)))).alias(p) for p in NATIVE_WEIGHTS))


def bit_jaccard(positions: DataFrame, pairs: DataFrame, entity: str = "app_id") -> DataFrame:
    """(a, b, score, status): Jaccard of two bit sets to six digits; empty if neither has a bit."""
    sizes = positions.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: positions.select(F.col(entity).alias(x), "pos")
    shared = pairs.join(side("a"), "a").join(side("b"), ["b", "pos"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
    size = lambda x: sizes.select(F.col(entity).alias(x), F.col("n").alias(f"n_{x}"))
    rows = pairs.select("a", "b").join(shared, ["a", "b"], "left").join(size("a"), "a", "left").join(size("b"), "b", "left").na.fill(0, ["s", "n_a", "n_b"])
    either = F.col("n_a") + F.col("n_b") - F.col("s")
    return rows.select("a", "b", F.when(either > 0, F.round(F.col("s") / either, 6)).otherwise(0.0).alias("score"), F.when(either > 0, "ok").otherwise("empty").alias("status"))
