"""Similarity joins over token tables (app_id, layer, token).

The exact join is an equi-join on tokens with counts.  For Jaccard thresholds it
is preceded by prefix filtering: under one order of all tokens, common ones last,
two sets at the threshold share a part of their prefixes, so that only prefixes
are joined and full sets are compared for what is left.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import similarity
from kindred.runtime import cut_lineage

#: Tokens for each class, about; common tokens that are listed, at most; matches listed at a time; bits for the sets that have a likely partner.
CLASS_TOKENS, COMMON, MATCHES, SLOTS = 1 << 22, 1 << 18, 1 << 22, 1 << 22


def tokens_of(records: DataFrame) -> DataFrame:
    """(app_id, layer, token) of records with a column layers, map<layer, array<token>>."""
    return records.select("app_id", F.explode("layers").alias("layer", "tokens")).select("app_id", "layer", F.explode("tokens").alias("token")).where("token is not null").distinct()


def select_layers(tokens: DataFrame, layers: list[str] | None) -> DataFrame:
    """Distinct tokens of the chosen layers; the layer stays part of a token's identity."""
    if layers is not None:
        tokens = tokens.where(F.col("layer").isin(list(dict.fromkeys(layers))))
    return tokens.select("app_id", "layer", "token").distinct()


def validate_records(records: DataFrame) -> None:
    """Raises ValueError for fewer than two records or an app_id that comes twice."""
    if records.limit(2).count() < 2:
        raise ValueError("at least two records are needed")
    if records.groupBy("app_id").count().where("count > 1").limit(1).count():
        raise ValueError("app_id is not unique")


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(a, b, shared, n_a, n_b) for each pair a < b with a token in common."""
    sizes = tokens.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    left = tokens.select(F.col("app_id").alias("a"), "layer", "token")
    right = tokens.select(F.col("app_id").alias("b"), "layer", "token")
    shared = left.join(right, ["layer", "token"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes.select(F.col("app_id").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("app_id").alias("b"), F.col("n").alias("n_b")), "b")


def score_join(tokens: DataFrame, metric: str = "jaccard", threshold: float = 0.7) -> DataFrame:
    """(a, b, score) of all pairs a < b whose score is at least `threshold`, which must be above 0.

    Pairs without a common token score 0 and so never appear.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed: pairs that share nothing are not enumerated")
    if similarity.canonical_metric(metric) == "jaccard":
        return jaccard_join(tokens, threshold)
    scored = pair_counts(tokens).withColumn("score", similarity.from_counts(metric, F.col("shared"), F.col("n_a"), F.col("n_b")))
    return scored.where(F.col("score") >= threshold).select("a", "b", "score")


def jaccard_join(tokens: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of all pairs with Jaccard at least `threshold`, exactly."""
    return jaccard_sets(tokens.groupBy("app_id").agg(F.collect_set(F.xxhash64("layer", "token")).alias("set")), threshold)


def jaccard_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """jaccard_join of (app_id, set of hashes), a row for each app; the rows are worked out several times and moved only where a partner is likely.

    Equal sets are one.  Of each set all tokens but the last in one order of
    all, common ones last, are dealt out by classes of tokens, as numbers of 32
    bits.  What two sets at the threshold must share of these tokens, they
    share by at least an equal part in one of the classes.
    """
    # No condition on the sets themselves, which would be worked out anew for it (explode() alone brings one).
    sets = sets.where("app_id is not null").select("app_id", F.sort_array("set").alias("set")).select("app_id", F.xxhash64("set").alias("id"), "set")
    members = cut_lineage(sets.select("app_id", "id", F.size("set").alias("n"))).where("n > 0")
    apps, tokens = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = max(16, tokens // CLASS_TOKENS)
    more = min(classes, 64) + 1
    share = max(1, min(8, apps // 16384))
    # A sample only finds the common tokens; any order of tokens gives all pairs.
    common = sets.where(F.pmod(F.xxhash64("app_id", F.lit(7)), F.lit(share)) == 0).select(F.explode_outer("set").alias("key")).groupBy("key").count().where("count >= 4").orderBy(F.desc("count"), "key").limit(COMMON).collect()
    last = sets.sparkSession.sparkContext.broadcast(np.array(sorted((r[0], r[1]) for r in common), np.int64).reshape(-1, 2))
    dealt = sets.select("id", "set").mapInArrow(_dealt(classes, threshold, more, last), "class int, data binary")
    met = dealt.groupBy("class").applyInArrow(_met(classes, threshold, more), "a long, b long")
    pairs = cut_lineage(met.distinct())
    slots = pairs.select(F.explode(F.array("a", "b")).alias("id")).mapInArrow(_slots, "slots binary").collect()
    seen = np.zeros(SLOTS, bool)
    for r in slots:
        seen |= np.unpackbits(np.frombuffer(r[0], np.uint8)).astype(bool)
    seen = sets.sparkSession.sparkContext.broadcast(seen)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(seen.value[batch["id"].to_numpy().astype(np.uint64) % SLOTS]))

    full = sets.select("id", "set").mapInArrow(likely, "id long, set array<long>").groupBy("id").agg(F.first("set").alias("set"))
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    near = both.select("a", "b", similarity.jaccard(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= threshold)
    side = lambda name, app: members.select(F.col("id").alias(name), F.col("app_id").alias(app))
    near = near.join(side("a", "p"), "a").join(side("b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "score")
    equal = side("id", "a").join(side("id", "b"), "id").where("a < b").select("a", "b", F.lit(1.0).alias("score"))
    return near.union(equal)


def _cut(n: np.ndarray, threshold: float, more: int) -> np.ndarray:
    """How many of the last tokens of sets of n tokens are left out."""
    return np.maximum(np.ceil(n * threshold - 1e-9).astype(np.int64) - more, 0)


def _dealt(classes: int, threshold: float, more: int, last):
    """(class, data): the tokens of a batch of sets by class, but for the last of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = last.value[:, 0], last.value[:, 1]
        for batch in batches:
            lists = batch["set"]
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(flat), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                rank = np.where(keys[at] == flat, counts[at], 0)
            order = np.lexsort((flat, rank, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            kept = place < np.repeat(n - _cut(n, threshold, more), n)
            row, token = row[kept], flat[order][kept].astype(np.uint64)
            where = (token % np.uint64(classes)).astype(np.int64)
            by = np.argsort(where, kind="stable")
            row, token, where = row[by], (token[by] >> np.uint64(32)).astype(np.uint32), where[by]
            found, start = np.unique(where, return_index=True)
            ids, out = batch["id"].to_numpy(), []
            for lo, hi in zip(start, [*start[1:], len(where)], strict=True):
                mine, held = np.unique(row[lo:hi], return_counts=True)
                raw = b"".join([np.int64(len(mine)).tobytes(), ids[mine].tobytes(), n[mine].astype(np.int32).tobytes(), held.astype(np.int32).tobytes(), token[lo:hi].tobytes()])
                out.append(zlib.compress(raw, 1))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(out, pa.binary())], ["class", "data"])

    return run


def _met(classes: int, threshold: float, more: int):
    """(a, b): pairs of sets that share enough tokens of one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, helds, tokens = [], [], [], []
        for batch in batches:
            for data in batch["data"]:
                raw = zlib.decompress(data.as_py())
                m = int(np.frombuffer(raw, np.int64, 1)[0])
                ids.append(np.frombuffer(raw, np.int64, m, 8))
                sizes.append(np.frombuffer(raw, np.int32, m, 8 + 8 * m))
                helds.append(np.frombuffer(raw, np.int32, m, 8 + 12 * m))
                tokens.append(np.frombuffer(raw, np.uint32, -1, 8 + 16 * m))
        ids, n, held, token = (np.concatenate(v) for v in (ids, sizes, helds, tokens))
        n = n.astype(np.int64)
        # Equal sets once; small sets first, so that a set's partners are a range.
        _, one = np.unique(ids, return_index=True)
        one = one[np.argsort(n[one], kind="stable")]
        rank = np.full(len(ids), -1, np.int64)
        rank[one] = np.arange(len(one))
        doc = np.repeat(rank, held)
        token, doc = token[doc >= 0], doc[doc >= 0]
        ids, n = ids[one], n[one]
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        group = np.cumsum(np.r_[0, token[1:] != token[:-1]]) if len(token) else token.astype(np.int64)
        code = group * len(ids) + doc
        largest = np.searchsorted(n, n / threshold + 1e-6, "right") - 1
        end = np.searchsorted(code, group * len(ids) + largest[doc], "right")
        many = end - np.arange(len(code)) - 1
        by = np.argsort(doc, kind="stable")
        by = by[many[by] > 0]
        done, cut = np.cumsum(many[by]), _cut(n, threshold, more)
        i = 0
        while i < len(by):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + MATCHES)))
            j = int(np.searchsorted(doc[by], doc[by[j - 1]], "right"))  # all of a set's matches together
            k = many[by[i:j]]
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            pair, hits = np.unique(np.repeat(doc[by[i:j]], k) * len(ids) + doc[np.repeat(by[i:j], k) + inner + 1], return_counts=True)
            x, y = pair // len(ids), pair % len(ids)
            shared = np.ceil(threshold / (1 + threshold) * (n[x] + n[y]) - 1e-6) - np.maximum(cut[x], cut[y])
            good = (hits * classes >= shared) & (x != y)
            a, b = ids[x[good]], ids[y[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            i = j

    return run


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap of the ids of a partition."""
    seen = np.zeros(SLOTS, bool)
    for batch in batches:
        seen[batch["id"].to_numpy().astype(np.uint64) % SLOTS] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["slots"])


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Candidate rows with dense retrieval ranks: falling score, then both ids.

    The rank is global without a single-task sort: a range sort deals the rows
    out, and each partition's offset is the number of rows before it.
    """
    rows = scored.select(F.col("a").alias("query_app_id"), F.col("b").alias("candidate_app_id"), F.col("score").alias("retrieval_score"))
    ordered = rows.orderBy(F.desc("retrieval_score"), "query_app_id", "candidate_app_id").withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id() % (1 << 33)})
    ordered = cut_lineage(ordered)
    before, held = {}, 0
    for p, n in sorted(ordered.groupBy("_p").count().collect()):
        before[p], held = held, held + n
    start = F.create_map(*(F.lit(x) for kv in (before or {0: 0}).items() for x in kv))
    ranked = ordered.withColumn("retrieval_rank", (F.element_at(start, F.col("_p")) + F.col("_i") + 1).cast("long"))
    return ranked.drop("_p", "_i").withColumn("screening_status", F.lit("preliminary_positive"))


def rank_per_query(scored: DataFrame) -> DataFrame:
    """Ranks that start anew for each query."""
    rows = scored.select(F.col("a").alias("query_app_id"), F.col("b").alias("candidate_app_id"), F.col("score").alias("retrieval_score"))
    order = Window.partitionBy("query_app_id").orderBy(F.desc("retrieval_score"), "candidate_app_id")
    return rows.withColumn("retrieval_rank", F.row_number().over(order).cast("long"))


def query_corpus_join(queries: DataFrame, corpus: DataFrame, metric: str = "jaccard", threshold: float = 0.7) -> DataFrame:
    """Candidates of query token sets in a corpus of token sets; the same id never meets itself."""
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed")
    n_q = queries.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_a")).withColumnRenamed("app_id", "a")
    n_c = corpus.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_b")).withColumnRenamed("app_id", "b")
    shared = queries.withColumnRenamed("app_id", "a").join(corpus.withColumnRenamed("app_id", "b"), ["layer", "token"]).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(n_q, "a").join(n_c, "b").withColumn("score", similarity.from_counts(metric, F.col("shared"), F.col("n_a"), F.col("n_b")))
    return rank_per_query(scored.where(F.col("score") >= threshold).select("a", "b", "score"))


def minhash_native(tokens: DataFrame, num_perm: int = 128, seed: int = 42) -> DataFrame:
    """(app_id, signature): for each of `num_perm` hash functions the least hash of a set.

    One pass with pre-aggregated minima; the functions differ by a salt.
    """
    keyed = tokens.select("app_id", F.xxhash64("layer", "token").alias("h"))
    mins = keyed.groupBy("app_id").agg(*(F.min(F.xxhash64("h", F.lit(seed), F.lit(i))).alias(f"m{i}") for i in range(num_perm)))
    return mins.select("app_id", F.array(*(f"m{i}" for i in range(num_perm))).alias("signature"))


def minhash_md5(tokens: DataFrame, num_perm: int, seed: int = 42) -> DataFrame:
    """Like minhash_native with 32-bit values that other SQL engines can work out too.

    One md5 of each token gives two numbers x and y; function i is
    (x + i * y) mod the greatest prime below 2^32.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "layer", "token").cast("binary"))
    number = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("long")
    hashed = tokens.select("app_id", digest.alias("digest")).select("app_id", number(1).alias("x"), number(9).alias("y"))
    mins = hashed.groupBy("app_id").agg(*(F.min((F.col("x") + i * F.col("y")) % 4294967291).alias(f"m{i}") for i in range(num_perm)))
    return mins.select("app_id", F.array(*(f"m{i}" for i in range(num_perm))).alias("signature"))


def minhash_blake2b(tokens: DataFrame, num_perm: int = 128, seed: int = 42) -> DataFrame:
    """(app_id, signature of 16-digit hexadecimal slots) with keyed BLAKE2b, as unsigned 64-bit minima.

    Each slot has its own personalisation (seed, slot).  Hexadecimal text keeps
    the unsigned order; minima are pre-aggregated by batch in Python and then
    by Spark.
    """
    people = [struct.pack(">QQ", seed, i) for i in range(num_perm)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best: dict[str, list[bytes]] = {}
            for app, feature in zip(pdf["app_id"], pdf["feature"], strict=True):
                raw = feature.encode("utf-8")
                got = [hashlib.blake2b(raw, digest_size=8, person=p).digest() for p in people]
                old = best.get(app)
                best[app] = got if old is None else list(map(min, old, got))
            yield pd.DataFrame({"app_id": list(best), "slots": [[x.hex() for x in v] for v in best.values()]})

    parts = tokens.select(F.col("app_id").cast("string").alias("app_id"), F.concat_ws(":", "layer", "token").alias("feature")).mapInPandas(run, "app_id string, slots array<string>")
    return parts.groupBy("app_id").agg(*(F.min(F.get("slots", F.lit(i))).alias(f"m{i}") for i in range(num_perm))).select("app_id", F.array(*(f"m{i}" for i in range(num_perm))).alias("signature"))


def minhash_estimate(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def band_table(signatures: DataFrame, bands: int, num_perm: int) -> DataFrame:
    """(band, band_key, app_id): the index, one row for each set and band."""
    if bands <= 0 or num_perm % bands:
        raise ValueError("bands must divide the number of permutations")
    rows = num_perm // bands
    keys = F.array(*(F.xxhash64(F.lit(i), F.slice("signature", i * rows + 1, rows)) for i in range(bands)))
    return signatures.select("app_id", F.posexplode(keys).alias("band", "band_key"))


def lsh_pairs(signatures: DataFrame, bands: int = 32, num_perm: int = 128) -> DataFrame:
    """(a, b): ordered pairs that share a band, each once."""
    table = band_table(signatures, bands, num_perm)
    left = table.select(F.col("app_id").alias("a"), "band", "band_key")
    right = table.select(F.col("app_id").alias("b"), "band", "band_key")
    return left.join(right, ["band", "band_key"]).where("a < b").select("a", "b").distinct()


def lsh_join(tokens: DataFrame, metric: str = "jaccard", threshold: float = 0.7, num_perm: int = 128, bands: int = 32, seed: int = 42, signer=minhash_native) -> DataFrame:
    """(a, b, score): pairs that share a band, scored exactly, at or over the threshold."""
    pairs = lsh_pairs(signer(tokens, num_perm, seed), bands, num_perm)
    sets = tokens.groupBy("app_id").agg(F.collect_set(F.xxhash64("layer", "token")).alias("set"))
    both = pairs.join(sets.select(F.col("app_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("app_id").alias("b"), F.col("set").alias("y")), "b")
    scored = both.select("a", "b", similarity.set_metric(metric, F.col("x"), F.col("y")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def longest_prefix(names: DataFrame, catalogue: DataFrame, name: str = "name", prefix: str = "prefix", sep: str = ".") -> DataFrame:
    """`names` with the longest catalogue prefix that ends at a separator or the end, null without one.

    An equi-join on every prefix of a name, not a range join.
    """
    parts = F.split(F.col(name), F.lit("\\" + sep))
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    exploded = names.select(name).distinct().select(name, F.explode(every).alias("_p"))
    found = exploded.join(catalogue.select(F.col(prefix).alias("_p")).distinct(), "_p").groupBy(name).agg(F.max_by("_p", F.length("_p")).alias("matched_prefix"))
    return names.join(found, name, "left")


def coverage_join(packages: DataFrame, catalogue: DataFrame, least: float = 0.3, min_matches: int = 1) -> DataFrame:
    """(app_id, tpl_id, matched, coverage, detected) of library catalogues in packages; only coverage above 0."""
    sizes = catalogue.distinct().groupBy("tpl_id").agg(F.count(F.lit(1)).alias("size"))
    met = packages.select("app_id", "package").distinct().join(catalogue.select("tpl_id", "package").distinct(), "package").groupBy("app_id", "tpl_id").agg(F.count(F.lit(1)).alias("matched"))
    rows = met.join(sizes, "tpl_id").withColumn("coverage", F.col("matched") / F.col("size"))
    return rows.select("app_id", "tpl_id", "matched", "coverage", ((F.col("matched") >= min_matches) & (F.col("coverage") >= least)).alias("detected"))
