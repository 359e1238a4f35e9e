"""Exact n-gram Jaccard self-join by a token-group matrix.

Equal shingle sets collapse into one class.  Classes are dealt into groups of
similar documents: each class is verified against one class with which it
shares minimum hashes, and verified links make groups.  The matrix then holds,
for every group, the union of the prefix shingles of its members.  Groups meet
where their unions share shingles; the number of these, with what may come
after the prefixes, bounds the overlap of any two members.  Only pairs of
groups, and then only classes and groups, whose bound can reach the threshold
are opened, and pairs of classes inside are verified on their texts.

No link between different sets is lost: two sets at the threshold share a
shingle of their prefixes under any one total order (here: rare shingles first,
by a count sketch of fixed size, then by hash), and every bound that drops a
pair holds for all pairs at the threshold.  One more such bound comes before
texts are moved: each class has a bitmap of its shingles' parities, and two
sets differ in as many shingles, at least, as their bitmaps differ in bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import Tables, fresh_name, small_batches
from .graph import components

#: Minimum hashes by which groups are formed.
GROUPINGS = 4
#: Bits of the summary of the wanted ids by which texts are sieved before they are moved.
SIEVE = 1 << 21
#: Cells of the count sketch (a power of two) and cells of one of its blocks.
CELLS, BLOCK = 1 << 20, 1 << 14
#: Shingles that are counted at once for the sketch.
COUNTED = 1 << 20
#: First sums of a block of the sketch, so that no task adds up the blocks of all tasks.
SPREAD = 1024
#: Prefix shingles that one bucket of the matrix is meant to hold.
BUCKET = 200_000
#: Texts that are sent to Python at once.
BATCH = 1000
#: Members of one block of a group that is opened.
BLOCKED = 512
#: Pairs that one copy of a center's text serves.
SERVED = 64

_SIG = "doc_id long, text_hash long, n int, k1 long, k2 long, mins array<long>, bits binary, block int, counts binary"
_SIG_COLUMNS = [c.split()[0] for c in _SIG.split(", ")]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _class_key(tokens: np.ndarray, doc_id: int | None) -> tuple[int, int]:
    if not len(tokens):  # a document without shingles is a class of its own
        return int(_signed(sh.mix(np.array([(doc_id or 0) % (1 << 64)], np.uint64), 32 if doc_id is None else 31))[0]), 0
    a, b = (np.add.reduce(sh.mix(tokens, salt)) for salt in (11, 12))
    got = _signed(sh.mix(np.array([a, b], np.uint64), 13))
    return int(got[0]), int(got[1])


def parity_bits(tokens: np.ndarray) -> bytes:
    """Bit i is the parity of the number of shingles whose hash is i; as many bits as shingles, rounded up to a power of two."""
    size = max(64, 1 << int(len(tokens) - 1).bit_length())
    at = sh.mix(tokens, 21) & np.uint64(size - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """The number of shingles, at least, that only one of two sets has; the larger bitmap is folded to the size of the smaller."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (sh.mix(tokens, 99) & np.uint64(CELLS - 1)).astype(np.int64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document; at the end, rows with `block` have the sketch of this task's shingles."""
    known: set[tuple[int, int]] = set()
    sketch, held, size = np.zeros(CELLS, np.int64), [], 0
    for pdf in batches:
        ids, hashes = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]], list(pdf["text_hash"])
        for start, raw in sh.chunks(list(pdf["text"])):
            rows = []
            for i, tokens in enumerate(sh.shingle_sets(raw), start):
                key, some = _class_key(tokens, ids[i]), len(tokens) > 0
                mins = [int(_signed(sh.mix(tokens, 101 + g).min()[None])[0]) for g in range(GROUPINGS)] if some else None
                rows.append((ids[i], hashes[i], len(tokens), *key, mins, parity_bits(tokens) if some else None, None, None))
                if some and key not in known:
                    known.add(key)
                    held.append(tokens)
                    size += len(tokens)
            if size >= COUNTED:
                sketch += np.bincount(_cells(np.concatenate(held)), minlength=CELLS)
                held, size = [], 0
            yield pd.DataFrame(rows, columns=_SIG_COLUMNS).astype({"doc_id": "Int64", "block": "Int64"})
    if held:
        sketch += np.bincount(_cells(np.concatenate(held)), minlength=CELLS)
    if len(full := np.flatnonzero(sketch.reshape(-1, BLOCK).any(axis=1))):
        out = pd.DataFrame({c: pd.Series([None] * len(full), dtype=object) for c in _SIG_COLUMNS})
        out = out.astype({"doc_id": "Int64", "text_hash": "Int64", "n": "Int64", "k1": "Int64", "k2": "Int64"})
        yield out.assign(block=full, counts=[np.minimum(sketch[b * BLOCK : (b + 1) * BLOCK], (1 << 32) - 1).astype(np.uint32).tobytes() for b in full])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.uint64)
    for counts in pdf["counts"]:
        total += np.frombuffer(counts, np.uint32)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()]})


def _counts(sig: DataFrame) -> np.ndarray:
    """The sketch over all tasks, CELLS numbers whatever the input."""
    schema = "block int, counts binary"
    blocks = sig.where("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(SPREAD)).alias("part"))
    sums = blocks.groupBy("block", "part").applyInPandas(_added, schema).groupBy("block").applyInPandas(_added, schema)
    out = np.zeros(CELLS, np.int64)
    for block, counts in sums.collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(counts, np.uint32)
    return out


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(buckets: int, percent: int, counts: np.ndarray):
    """Emits, by bucket, the prefix shingles of each class with the class's key, packed.

    Shingles of a cell that would fill a bucket alone are dealt by their
    owners over the buckets from `buckets` on.
    """
    mean = max(1.0, counts.mean())
    level = np.minimum(4 * np.log2(np.maximum(counts / mean, 1)), 255).astype(np.uint8)
    hot = counts >= BUCKET // 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[tuple[int, int]] = set()
        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            for start, raw in sh.chunks(list(pdf["text"])):
                parts, owners, places = [], [], []
                for i, tokens in enumerate(sh.shingle_sets(raw), start):
                    key = _class_key(tokens, ids[i])
                    if not len(tokens) or key in known:
                        continue
                    known.add(key)
                    kept = tokens[np.argsort(level[_cells(tokens)], kind="stable")[: _prefix(len(tokens), percent)]]
                    parts.append(kept)
                    places.append(np.minimum(np.arange(1, len(kept) + 1), 65535).astype(np.uint16))  # a smaller place only leaves more room
                    owners.append(np.full(len(kept), key[0], np.int64))
                if not parts:
                    continue
                tokens, owner, place = np.concatenate(parts), np.concatenate(owners), np.concatenate(places)
                own = hot[_cells(tokens)]
                dealt = sh.mix(tokens, 7)
                dealt[own] = sh.mix(dealt[own] ^ owner[own].view(np.uint64), 8)
                bucket = (dealt % np.uint64(buckets)).astype(np.int64) + np.where(own, buckets, 0)
                order = np.argsort(bucket, kind="stable")
                tokens, owner, place, bucket = tokens[order], owner[order], place[order], bucket[order]
                heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(heads[1:], len(bucket))
                short = tokens.view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits in a bucket; shingles that fall together only add candidates
                cut = lambda x: [x[a:b].tobytes() for a, b in zip(heads, ends, strict=True)]  # noqa: B023, E731
                yield pd.DataFrame({"bucket": bucket[heads], "tokens": cut(short), "owners": cut(owner), "places": cut(place)})

    return run


def _shared(buckets: int):
    """The (shingle, class) pairs of a bucket whose shingle has two classes at least; all of a bucket of dealt shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        short = np.frombuffer(b"".join(pdf["tokens"]), np.uint8).reshape(-1, 6)
        tokens = np.zeros((len(short), 8), np.uint8)
        tokens[:, :6] = short
        tokens = tokens.view(np.uint64)[:, 0]
        owners = np.frombuffer(b"".join(pdf["owners"]), np.int64)
        places = np.frombuffer(b"".join(pdf["places"]), np.uint16)
        order = np.lexsort((owners, tokens))
        tokens, owners, places = tokens[order], owners[order], places[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1]))
        tokens, owners, places = tokens[new], owners[new], places[new]
        same = tokens[1:] == tokens[:-1]
        keep = (np.append(same, False) | np.append(False, same)) if bucket < buckets else np.ones(len(tokens), bool)
        token = sh.mix(tokens[keep], bucket if bucket < buckets else buckets)
        return pd.DataFrame({"token": token.view(np.int64), "k1": owners[keep], "place": places[keep].astype(np.int32)})

    return run


def _able(percent: int):
    """By how much two sets may differ more than their bitmaps show, null if they cannot reach the threshold."""

    @F.pandas_udf("int")
    def room(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        both = n.to_numpy(np.int64) + m.to_numpy(np.int64)
        most = both - 2 * -(-percent * both // (100 + percent))
        left = most - np.array([least_difference(x, y) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1)
        return pd.Series(left, dtype="Int64").where(left >= 0)

    return room


def _wanted(ids: DataFrame, column: str = "id") -> Column:
    """A test of `column`, true for all given ids and few others: a bitmap of hashed ids, of SIEVE bits whatever the input."""
    bit = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(SIEVE)) + 1
    bits = np.zeros(SIEVE // 8, np.uint8)
    for part, got in ids.select(F.col("id").alias(column)).select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit"))).collect():
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(got, np.uint8)

    @F.pandas_udf("boolean")
    def wanted(places: pd.Series) -> pd.Series:
        at = places.fillna(1).to_numpy(np.int64) - 1
        return pd.Series((bits[at >> 3] >> (at & 7)) & 1 == 1)

    return wanted(bit)


def _compare(percent: int):
    """The pairs (a, b) that reach the threshold, from rows by center, each center's own texts before those compared with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, centers = None, []
        for pdf in batches:
            out = []
            keys, ids, texts = list(zip(pdf["b"], pdf["part"], strict=True)), list(pdf["id"]), list(pdf["text"])
            for start, raw in sh.chunks(texts, sh.CHUNK_BYTES // 2):
                for i, x in enumerate(sh.shingle_sets(raw), start):
                    if keys[i] != at:
                        at, centers = keys[i], []
                    if ids[i] == at[0]:
                        centers.append(x)
                        continue
                    for y in centers:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(y) - both):
                            out.append((ids[i], at[0]))
                            break
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts reach the threshold.

    The texts of a and b meet at b; a center's text travels once for SERVED
    pairs or so, and a center with many pairs is split by them.
    """
    per = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SERVED).alias("parts"))
    dealt = tables.keep(pairs.join(per, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")))
    ends = dealt.select(F.col("a").alias("id"), "b", "part").union(dealt.select("b", "b", "part").distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = texts.where(_wanted(ends.select("id"))).join(ends, "id")
    met = texts.repartition("b", "part").sortWithinPartitions("b", "part", F.col("id") != F.col("b"))
    found = tables.keep(met.select("b", "part", "id", "text").mapInPandas(_compare(percent), "a long, b long").distinct())
    tables.drop(dealt)
    return found


def _promising(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow, with `left`, the more the likelier."""
    of = lambda x: members.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(_fits("n_a", "n_b", percent))
    kept = both.withColumn("left", _able(percent)("bits_a", "bits_b", "n_a", "n_b")).where("left is not null")
    return kept.select(*pairs.columns, "left")


def _opened(percent: int):
    """The pairs that sizes and bitmaps allow, from rows by block of a group, its members before the classes that ask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for pdf in batches:
            out = []
            for grp, part, asks, key, n, bits in zip(*(pdf[c] for c in ("asked", "part", "asks", "id", "n", "bits")), strict=True):
                if (grp, part) != at:
                    at, held = (grp, part), []
                if not asks:
                    held.append((key, n, bits))
                    continue
                for other, m, theirs in held:
                    both = n + m
                    if 100 * min(n, m) >= percent * max(n, m) and least_difference(bits, theirs) <= both - 2 * -(-percent * both // (100 + percent)):
                        out.append((key, other))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _inside(opened: DataFrame, groups: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the members b of the opened groups (a, asked) that sizes and bitmaps allow.

    A group is cut into blocks of BLOCKED members or so, and the classes that
    ask pass through each; no pair becomes a row before its bitmaps allow it.
    """
    c = F.col
    asked = opened.select("asked").distinct()
    held = groups.select(c("label").alias("asked"), "id").join(asked, "asked").union(asked.select("asked", c("asked").alias("id"))).distinct()
    blocks = held.groupBy("asked").agg(F.ceil(F.count(F.lit(1)) / BLOCKED).cast("int").alias("blocks"))
    facts = members.select("id", c("n").cast("int").alias("n"), "bits")
    inside = held.join(blocks, "asked").join(facts, "id").select("asked", F.pmod(F.xxhash64("id"), c("blocks")).cast("int").alias("part"), F.lit(0).alias("asks"), "id", "n", "bits")
    asking = opened.withColumnRenamed("a", "id").join(blocks, "asked").join(facts, "id").select("asked", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("part"), F.lit(1).alias("asks"), "id", "n", "bits")
    met = inside.union(asking).repartition("asked", "part").sortWithinPartitions("asked", "part", "asks")
    return met.mapInPandas(_opened(percent), "a long, b long").where("a <> b").distinct()


def _fits(n: str, m: str, percent: int) -> Column:
    return F.least(F.col(n), F.col(m)).cast("long") * 100 >= F.greatest(F.col(n), F.col(m)).cast("long") * percent


def _reach(percent: int, shared: Column, least: Column, most: Column, least_other: Column, most_other: Column) -> Column:
    """Whether sets of sizes in [least, most] and [least_other, most_other] can reach the threshold with so many shared prefix shingles.

    One of two sets has all other common shingles outside its prefix, so that
    they share at most shared + t * (the larger size), and must share
    t / (1 + t) * (both sizes).  The difference of these is greatest where the
    larger size is, and the smaller is the least that may go with it.  One is
    allowed for rounding.
    """
    t = percent / 100
    wide = lambda large, small: shared + t * large - t / (1 + t) * (large + F.greatest(small, t * large)) >= -1
    compatible = (t * least_other <= most) & (t * least <= most_other)
    return compatible & (wide(most, least_other) | wide(most_other, least))


def ngram_jaccard_join(docs: DataFrame, percent: int = 75, width: int = sh.SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A ∩ B| >= percent * |A ∪ B| over their sets
    of distinct `width`-word shingles; component_id is the smallest doc_id
    reachable by links.  A null or empty text has no shingles and is its own
    component.  Rows that repeat are repeated in the result; if a doc_id comes
    with several texts, each row is judged by its own text, and classes with
    the same smallest id count as linked.  A null doc_id takes part by its text
    and, if its class has no other id, has a null component.  Other columns are
    not read.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, found = classes_of(docs, percent, width)
    found = found.select("k1", "k2", "component_id")
    return rows.join(found, ["k1", "k2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def classes_of(docs: DataFrame, percent: int = 75, width: int = sh.SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(a row for each document with its class (k1, k2) and a hash of its text, a row for each class with its component_id)."""
    if width != sh.SHINGLE:
        raise ValueError(f"shingles have {sh.SHINGLE} words")
    with small_batches(docs.sparkSession, BATCH):
        return _classes_of(docs, percent, Tables(docs.sparkSession))


def _classes_of(docs: DataFrame, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    sig = tables.keep(docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(_signatures, _SIG))
    rows = sig.where("block is null").select("doc_id", "text_hash", "n", "k1", "k2", "mins", "bits")
    classes = tables.keep(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "mins", "bits"))))
    members = classes.where("n > 0 and id is not null")

    # Groups: every class against the first class with which it shares the most minimum hashes.
    dealt = members.select("id", F.posexplode("mins").alias("g", "m"))
    firsts = dealt.groupBy("g", "m").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    stars = dealt.join(firsts, ["g", "m"]).where("id <> first").groupBy("id", "first").count()
    stars = stars.groupBy(F.col("id").alias("a")).agg(F.max_by("first", F.struct("count", -F.col("first"))).alias("b"))
    stars = tables.keep(_promising(stars, members, percent).select("a", "b").distinct())
    links = _verified(stars, docs, percent, tables)
    groups = components(links, tables=tables)

    # The matrix: prefix shingles that two classes have, with sizes and groups.
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(256, int(total * (100 - percent) / 100 / BUCKET))
    packed = docs.mapInPandas(_prefixes(buckets, percent, _counts(sig)), "bucket long, tokens binary, owners binary, places binary")
    matrix = packed.groupBy("bucket").applyInPandas(_shared(buckets), "token long, k1 long, place int")
    info = members.select("k1", "id", "n").join(groups, "id", "left").select("k1", "id", "n", F.coalesce("label", "id").alias("grp"), F.col("label").isNull().alias("solo"))
    # A pair's first common shingle leaves each side room for the overlap that they need: share * other is at most `room`.
    t = percent / 100
    share = t / (1 + t)
    kept = tables.keep(matrix.join(info, "k1").select("token", "id", "n", "place", "grp", "solo"))
    placed = kept.withColumn("room", (F.ceil(F.col("n") * (1 - share)) - F.col("place") + 2).cast("int"))
    union = placed.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"), F.max_by("id", "room").alias("one"), F.first("solo").alias("solo"))
    union = tables.keep(union)
    other = union.select("token", *(F.col(c).alias(f"{c}_o") for c in ("grp", "least", "most", "room", "one", "solo")))
    c = F.col
    compatible = (t * c("least_o") <= c("most")) & (t * c("least") <= c("most_o"))
    roomy = (c("room") >= share * F.greatest(c("least_o"), t * c("least"))) & (c("room_o") >= share * F.greatest(c("least"), t * c("least_o")))
    met = union.join(other, "token").where((c("grp") < c("grp_o")) & compatible)
    met = met.groupBy("grp", "grp_o", "one", "one_o").agg(F.count(F.lit(1)).alias("c"), F.max(roomy).alias("roomy"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("least_o").alias("least_o"), F.max("most_o").alias("most_o"), F.first(c("solo") & c("solo_o")).alias("solo"))
    met = met.groupBy("grp", "grp_o").agg(
        F.sum("c").alias("c"), F.max("roomy").alias("roomy"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("least_o").alias("least_o"), F.max("most_o").alias("most_o"),
        F.first("solo").alias("solo"), F.max_by(F.struct("one", "one_o"), F.struct("c", "one", "one_o")).alias("pair"),
    )
    met = tables.keep(met.where(c("roomy") & _reach(percent, c("c"), c("least"), c("most"), c("least_o"), c("most_o"))).select("grp", "grp_o", "solo", c("pair.one").alias("a"), c("pair.one_o").alias("b")))

    # The members that meet most often speak for two groups first; groups of one class are settled by it.
    tried = tables.keep(_promising(met.select("a", "b"), members, percent).select("a", "b").distinct())
    more = _verified(tried, docs, percent, tables)
    links = links.union(more)
    formed, groups = groups, components(links, tables=tables)
    apart = lambda pairs, a, b: pairs.join(groups.select(c("id").alias(a), c("label").alias("label_a")), a, "left").join(groups.select(c("id").alias(b), c("label").alias("label_b")), b, "left").where(~F.coalesce("label_a", a).eqNullSafe(F.coalesce("label_b", b))).drop("label_a", "label_b")
    rest = apart(met.where("not solo").select("grp", "grp_o"), "grp", "grp_o")
    # The classes of the smaller of two groups ask.
    sizes = formed.groupBy("label").count()
    size = lambda x: sizes.select(c("label").alias(x), c("count").alias(f"size_{x}"))
    sized = rest.join(size("grp"), "grp", "left").join(size("grp_o"), "grp_o", "left").na.fill(1, ["size_grp", "size_grp_o"])
    ends = F.when(c("size_grp") <= c("size_grp_o"), F.struct(c("grp").alias("asks"), c("grp_o").alias("asked"))).otherwise(F.struct(c("grp_o").alias("asks"), c("grp").alias("asked")))
    rest = tables.keep(sized.select(ends.alias("x")).select("x.asks", "x.asked"))
    if rest.limit(1).count():
        # Every class of one group against the union of the other.
        asking = placed.join(rest, c("grp") == c("asks")).select("token", c("id").alias("a"), "n", "room", "asked")
        common = asking.join(union.select("token", c("grp").alias("asked"), c("least").alias("least_o"), c("most").alias("most_o"), c("room").alias("room_o"), c("one").alias("b")), ["token", "asked"])
        able = (c("room") >= share * F.greatest(c("least_o"), t * c("n"))) & (c("room_o") >= share * c("n"))
        bound = common.groupBy("a", "n", "asked", "b").agg(F.count(F.lit(1)).alias("c"), F.max(able).alias("able"), F.min("least_o").alias("least_o"), F.max("most_o").alias("most_o"))
        bound = bound.groupBy("a", "n", "asked").agg(F.sum("c").alias("c"), F.max("able").alias("able"), F.min("least_o").alias("least_o"), F.max("most_o").alias("most_o"), F.max_by("b", F.struct("c", "b")).alias("b"))
        opened = tables.keep(bound.where(c("able") & _reach(percent, c("c"), c("n"), c("n"), c("least_o"), c("most_o"))).select("a", "asked", "b"))
        # Again the member that is met most often comes first, and the others only where it did not settle it.
        tried = tables.keep(_promising(opened.select("a", "b").distinct(), members, percent).select("a", "b").distinct())
        links = links.union(_verified(tried, docs, percent, tables))
        groups = components(links, tables=tables)
        opened = tables.keep(apart(opened.select("a", "asked"), "a", "asked"))
        pairs = tables.keep(_inside(opened, formed, members, percent).join(tried, ["a", "b"], "left_anti"))
        if pairs.limit(1).count():
            groups = components(links.union(_verified(pairs, docs, percent, tables)), tables=tables)
    tables.drop_all_but(sig, classes, groups)
    return rows, classes.join(groups, "id", "left").select("k1", "k2", "id", F.coalesce("label", "id").alias("component_id"), F.col("label").isNull().alias("solo"))


def one_of_each_group(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of `docs`, with all their columns, less all but one of each group of linked documents.

    The row with the smallest doc_id stays (a null one counts as the greatest);
    of rows with this doc_id, the one whose text has the smallest hash; of
    equal rows, one.  Documents without words are in no group and all stay; a
    doc_id with several texts that link to nothing keeps each of them, while
    linked ones count as one group.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, classes = classes_of(plain, percent)
    c = F.col
    nameless = lambda k: F.when(c("solo"), c(k)).alias(f"of_{k}")  # noqa: E731  a class without links, whatever its id, is a group of its own
    grouped = rows.where("n > 0").join(classes.select("k1", "k2", "component_id", "solo"), ["k1", "k2"]).select("component_id", nameless("k1"), nameless("k2"), "doc_id", "text_hash")
    each = grouped.groupBy("component_id", "of_k1", "of_k2", "doc_id", "text_hash").count()
    first = each.groupBy("component_id", "of_k1", "of_k2").agg(F.min(F.struct(c("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("texts"), F.sum("count").alias("rows")).where("rows > 1")
    tables = Tables(docs.sparkSession)
    first = tables.keep(first.select(*(c(x).alias(f"{x}_f") for x in ("component_id", "of_k1", "of_k2")), "first", "texts"))
    same = c("component_id").eqNullSafe(c("component_id_f")) & c("of_k1").eqNullSafe(c("of_k1_f")) & c("of_k2").eqNullSafe(c("of_k2_f"))
    is_first = c("doc_id").eqNullSafe(c("first.doc_id")) & (c("text_hash") == c("first.text_hash"))
    judged = tables.keep(each.join(first, same).select("doc_id", "text_hash", "count", is_first.alias("stays")).where("not stays or count > 1"))
    # Rows of other ids stay where they are; only the rest meet the list of those that go.
    names, (by_hash, its_id, its_hash, stays) = docs.columns, (fresh_name(x, docs.columns) for x in ("by_hash", "its_id", "its_hash", "stays"))
    test = _wanted(judged.select(c("doc_id").alias("id")), "doc_id")
    met = docs.where(test).withColumn(by_hash, F.xxhash64(c("text").cast("string")))
    mark = judged.select(c("doc_id").alias(its_id), c("text_hash").alias(its_hash), c("stays").alias(stays))
    met = met.join(mark, c("doc_id").cast("long").eqNullSafe(c(its_id)) & (c(by_hash) == c(its_hash)), "left")
    out = docs.where(~test).union(met.where(c(stays).isNull()).select(names))
    if judged.where("stays").limit(1).count():
        out = out.union(met.where(c(stays)).dropDuplicates(["doc_id", by_hash]).select(names))
    return out
