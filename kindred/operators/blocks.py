"""Counts of what the members of one group share, pair by pair, without a row for each common token.

Groups are cut into blocks of members; each pair of blocks is one task's work,
which multiplies matrices of tokens, BLOCK members by BLOCK, and writes one
row for each pair.  What moves is each member's sets, once for each block of
its group; sets of whole numbers move as differences of a byte or two, so that
their blocks can be larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, IntegerType, LongType, ShortType, StructField, StructType

#: Members of either side that are multiplied at a time, and in a block, about.
BLOCK = 2048
#: Blocks of a group that are made for the sake of more tasks, at most, and members in a block where that means larger ones.
SPREAD, WIDE = 8, 1 << 14
#: Rows of the left block at a time, and common tokens listed at a time.
ROWS, MATCHES = 256, 1 << 21


def tokens_to_sets(tokens: DataFrame, layers: list[str]) -> DataFrame:
    """(app_id, an array for each layer) of distinct (app_id, layer, token) rows; null tokens stay and equal nothing."""
    return tokens.groupBy("app_id").agg(*(set_of(F.when(F.col("layer") == x, F.col("token")), (F.col("layer") == x) & F.col("token").isNull()).alias(x) for x in layers))


def set_of(token: Column, null: Column) -> Column:
    """Aggregate: the distinct tokens in order, with one null if `null` ever holds."""
    found = F.array_sort(F.collect_set(token))
    return F.when(F.coalesce(F.bool_or(null), F.lit(False)), F.array_append(found, F.lit(None))).otherwise(found)


def _joined(column: pa.ChunkedArray) -> pa.Array:
    """The chunks as one."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    return lists


def _pack(lists: pa.Array) -> list[pa.Array]:
    """The lists' whole numbers in order, as differences of seven bits a byte (the last byte of each is below 128), and the lists' sizes; nulls count for the size only."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), sizes.to_numpy())[flat.is_valid().to_numpy(zero_copy_only=False)]
    values = flat.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.diff(owner, prepend=-1) > 0
    if not (new[1:] | (values[1:] >= values[:-1])).all():
        values = values[np.lexsort((values, owner))]
    steps = values.view(np.uint64).copy()
    steps[1:] -= np.where(new[1:], 0, values[:-1]).view(np.uint64)
    width, top = np.ones(len(steps), np.int64), int(steps.max(initial=0))
    for k in range(1, -(-top.bit_length() // 7)):
        width += steps >= np.uint64(1 << 7 * k)
    end = np.cumsum(width)
    out = np.empty(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        on = width > k
        out[(end - width)[on] + k] = (steps[on] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(width[on] > k + 1, 128, 0).astype(np.uint8)
    at = np.append(0, np.cumsum(np.bincount(owner, width, len(lists)))).astype(np.int32)
    return [pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(out)]), sizes]


def _unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of lists that _pack has made."""
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    if at[0] == at[-1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]]
    last = data < 128
    begin = np.append(0, np.flatnonzero(last)[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    total = np.cumsum(np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin))
    first = np.append(0, np.cumsum(last))[at - at[0]]
    n = np.diff(first)
    return np.repeat(np.arange(len(packed)), n), (total - np.repeat(np.append(np.uint64(0), total)[first[:-1]], n)).view(np.int64)


def _postings(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, rows, codes): the sizes of all lists, and a row and a code for each token that is not null."""
    lists = _joined(column)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.fill_null(lists.flatten().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n), sizes)
    known = codes >= 0
    return sizes, rows[known], codes[known]


class _Shared:
    """What rows of one block share with all of another: frequent tokens by a matrix product, the others listed."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray | None = None):
        place = np.full(int(max(left.max(), right.max(), rows.max(initial=0))) + 1, -1, np.int64)
        width = int(codes.max(initial=-1)) + 1
        place[left] = np.arange(len(left))
        at = place[rows]
        lr, lc = at[at >= 0], codes[at >= 0]
        place[:] = -1
        place[right] = np.arange(len(right))
        at = place[rows]
        rr, rc = at[at >= 0], codes[at >= 0]
        nl, nr = np.bincount(lc, minlength=width), np.bincount(rc, minlength=width)
        often = nl * nr > len(left) * len(right) / 64
        number = np.cumsum(often) - 1
        self.shape, self.weights = (len(left), len(right)), weights
        self.type = np.float32 if weights is None else np.float64
        self.dense_r = np.zeros((int(often.sum()), len(right)), self.type)
        on = often[rc]
        self.dense_r[number[rc[on]], rr[on]] = 1
        if weights is not None:
            self.dense_r *= weights[often][:, None]
        on = often[lc]
        self.dense_l = np.zeros((len(left), int(often.sum())), self.type)
        self.dense_l[lr[on], number[lc[on]]] = 1
        rare = ~often & (nl > 0) & (nr > 0)
        on = rare[rc]
        order = np.argsort(rc[on], kind="stable")
        self.rr, self.n = rr[on][order], np.where(rare, nr, 0)
        self.start = np.cumsum(self.n) - self.n
        on = rare[lc]
        order = np.argsort(lr[on], kind="stable")
        self.lr, self.lc = lr[on][order], lc[on][order]

    def part(self, first: int, last: int) -> np.ndarray:
        """Shared counts (or weights) of the left rows first to last - 1 with all right rows."""
        width = self.shape[1]
        out = self.dense_l[first:last] @ self.dense_r
        out = out.astype(np.int64) if self.weights is None else out
        lo, hi = np.searchsorted(self.lr, [first, last])
        lr, lc = self.lr[lo:hi] - first, self.lc[lo:hi]
        done = np.cumsum(self.n[lc])
        i = 0
        while i < len(lr):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + MATCHES)))
            n = self.n[lc[i:j]]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cell = np.repeat(lr[i:j], n) * width + self.rr[np.repeat(self.start[lc[i:j]], n) + inner]
            w = None if self.weights is None else np.repeat(self.weights[lc[i:j]], n)
            out += np.bincount(cell, w, out.size).reshape(out.shape)
            i = j
        return out


def _whole(sets: DataFrame, layers: list[str]) -> list[int]:
    """Which of the layers are sets of whole numbers."""
    return [i for i, x in enumerate(layers) if isinstance(kind := sets.schema[x].dataType, ArrayType) and isinstance(kind.elementType, (ByteType, ShortType, IntegerType, LongType))]


def _packed(rows: DataFrame, numbers: list[int]) -> DataFrame:
    """`rows` with t_i of these numbers as _pack has them, and their sizes as n_i."""
    names = [f"t_{i}" for i in numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [x for x in batch.schema.names if x not in names]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in rest), *(y for x in names for y in _pack(batch[x]))], [*rest, *(y for x in names for y in (x, f"n{x[1:]}"))])

    fields = [x for x in rows.schema.fields if x.name not in names]
    fields += [y for x in names for y in (StructField(x, BinaryType()), StructField(f"n{x[1:]}", IntegerType()))]
    return rows.mapInArrow(run, StructType(fields))


def _tiles(sets: DataFrame, members: DataFrame, layers: list[str], block: int, carry: tuple[str, ...] = (), numbers: list[int] | None = None) -> DataFrame:
    """(grp, p, q, _block, app_id, carry, t_0, t_1, ...): each member with its sets, for each pair p <= q of blocks of its group that has its own; the layers of these numbers packed.

    If they are all packed, a group has SPREAD blocks at most, unless their members are then more than WIDE.
    """
    known = members.select("app_id", "grp", *carry).where("app_id is not null and grp is not null")
    wanted = lambda n: F.ceil(F.count(F.lit(1)) / n).cast("int")
    wide = numbers is not None and len(numbers) == len(layers)
    size = known.groupBy("grp").agg((F.greatest(F.least(wanted(block), F.lit(SPREAD)), wanted(max(block, WIDE))) if wide else wanted(block)).alias("_blocks"))
    placed = known.join(size, "grp").withColumn("_block", F.pmod(F.xxhash64("app_id"), F.col("_blocks")).cast("int"))
    rows = placed.join(sets.select("app_id", *(F.col(x).alias(f"t_{i}") for i, x in enumerate(layers))), "app_id", "left")
    rows = _packed(rows, numbers) if numbers else rows
    tile = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(F.col("_block"), j).alias("p"), F.greatest(F.col("_block"), j).alias("q")))
    kept = [f"t_{i}" for i in range(len(layers))] + [f"n_{i}" for i in numbers or []]
    return rows.withColumn("_tile", F.explode(tile)).select("grp", F.col("_tile.p").alias("p"), F.col("_tile.q").alias("q"), "_block", "app_id", *carry, *kept)


def _sides(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Array, np.ndarray, np.ndarray]:
    """A tile's rows by app_id, their ids, and the rows of either block."""
    table = pa.Table.from_batches(list(batches)).sort_by("app_id")
    side = table["_block"].to_numpy()
    return table, table["app_id"].combine_chunks(), np.flatnonzero(side == key[1].as_py()), np.flatnonzero(side == key[2].as_py())


def _parts(table: pa.Table, left: np.ndarray, right: np.ndarray, block: int, same: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, bool]]:
    """The table's rows for `block` members of either side at a time, which of them are left and right, and whether these are the same; `same` sides meet once."""
    table = table.combine_chunks()
    for i in range(0, len(left), block):
        for j in range(i if same else 0, len(right), block):
            x, y, alike = left[i : i + block], right[j : j + block], same and i == j
            rows = x if alike else np.sort(np.concatenate([x, y]))
            yield table.take(pa.array(rows)), np.searchsorted(rows, x), np.searchsorted(rows, y), alike


def _pairs(ids: pa.Array, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, x, y, a, b) for ROWS of the left block at a time: cells x, y of the wanted pairs and their rows a, b, the smaller id first."""
    rank = pc.rank(ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    for first in range(0, len(left), ROWS):
        mine = left[first : first + ROWS]
        # Within a block each pair stands twice, between blocks once, in either order.
        wanted = rank[mine][:, None] < rank[right][None, :] if same else rank[mine][:, None] != rank[right][None, :]
        x, y = np.nonzero(wanted)
        i, j = mine[x], right[y]
        yield first, first + len(mine), x, y, np.minimum(i, j), np.maximum(i, j)


def group_counts(sets: DataFrame, members: DataFrame, layers: list[str], block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, and for each layer i shared_i, n_a_i, n_b_i): every pair a < b of members of one group.

    `sets` has (app_id, an array column for each layer), `members` (app_id,
    grp) and the columns to `carry`, which come out with _a and _b.  Members without a row in `sets` have empty sets.  Null ids and null
    groups pair with nothing; null tokens count for the size only.  Sets of
    whole numbers move packed.
    """
    numbers = _whole(sets, layers)
    names = [f"{c}_{i}" for i in range(len(layers)) for c in ("shared", "n_a", "n_b")]
    carried = [f"{c}_{x}" for c in carry for x in "ab"]
    key = members.schema["app_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, _, *sides = _sides(key, batches)
        if not len(sides[0]) or not len(sides[1]):
            return
        for table, left, right, same in _parts(whole, *sides, block, key[1] == key[2]):
            ids, every = _joined(table["app_id"]), []
            for i in range(len(names) // 3):
                if i in numbers:
                    sizes, (at, values) = table[f"n_{i}"].to_numpy().astype(np.int64), _unpack(_joined(table[f"t_{i}"]))
                    codes = pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)
                else:
                    sizes, at, codes = _postings(table[f"t_{i}"], len(table))
                every.append((sizes, _Shared(at, codes, left, right)))
            for first, last, x, y, a, b in _pairs(ids, left, right, same):
                columns = [ids.take(pa.array(a)), ids.take(pa.array(b))]
                for sizes, shared in every:
                    columns += [pa.array(v.astype(np.int32)) for v in (shared.part(first, last)[x, y], sizes[a], sizes[b])]
                columns += [_joined(table[c]).take(pa.array(v)) for c in carry for v in (a, b)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", *names, *carried])

    schema = StructType.fromDDL(", ".join([f"a {key}, b {key}", *(f"{n} int" for n in names), *(f"{c} {members.schema[c[:-2]].dataType.simpleString()}" for c in carried)]))
    return _tiles(sets, members, layers, block, carry, numbers).groupBy("grp", "p", "q").applyInArrow(run, schema)


def group_weights(sets: DataFrame, members: DataFrame, layers: list[str], block: int = BLOCK) -> DataFrame:
    """(a, b, both, x, y): the weight of the tokens that a pair shares and of each side's, over all layers; every pair of one group.

    `sets` has (app_id, for each layer an array of tokens without nulls, and
    an array of their weights in the same order, named like it with _w).  The
    rest is as in group_counts.
    """
    key = members.schema["app_id"].dataType.simpleString()
    k = len(layers)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids, left, right = _sides(key, batches)
        if not len(left) or not len(right):
            return
        rows, codes, weights, held = [], [], [], 0
        for i in range(k):
            _, at, mine = _postings(table[f"t_{i}"], len(table))
            w = np.zeros(int(mine.max(initial=-1)) + 1)
            w[mine] = _joined(table[f"t_{k + i}"]).flatten().to_numpy(zero_copy_only=False)
            rows, codes, weights, held = [*rows, at], [*codes, mine + held], [*weights, w], held + len(w)
        rows, codes, weights = (np.concatenate(v) for v in (rows, codes, weights))
        total = np.bincount(rows, weights[codes], len(table))
        shared = _Shared(rows, codes, left, right, weights)
        for first, last, x, y, a, b in _pairs(ids, left, right, key[1] == key[2]):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), *(pa.array(v) for v in (shared.part(first, last)[x, y], total[a], total[b]))], ["a", "b", "both", "x", "y"])

    return _tiles(sets, members, [*layers, *(f"{x}_w" for x in layers)], block).groupBy("grp", "p", "q").applyInArrow(run, f"a {key}, b {key}, both double, x double, y double")


def layer_rows(counts: DataFrame, layers: list[str]) -> DataFrame:
    """(a, b, layer, shared, n_a, n_b): group_counts with a row for each layer."""
    each = F.array(*(F.struct(F.lit(x).alias("layer"), *(F.col(f"{c}_{i}").cast("long").alias(c) for c in ("shared", "n_a", "n_b"))) for i, x in enumerate(layers)))
    return counts.select("a", "b", F.explode(each).alias("x")).select("a", "b", "x.*")
