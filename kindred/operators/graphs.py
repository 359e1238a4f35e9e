"""Graphs of code blocks: edit similarity of pairs, and greedy matching of similarity tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity

#: Partial mappings that a search looks at, at most.
STATES = 200_000


def matched_cells(table: np.ndarray, names_a: list[str], names_b: list[str]) -> list[tuple[int, int]]:
    """The cells that greedy_matching takes, in the order in which it takes them."""
    rows, cols = (np.ones(size, bool) for size in table.shape)
    out = []

    def best(line: np.ndarray, open_here: bool, free: np.ndarray, name: str, names: list[str]) -> tuple[float, int]:
        if not open_here or not free.any():
            return -1.0, -1
        top = line[free].max()
        ties = np.flatnonzero(free & (line == top))
        return top, next((int(t) for t in ties if names[t] == name), int(ties[-1]))

    for i, j in np.ndindex(*table.shape):
        across, c = best(table[i], rows[i], cols, names_a[i], names_b)
        down, r = best(table[:, j], cols[j], rows, names_b[j], names_a)
        if across < 0 and down < 0:
            continue
        cell = (i, c) if across > down else (r, j)
        rows[cell[0]] = cols[cell[1]] = False
        out.append(cell)
    return out


def greedy_matching(cells: DataFrame, names_a: DataFrame, names_b: DataFrame) -> DataFrame:
    """(pair_id, i, j, similarity) of a greedy one-to-one matching of each pair's table (pair_id, i, j, sim).

    Cells are visited row by row.  A used row or column has nothing left to
    offer; a cell is passed over only if both its row and its column are used.
    The best free cell of the row stands against the best free one of the
    column: the row's is taken if it is greater, else the column's.  Of equal
    ones, that whose two names are equal is taken, else the last.  Taking a
    cell uses up its row and its column.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = int(pdf["n"].iloc[0]), int(pdf["m"].iloc[0])
        table = np.zeros((n, m))
        table[pdf["i"], pdf["j"]] = pdf["sim"]
        out = [(pdf["pair_id"].iloc[0], r, c, float(table[r, c])) for r, c in matched_cells(table, list(pdf["names_a"].iloc[0]), list(pdf["names_b"].iloc[0]))]
        return pd.DataFrame(out, columns=["pair_id", "i", "j", "similarity"])

    sized = cells.join(names_a.withColumnRenamed("names", "names_a").selectExpr("pair_id", "names_a", "size(names_a) n"), "pair_id").join(names_b.withColumnRenamed("names", "names_b").selectExpr("pair_id", "names_b", "size(names_b) m"), "pair_id")
    return sized.groupBy("pair_id").applyInPandas(run, "pair_id string, i int, j int, similarity double")


def matching_score(matches: DataFrame, names_a: DataFrame, names_b: DataFrame) -> DataFrame:
    """(pair_id, score): matched similarity over the number of names on the larger side; 0 if a side is empty."""
    sizes = names_a.selectExpr("pair_id", "size(names) n").join(names_b.selectExpr("pair_id", "size(names) m"), "pair_id")
    sums = matches.groupBy("pair_id").agg({"similarity": "sum"}).withColumnRenamed("sum(similarity)", "total")
    return sizes.join(sums, "pair_id", "left").selectExpr("pair_id", "coalesce(total / nullif(greatest(n, m), 0), 0.0) score")


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def blocks_match(a: str, b: str, threshold: float) -> bool:
    """Whether two blocks' texts are similar; an empty text matches nothing."""
    return bool(a) and bool(b) and 1 - _levenshtein(a, b) / max(len(a), len(b)) >= threshold


def edit_distance(nodes_a: list[str], edges_a: set[tuple[int, int]], nodes_b: list[str], edges_b: set[tuple[int, int]], threshold: float = 0.8, states: int = STATES) -> tuple[float, bool]:
    """(least number of node and edge insertions, deletions and relabellings, whether it is proven).

    After `states` partial mappings the best found so far stands, the same on
    every machine.

    Depth-first branch and bound: nodes of the first graph are mapped in order
    to free nodes of the second, matching ones first, or deleted; edges are
    settled as soon as both ends are.
    """
    n, m = len(nodes_a), len(nodes_b)
    cost = np.array([[0.0 if blocks_match(x, y, threshold) else 1.0 for y in nodes_b] for x in nodes_a]).reshape(n, m)
    best = [float(n + m + len(edges_a) + len(edges_b))]
    left = [states]
    place: list[int | None] = []

    def edges_cost(i: int, j: int | None) -> float:
        total = 0.0
        for k, at in enumerate([*place, j]):
            for p, q, r, s in ((i, k, j, at), (k, i, at, j)) if k != i else ((i, i, j, j),):
                total += ((p, q) in edges_a) != (r is not None and s is not None and (r, s) in edges_b)
        return total

    def walk(i: int, so_far: float, used: frozenset[int]) -> None:
        left[0] -= 1
        if left[0] < 0 or so_far + max(0, (m - len(used)) - (n - i)) >= best[0]:
            return
        if i == n:
            free = m - len(used)
            loose = sum(1 for x, y in edges_b if x not in used or y not in used)
            best[0] = min(best[0], so_far + free + loose)
            return
        for j in sorted((j for j in range(m) if j not in used), key=lambda j: (cost[i, j], j)):
            step = cost[i, j] + edges_cost(i, j)
            place.append(j)
            walk(i + 1, so_far + step, used | {j})
            place.pop()
        step = 1.0 + edges_cost(i, None)
        place.append(None)
        walk(i + 1, so_far + step, used)
        place.pop()

    walk(0, 0.0, frozenset())
    return best[0], left[0] >= 0


def graph_similarity(pairs: DataFrame, threshold: float = 0.8, states: int = STATES) -> DataFrame:
    """(pair_id, similarity, status) of rows (pair_id, nodes_a, src_a, dst_a, nodes_b, src_b, dst_b).

    The similarity is 1 - distance / larger number of nodes and edges; status is
    exact, or bound where the search stopped before the distance was proven.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ea, eb = set(zip(r.src_a, r.dst_a, strict=True)), set(zip(r.src_b, r.dst_b, strict=True))
                size = max(len(r.nodes_a) + len(ea), len(r.nodes_b) + len(eb))
                d, proven = edit_distance(list(r.nodes_a), ea, list(r.nodes_b), eb, threshold, states)
                out.append((r.pair_id, 1 - d / size if size else 0.0, "exact" if proven else "bound"))
            yield pd.DataFrame(out, columns=["pair_id", "similarity", "status"])

    return pairs.mapInPandas(run, "pair_id string, similarity double, status string")


def similarity_tables(left: DataFrame, right: DataFrame, threshold: float = 0.8, states: int = STATES) -> DataFrame:
    """(pair_id, i, j, sim): every graph of one app against every graph of the other, for greedy_matching.

    Both sides are rows (pair_id, idx, nodes, src, dst); graphs meet only
    within a pair.
    """
    side = lambda df, x, at: df.select("pair_id", F.col("idx").alias(at), *(F.col(c).alias(f"{c}_{x}") for c in ("nodes", "src", "dst")))
    cells = side(left, "a", "i").join(side(right, "b", "j"), "pair_id")
    keyed = cells.withColumn("pair_id", F.concat_ws("\x1f", "pair_id", "i", "j"))
    parts = F.split("pair_id", "\x1f")
    return graph_similarity(keyed.drop("i", "j"), threshold, states).select(F.get(parts, F.lit(0)).alias("pair_id"), F.get(parts, F.lit(1)).cast("int").alias("i"), F.get(parts, F.lit(2)).cast("int").alias("j"), F.col("similarity").alias("sim"))


def library_reduced_graphs(names_a: Column, names_b: Column, is_library) -> Column:
    """Jaccard of two sets of graph names without library ones; 0 if nothing is left."""
    own = lambda s: F.array_distinct(F.filter(s, lambda x: ~is_library(x)))
    return similarity.jaccard(own(names_a), own(names_b))
