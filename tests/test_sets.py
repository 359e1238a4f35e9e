"""Exact joins of sets by classes of tokens, against all pairs."""

import itertools
import random

import pytest

from kindred.operators import simjoin
from kindred.plans import bindings


@pytest.mark.parametrize(("threshold", "class_tokens"), [(0.15, 1 << 22), (0.5, 40), (0.7, 1 << 22), (1.0, 40)])
def test_sets_equal_brute_force(spark, threshold, class_tokens, monkeypatch):
    monkeypatch.setattr(simjoin, "CLASS_TOKENS", class_tokens)
    rng = random.Random(9)
    base = [rng.sample(range(300), rng.randint(1, 60)) for _ in range(40)]
    near = [[x for x in rng.choice(base) if rng.random() < rng.choice([0.6, 0.8, 0.95])] + rng.sample(range(300), rng.randint(0, 4)) for _ in range(120)]
    sets = {i: list(dict.fromkeys(v)) for i, v in enumerate([*base, *near, base[0], base[0], [], [7], [7]])}
    rows = [(i, [hash((k, "t")) for k in v]) for i, v in sets.items()] + [(None, [hash((7, "t"))])]
    got = [tuple(r) for r in simjoin.jaccard_sets(spark.createDataFrame(rows, "app_id long, set array<long>").repartition(3), threshold).collect()]
    want = {}
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        score = len(set(x) & set(y)) / max(len(set(x) | set(y)), 1)
        if score >= threshold:
            want[a, b] = score
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == pytest.approx(want)


def test_document_sets_join_repeated_ids(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "b c d e"), (2, "A b\nc d  e"), (3, "a b"), (4, None), (5, "x y z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.app_id: len(r.set) for r in bindings.document_sets(spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 3, 5: 1}
    assert [tuple(r) for r in simjoin.jaccard_sets(bindings.document_sets(spark, str(tmp_path)), 0.7).collect()] == [(1, 2, 1.0)]
