"""Set metrics against plain versions, with the conventions for empty sets."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import scalars, similarity

SETS = [([], []), (["a"], []), ([], ["a"]), (["a"], ["a"]), (["a"], ["b"]), (["a", "b", "c"], ["b", "c", "d", "e"]), (list("abcdefgh"), list("cdefghij")), (["x"], list("xyz"))]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SETS)], "i int, a array<string>, b array<string>")


def plain(metric, a, b):
    a, b = set(a), set(b)
    s = len(a & b)
    if metric == "shared_count":
        return float(s)
    if not a or not b or not s:
        return 0.0
    return s / {"jaccard": len(a | b), "cosine": math.sqrt(len(a)) * math.sqrt(len(b)), "containment": min(len(a), len(b)), "dice": (len(a) + len(b)) / 2, "overlap": max(len(a), len(b))}[metric]


@pytest.mark.parametrize("metric", ["jaccard", "cosine", "containment", "dice", "overlap", "shared_count"])
def test_metrics(pairs, metric):
    got = {r.i: r.s for r in pairs.select("i", similarity.set_metric(metric, F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == pytest.approx({i: plain(metric, a, b) for i, (a, b) in enumerate(SETS)})


def test_aliases():
    assert similarity.canonical_metric("overlap_coefficient") == "containment" and similarity.canonical_metric(" JAC ") == "jaccard"
    with pytest.raises(ValueError):
        similarity.canonical_metric("other")


def test_empty_sets_differ_by_metric(pairs):
    a, b = F.col("a"), F.col("b")
    r = pairs.select("i", similarity.jaccard(a, b, 1.0).alias("j1"), similarity.tversky(a, b, 1, 0).alias("ta"), similarity.tversky(a, b, 0, 1).alias("tb"), similarity.overlap_min(a, b).alias("o"), similarity.channels(a, b).alias("c")).collect()
    assert (r[0].j1, r[0].ta, r[0].o) == (1, 1, 1) and tuple(r[0].c) == (0, 0, 0, 0)
    assert (r[1].j1, r[1].ta, r[1].tb, r[1].o) == (0, 0, 0, 0) and (r[3].ta, r[3].o) == (1, 1)
    assert r[5].ta == pytest.approx(2 / 3) and r[5].tb == pytest.approx(2 / 4)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_levenshtein(pairs):
    got = {r.i: r.s for r in pairs.select("i", similarity.set_metric("lev", F.col("a"), F.col("b")).alias("s")).collect()}
    want = {i: 0.0 if not a and not b else 1 - edit(sorted(a), sorted(b)) / max(len(a), len(b)) for i, (a, b) in enumerate(SETS)}
    assert got == pytest.approx(want)


def test_weighted_jaccard_and_idf(spark):
    row = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("a"), F.array(F.lit("b"), F.lit("c")).alias("b"), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(3.0)).alias("w"))
    assert row.select(similarity.weighted_jaccard(F.col("a"), F.col("b"), F.col("w"))).first()[0] == pytest.approx(3 / 6)
    got = spark.range(1).select(similarity.idf(F.lit(10), F.lit(2)).alias("x"), similarity.idf(F.lit(3), F.lit(9)).alias("y")).first()
    assert got.x == pytest.approx(math.log(5)) and got.y == 0


def test_signature_status(spark):
    rows = [("k", "k", [], []), ("k", "m", ["m"], []), ("k", "m", [], []), (None, "m", [], []), (None, None, [], [])]
    d = spark.createDataFrame(rows, "a string, b string, la array<string>, lb array<string>")
    got = [r.s.status for r in d.select(similarity.signature_match(*(F.col(c) for c in ("a", "b", "la", "lb"))).alias("s")).collect()]
    assert got == ["match", "match_via_rotation", "mismatch", "missing", "both_missing"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sets(st.integers(0, 9)), st.sets(st.integers(0, 9))), min_size=1, max_size=20))
def test_symmetry_and_range(spark, sets):
    d = spark.createDataFrame([(sorted(a), sorted(b)) for a, b in sets], "a array<int>, b array<int>")
    for m in ("jaccard", "cosine", "dice", "containment", "overlap"):
        for r in d.select(similarity.set_metric(m, F.col("a"), F.col("b")).alias("x"), similarity.set_metric(m, F.col("b"), F.col("a")).alias("y")).collect():
            assert r.x == pytest.approx(r.y) and 0 <= r.x <= 1 + 1e-12


def test_scalars(spark):
    d = spark.createDataFrame([("com.app_12", "a, b\n\nc|a", "2024-01-02T03", "00000000000000ff"), ("plain", None, "bad", "zz")], "p string, l string, t string, h string")
    got = d.select(scalars.package_version(F.col("p")).alias("p"), scalars.split_strings(F.col("l")).alias("l"), scalars.day_key(F.col("t")).alias("t"), scalars.hex_hash(F.col("h")).alias("h")).collect()
    assert tuple(got[0].p) == ("com.app", "12") and got[0].l == ["a", "b", "c", "a"] and got[0].t == "2024-01-02" and got[0].h == 255
    assert tuple(got[1].p) == ("plain", None) and got[1].l is None and got[1].t == "unknown" and got[1].h is None
    bins = spark.createDataFrame([(x,) for x in (-1, 0, 3, 4, 15, 63, 64)], "n int").select(scalars.size_bucket(F.col("n")).alias("b")).collect()
    assert [r.b for r in bins] == ["0", "0", "1_3", "4_7", "8_15", "32_63", "64_plus"]
