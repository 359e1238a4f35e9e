"""Joins, masks, scores, evidence, evaluation, views and graphs on small inputs."""

import hashlib
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import evaluate, evidence, graphs, masks, pairs, scoring, simjoin, views


def make(spark, sets, layer="code"):
    return spark.createDataFrame([(a, layer, t) for a, s in sets.items() for t in s], "app_id string, layer string, token string")


def clusters(seed=1):
    rnd = random.Random(seed)
    out = {}
    for c in range(6):
        base = [f"f{c}_{i}" for i in range(20)] + ["everywhere"]
        for k in range(4):
            s = set(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                s.discard(rnd.choice(base))
                s.add(f"x{rnd.randrange(50)}")
            out[f"app{c}{k}"] = s
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.7, 0.95])
def test_jaccard_join_equals_brute_force(spark, threshold):
    sets = clusters()
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {k: v for k, v in want.items() if v >= threshold}
    got = {(r.a, r.b): r.score for r in simjoin.score_join(make(spark, sets), "jaccard", threshold).collect()}
    assert got == pytest.approx(want)
    counted = simjoin.pair_counts(make(spark, sets)).where("a < b").count()
    assert counted >= len(got)
    ranked = simjoin.rank_candidates(simjoin.score_join(make(spark, sets), "jaccard", threshold)).orderBy("retrieval_rank").collect()
    assert [r.retrieval_rank for r in ranked] == list(range(1, len(want) + 1))
    keys = [(-r.retrieval_score, r.query_app_id, r.candidate_app_id) for r in ranked]
    assert keys == sorted(keys)


def test_join_needs_a_threshold_and_unique_records(spark):
    with pytest.raises(ValueError):
        simjoin.score_join(make(spark, {"a": ["t"]}), "cosine", 0.0)
    with pytest.raises(ValueError):
        simjoin.validate_records(spark.createDataFrame([("a",), ("a",), ("b",)], "app_id string"))


def test_lsh_finds_what_it_should(spark):
    tokens = make(spark, clusters())
    exact = {(r.a, r.b) for r in simjoin.score_join(tokens, "jaccard", 0.85).collect()}
    for signer in (simjoin.minhash_native, simjoin.minhash_md5):
        got = {(r.a, r.b) for r in simjoin.lsh_join(tokens, "jaccard", 0.85, 64, 32, signer=signer).collect()}
        assert got <= exact and len(got) >= 0.95 * len(exact)


def test_blake2b_signature_is_the_keyed_minimum(spark):
    sig = {r.app_id: r.signature for r in simjoin.minhash_blake2b(make(spark, {"a": ["t1", "t2"], "b": ["t2"]}), 4, 7).collect()}
    slot = lambda f, i: hashlib.blake2b(f.encode(), digest_size=8, person=struct.pack(">QQ", 7, i)).hexdigest()
    assert sig["b"] == [slot("code:t2", i) for i in range(4)] and sig["a"] == [min(slot("code:t1", i), slot("code:t2", i)) for i in range(4)]


def test_queries_against_a_corpus(spark):
    sets = clusters(3)
    tokens = make(spark, sets)
    got = simjoin.query_corpus_join(tokens.where("app_id like '%0'"), tokens, "jaccard", 0.6).collect()
    want = {(q, c) for q in sets for c in sets if q.endswith("0") and q != c and len(sets[q] & sets[c]) / len(sets[q] | sets[c]) >= 0.6}
    assert {(r.query_app_id, r.candidate_app_id) for r in got} == want


def test_prefixes_and_coverage(spark):
    names = spark.createDataFrame([("com.google.a.B",), ("com.googlex.c",), ("org.x",), ("com",)], "name string")
    cat = spark.createDataFrame([("com.google",), ("com",), ("com.google.a",)], "prefix string")
    assert {r.name: r.matched_prefix for r in simjoin.longest_prefix(names, cat).collect()} == {"com.google.a.B": "com.google.a", "com.googlex.c": "com", "org.x": None, "com": "com"}
    packages = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "app_id string, package string")
    catalogue = spark.createDataFrame([("t", "p1"), ("t", "p2"), ("t", "p9"), ("u", "p3"), ("u", "p7"), ("u", "p8"), ("u", "p6")], "tpl_id string, package string")
    assert {(r.app_id, r.tpl_id, r.detected) for r in simjoin.coverage_join(packages, catalogue).collect()} == {("a", "t", True), ("b", "u", False)}


def test_gate_splits_without_loss(spark):
    rows = spark.createDataFrame([("a", ["fake", "adware"]), ("b", []), ("c", None), ("d", ["other"])], "app_id string, envelope_triggers array<string>")
    passed, rejected = masks.noise_gate(rows, ["adware", "fake"])
    assert sorted(r.app_id for r in passed.collect()) == ["b", "c", "d"] and [(r.app_id, r.reject_reason) for r in rejected.collect()] == [("a", "adware")]
    assert masks.noise_gate(rows, [])[0].count() == 4


def test_masks_and_reduced_score(spark):
    tokens = spark.createDataFrame([("a", "component", "activity:com.google.X"), ("a", "component", "activity:com.me.Y"), ("a", "component", "activity:com.googleplus.Z"), ("b", "component", "activity:com.me.Y"), ("b", "library", "com.google")], "app_id string, layer string, token string")
    kept = masks.apply_prefix_mask(tokens, spark.createDataFrame([("com.google",)], "prefix string"))
    assert sorted(r.token for r in kept.collect()) == ["activity:com.googleplus.Z", "activity:com.me.Y", "activity:com.me.Y"]
    pairs = spark.createDataFrame([("a", "b"), ("x", "y")], "a string, b string")
    assert {(r.a, round(r.library_reduced_score, 6)) for r in masks.reduced_score(tokens, pairs).collect()} == {("a", round(1 / 3, 6)), ("x", 0.0)}


def test_file_classes(spark):
    paths = ["META-INF/CERT.RSA", "AndroidManifest.xml", "smali/com/me/R.smali", "smali/com/google/a/B.smali", "smali_classes2/com/me/C.smali"]
    d = spark.createDataFrame([("a", p) for p in paths], "app_id string, path string").withColumn("c", masks.classify_file(F.col("path"))).select("app_id", "path", "c.*")
    assert [r.category for r in d.collect()] == list(masks.NOISE_CATEGORIES)
    assert tuple(masks.noise_summary(d).first())[1:] == (1, 1, 1, 1, 1)


def test_weights_skip_layers_that_are_empty_on_both_sides(spark):
    tokens = make(spark, {"a": ["x", "y"], "b": ["x"]}, "component").union(make(spark, {"a": ["l"], "b": ["m"]}, "library")).union(make(spark, {"c": ["z"]}, "code"))
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    scores = scoring.layer_scores(tokens, pairs)
    assert {(r.layer, r.status) for r in scores.collect()} == {("component", "ok"), ("library", "ok"), ("code", "both_empty")}
    assert scoring.weighted_score(scores).first().full_similarity_score == round(0.6 * 0.5 / 0.95, 6)
    by = {r.config: r.score for r in scoring.ablation(scores).collect()}
    assert by["code_only"] == 0.0 and by["code_component"] == 0.5 and len(by) == 13
    assert scoring.valid_weights({"code": 0.5}) == scoring.LAYER_WEIGHTS and scoring.valid_weights({"code": 1.0}) == {"code": 1.0}


def test_decisions(spark):
    d = spark.createDataFrame([(0.96, "match", 0.8, False), (0.96, "match_via_rotation", 0.5, False), (0.5, "match", None, True)], "s double, g string, r double, f boolean")
    got = d.select(scoring.shortcut_flags(F.col("s"), F.col("g")).alias("x"), scoring.decide(F.col("r"), 0.7, F.col("f")).alias("d")).collect()
    assert [r.x.shortcut_applied for r in got] == [True, False, False] and [r.d for r in got] == ["success", "low_similarity", "analysis_failed"]


def test_evidence(spark):
    d = spark.createDataFrame([(["code", "library"], {"code": 0.2}, 0.5, 0.9, 0.0, False), (["code"], {}, 0.5, None, None, True)], "v array<string>, m map<string,double>, f double, r double, s double, x boolean")
    rows = d.select(evidence.from_pair(*(F.col(c) for c in "vmfrsx")).alias("e")).collect()
    assert [tuple(e) for e in rows[0].e] == [("pairwise", "layer_score", 0.2, "code"), ("pairwise", "layer_score", 0.9, "library"), ("signing", "signature_match", 0.0, "apk_signature")] and rows[1].e == []
    e = d.limit(1).select(F.explode(evidence.from_pair(*(F.col(c) for c in "vmfrsx"))).alias("e"))
    assert [r.t for r in e.select(evidence.taxonomy(F.col("e")).alias("t")).collect()] == ["CodeRemoval", "LibraryImpact", "CertificateMismatch"]
    both = d.limit(1).select(evidence.from_pair(*(F.col(c) for c in "vmfrsx")).alias("e")).select(evidence.merge(F.col("e"), F.col("e")).alias("m"), evidence.text(F.col("e")).alias("t")).first()
    assert len(both.m) == 3 and both.t == "layer_score(library)=0.90; layer_score(code)=0.20; signature_match(apk_signature)=0.00"


def test_evaluation(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.4, 1), (0.2, 0)], "score double, label int")
    at = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.roc_grid(scored, [0.7, 0.95]).collect()}
    assert at == {0.7: (2, 1, 1, 1), 0.95: (0, 0, 3, 2)}
    seen = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.roc_observed(scored).collect()}
    assert seen[0.7] == (2, 1, 1, 1) and seen[0.2] == (3, 2, 0, 0)
    assert evaluate.operating_point(evaluate.roc_observed(scored)).first().threshold == 0.4
    k = evaluate.kappa(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "a int, b int")).first()
    assert (k.observed, k.expected, k.kappa) == (0.75, 0.5, 0.5)
    assert evaluate.kappa(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")).first().kappa == 1.0
    assert len(evaluate.simplex(["a", "b", "c", "d"], 20)) == 1771
    wide = spark.createDataFrame([(1, 0.9, 0.1), (1, 0.8, 0.9), (0, 0.1, 0.9), (0, 0.2, 0.2)], "label int, x double, y double")
    best = evaluate.weight_search(wide, ["x", "y"], 4).first()
    assert best.f1 == 1.0 and best.x >= 0.5
    parts = evaluate.split(scored.withColumn("key", F.col("score")), "key", 0.7).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 3, "test": 2}
    b = evaluate.bootstrap(scored.withColumn("key", F.col("score")), "score", "key", 200).first()
    assert b.low <= b.median <= b.high


def test_views(spark):
    calls = spark.createDataFrame([(1, i, s) for i, s in enumerate("abac")] + [(2, 0, "a")], "app long, pos int, s string")
    chain = views.markov_chain(calls, "app", "pos", "s")
    assert {(r.from_state, r.to_state): r.prob for r in chain.collect()} == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "a"): 1.0}
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "a long, b long")
    assert {(r.a, r.b): (r.score, r.status) for r in views.chain_cosine(chain, pairs, "app").collect()} == {(1, 1): (1.0, "ok"), (1, 2): (0.0, "one_empty"), (2, 3): (0.0, "both_empty")}
    seqs = spark.createDataFrame([("p", "m1", list("abcdefgh")), ("q", "m1", list("abcdefgh")), ("q", "m2", ["a"])], "app_id string, method_id string, ops array<string>")
    m = views.blake2b_simhash(seqs, ["app_id", "method_id"], "ops")
    got = views.compare_methods(m, spark.createDataFrame([("p", "q"), ("p", "z")], "a string, b string")).collect()
    assert {(r.b, r.score, r.status) for r in got} == {("q", 0.5, "fuzzy_ok"), ("z", 0.0, "one_empty")}
    assert sorted(r.fingerprint[:2] for r in m.collect()) == ["B:", "S:", "S:"]
    same = views.simhash(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x")], "id string, g string"), ["id"], "g").collect()
    assert same[0].fingerprint == same[1].fingerprint
    comp = spark.createDataFrame([("a", "N", [(["v", "w"], [], ["d"], 0), ([], [], [], 5)])], "app_id string, name string, filters array<struct<actions:array<string>,categories:array<string>,data:array<string>,priority:int>>")
    assert {(r.action, r.category, r.data, r.priority_bucket) for r in views.expand_filters(comp).collect()} == {("v", "", "d", "default"), ("w", "", "d", "default"), ("", "", "", "high")}
    img = spark.createDataFrame([("i", [float(x) for x in range(256)], 16, 16), ("j", [float(x) + 7 for x in range(256)], 16, 16)], "k string, px array<double>, w int, h int")
    hashes = views.image_hashes(img, "k", "px", "w", "h").collect()
    assert tuple(hashes[0])[1:] == tuple(hashes[1])[1:] and len(hashes[0].average_hash) == 16


def test_greedy_matching_and_graph_distance(spark):
    cells = spark.createDataFrame([("p", 0, 0, 0.5), ("p", 0, 1, 0.9), ("p", 1, 0, 0.4), ("p", 1, 1, 0.9)], "pair_id string, i int, j int, sim double")
    a = spark.createDataFrame([("p", ["x", "y"])], "pair_id string, names array<string>")
    m = graphs.greedy_matching(cells, a, a)
    got = {(r.i, r.j, r.similarity) for r in m.collect()}
    assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == 2
    assert graphs.matching_score(m, a, a).first().score == pytest.approx(sum(s for _, _, s in got) / 2)
    assert graphs.edit_distance(["aa", "bb"], {(0, 1)}, ["aa", "bb"], {(0, 1)}) == (0, True)
    assert graphs.edit_distance(["aa", "bb"], {(0, 1)}, ["aa"], set()) == (2, True)
    assert graphs.edit_distance([], set(), ["aa"], {(0, 0)}) == (2, True)
    assert graphs.edit_distance(["ab"] * 6, set(), ["cd"] * 6, set(), states=5)[1] is False
    g = "array<string>, src_{0} array<int>, dst_{0} array<int>".format
    pair = spark.createDataFrame([("p", ["aa", "bb"], [0], [1], ["aa"], [], [])], f"pair_id string, nodes_a {g('a')}, nodes_b {g('b')}")
    assert tuple(graphs.graph_similarity(pair).first()) == ("p", pytest.approx(1 / 3), "exact")
    side = spark.createDataFrame([("p", 0, ["aa"], [], []), ("p", 1, ["zz", "aa"], [], [])], "pair_id string, idx int, nodes array<string>, src array<int>, dst array<int>")
    assert {(r.i, r.j, r.sim) for r in graphs.similarity_tables(side, side).collect()} == {(0, 0, 1.0), (1, 1, 1.0), (0, 1, 0.5), (1, 0, 0.5)}


def test_greedy_matching_takes_cells_of_used_rows_whose_column_is_free():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        table = rnd.integers(0, 4, (4, 4)) / 4
        names = [[f"n{x}" for x in rnd.integers(0, 6, 4)] for _ in range(2)]
        assert graphs.matched_cells(table, *names) == plain_matching(table, *names)


def plain_matching(table, a, b):
    left, out = table.copy(), []

    def pick(line, name, names):
        if line.max() == -1:
            return -1, -1
        for k in np.flatnonzero(line == line.max()):
            if names[k] == name:
                break
        return k, line.max()

    for i in range(len(a)):
        for j in range(len(b)):
            (c, x), (r, y) = pick(left[i], a[i], b), pick(left[:, j], b[j], a)
            if x == y == -1:
                continue
            at = (i, c) if x > y else (r, j)
            left[at[0]] = left[:, at[1]] = -1
            out.append((int(at[0]), int(at[1])))
    return out


def spin(row):
    while row["pair_id"] == "slow":
        pass
    if row["pair_id"] == "bad":
        raise ValueError("no")
    if row["pair_id"] == "crash":
        os._exit(3)
    return row["x"] / 2


def test_pairs_have_deadlines_and_fail_alone(spark):
    rows = [(i, n, float(i)) for i, n in enumerate(["one", "slow", "bad", "two"])]
    schema = "pos long, pair_id string, x double"
    for apart in (False, True):
        more = [*rows, (4, "crash", 1.0), (5, "last", 8.0)] if apart else rows
        got = pairs.map_pairs(spark.createDataFrame(more, schema), spin, 0.3, apart).orderBy("pos").collect()
        want = [("one", 0.0, "success", None), ("slow", None, "budget_exceeded", "pair_timeout"), ("bad", None, "analysis_failed", "ValueError: no"), ("two", 1.5, "success", None)]
        want += [("crash", None, "analysis_failed", "worker_crashed"), ("last", 4.0, "success", None)] if apart else []
        assert [(r.pair_id, r.score, r.status, r.reason) for r in got] == want
    assert pairs.incidents(pairs.map_pairs(spark.createDataFrame(rows, schema), spin, 0.3)).collect()[0].pair_id == "slow"
