"""Files in, files out, and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kindred.operators import reports
from kindred.sources import binaries, records
from kindred.streaming import incidents


@pytest.mark.parametrize(
    "payload",
    [
        [{"app_id": "a", "layers": {"code": ["x", "x", None, " y "], "library": "z"}}, 7],
        {"apps": [{"id": "a", "features": {"code": ["x", "y"], "library": ["z"]}}]},
        {"a": {"code": ["y", "x"], "library": {"k": 1}}},
    ],
)
def test_records(spark, tmp_path, payload):
    (tmp_path / "r.json").write_text(json.dumps(payload))
    row = records.read_records(spark, str(tmp_path)).first()
    assert row.app_id == "a" and row.layers["code"] == ["x", "y"] and row.layers["library"] in (["z"], ["k=1"]) and row.layers["metadata"] == []


def test_record_without_id_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"layers": {}}]')
    with pytest.raises(Exception, match="app_id"):
        records.read_records(spark, str(tmp_path)).collect()


def test_candidates_of_old_and_new_form(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"shortlist": [{"app_a": {"app_id": " a "}, "app_b": "b", "score": 1}, {"query_app_id": "c", "candidate_app_id": "d", "retrieval_score": 0.5, "retrieval_rank": 2}]}))
    rows = records.read_candidates(spark, str(tmp_path))
    assert [tuple(r) for r in records.check_candidates(rows).orderBy("query_app_id").collect()] == [("a", "b", 1.0, None, "preliminary_positive"), ("c", "d", 0.5, 2, "preliminary_positive")]
    with pytest.raises(Exception, match="contract"):
        records.check_candidates(rows.withColumn("candidate_app_id", F.col("query_app_id"))).collect()


def test_labelled_pairs_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("APK_1,apk_2,Is_Clone\n x ,y,TRUE\nu,v,no\n")
    assert [tuple(r) for r in records.read_pairs_csv(spark, str(tmp_path)).collect()] == [("x", "y", "clone"), ("u", "v", "non_clone")]


LOG = [
    {"schema_version": "timeout-incident-v1", "recorded_at": "2024-01-01T10:00:00", "status": "timeout", "pair_id": "p1", "stage": "pairwise", "views_used": ["code"]},
    {"schema_version": "timeout-incident-v2", "recorded_at": "2024-01-02T10:00:00", "status": "budget_exceeded", "pair_id": "p2", "stage": "screening", "worker_started": False},
]


def test_incident_log_and_stream(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text("\n".join(map(json.dumps, LOG)) + "\nnot json\n")
    rows = {r.pair_id: r for r in records.read_incidents(spark, str(path)).collect()}
    assert rows["p1"].worker_started is True and rows["p1"].tmp_cleanup_status == "unknown" and rows["p2"].worker_started is False and rows[None]._corrupt_record == "not json"
    stream = incidents.daily_counts(records.stream_incidents(spark, str(path)).where("pair_id is not null"))
    run = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.day, r.stage, r.incidents) for r in spark.table("daily").collect()} == {("2024-01-01", "pairwise", 1), ("2024-01-02", "screening", 1)}
    good = records.read_incidents(spark, str(path)).where("pair_id is not null")
    records.append_incidents(good, str(tmp_path / "out"))
    assert records.read_incidents(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        records.append_incidents(good.withColumn("status", F.lit("odd")), str(tmp_path / "out"))


def test_queries_against_a_standing_corpus(spark):
    corpus = spark.createDataFrame([("c1", "code", t) for t in "abc"] + [("c2", "code", "z")], "app_id string, layer string, token string")
    batch = spark.createDataFrame([("q", "code", t) for t in "abd"], "app_id string, layer string, token string")
    assert [tuple(r) for r in incidents.stream_queries(batch, corpus, "jaccard", 0.5).collect()] == [("q", "c1", 0.5)]


def test_configurations():
    tree = records.parse_config("stages:\n  screening:\n    features: [code, code, library]\n    metric: jac\n    candidate_index: {num_perm: 64, bands: 16}\nnoise_gate: {enabled: true, reject_triggers: [fake]}\n")
    assert records.screening_config(tree) == {"layers": ["code", "library"], "metric": "jaccard", "threshold": 0.7, "index": {"num_perm": 64, "bands": 16, "seed": 42}, "reject_triggers": ["fake"]}
    assert records.parse_config('{"a": 1}') == {"a": 1}
    for bad in ("a:\t1", None):
        with pytest.raises(ValueError):
            records.parse_config(bad) if bad else records.screening_config({"stages": {"screening": {"metric": "cosine", "candidate_index": {"bands": 32}}}})


def test_archives_and_graphs(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in ("classes.dex", "AndroidManifest.xml", "res/layout/main.xml", "assets/a.json", "lib/arm64-v8a/x.so", "META-INF/C.RSA"):
            z.writestr(n, "x")
    (tmp_path / "app.apk").write_bytes(raw.getvalue())
    (tmp_path / "bad.apk").write_bytes(b"no zip")
    got = {r.app_id: r for r in binaries.read_archives(spark, str(tmp_path)).collect()}
    assert got["bad"].status == "error" and got["app"].layers["code"] == ["dex:classes.dex"] and "entry_bin:4_7" in got["app"].layers["metadata"] and got["app"].layers["library"] == ["lib_abi:arm64-v8a", "meta_inf_ext:rsa"]
    (tmp_path / "g.dot").write_text('digraph "g" {\n node [shape=box];\n "n1" [label="a = 1"];\n "n2" [label="return"];\n "n1" -> "n2";\n}\n')
    g = binaries.read_graphs(spark, str(tmp_path)).first()
    assert [(n.id, n.data) for n in g.nodes] == [("n1", "a = 1"), ("n2", "return")] and [(e.src, e.dst) for e in g.edges] == [("n1", "n2")]
    assert [binaries.count_bucket(n) for n in (0, 3, 4, 8, 31, 63, 64)] == ["0", "1_3", "4_7", "8_15", "16_31", "32_63", "64_plus"]


def test_feature_cache(spark):
    key = "a" * 64
    cache = spark.createDataFrame([(key, "v1", "quick", "old"), ("bad", "v1", "quick", "x")], "sha256 string, feature_version string, kind string, payload string")
    fresh = spark.createDataFrame([(key, "v1", "quick", "new")], cache.schema)
    assert records.feature_cache_misses(spark.createDataFrame([(key,), ("b" * 64,)], "sha256 string"), cache, "v1").collect()[0][0] == "b" * 64
    merged = records.upsert_cache(cache, fresh)
    assert sorted(r.payload for r in merged.collect()) == ["new", "x"] and records.purge_cache(merged, {"quick": "v1"}).count() == 1


def test_reports(spark):
    d = spark.createDataFrame([({"a": 3.0, "b": -1.0}, ["a", "z"])], "f map<string,double>, i array<string>").select(reports.faithfulness(F.col("f"), F.col("i")).alias("r")).first().r
    assert (d.faithfulness, d.sufficiency) == (0.5, 0.75)
    texts = spark.createDataFrame([("Certificate of library",), ("new activity",), ("nothing",)], "t string").select(reports.channel(F.col("t")).alias("c")).collect()
    assert [r.c for r in texts] == ["signing", "component", None]
    runs = reports.step_over_previous(spark.createDataFrame([(1, 8.0), (2, 4.0), (4, 3.9)], "w int, s double"), "w", "s").orderBy("w").collect()
    assert [r.worth_it for r in runs] == [True, True, False] and runs[2].speedup == pytest.approx(8 / 3.9, abs=1e-6)
    s = spark.createDataFrame([("p1",), ("p2",)], "pair_id string")
    v = spark.createDataFrame([("p1", "success", 0.2), ("p2", "success", 0.2)], "pair_id string, status string, score double")
    assert tuple(reports.shortcut_control(s, v, 0.7, 0.5).first()) == (1, 1, 1.0)
