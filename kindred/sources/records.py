"""App records, candidates, pairs, incidents and configurations from files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYERS = ("code", "component", "resource", "metadata", "library")
RECORD = "app_id string, layers map<string,array<string>>, apk_path string"
INCIDENT = "schema_version string, recorded_at string, status string, pair_id string, app_a string, app_b string, duration_ms int, pair_timeout_sec int, stage string, views_used array<string>, feature_cache_hit boolean, decoded_dirs_present boolean, worker_started boolean, queued_timeout boolean, tmp_cleanup_status string, external_tool string, _corrupt_record string"
INCIDENT_STATUS = ("timeout", "budget_exceeded")
CANDIDATE_STATUS = ("preliminary_positive", "preliminary_negative", "shortcut")
WRAPPERS = ("enriched_candidates", "candidate_list", "candidates", "short_list", "shortlist", "items")


def coerce_tokens(value: object) -> list[str]:
    """A layer's value as sorted distinct tokens: null, text, number, list or map (k=v)."""
    if value is None:
        return []
    if isinstance(value, dict):
        out = {f"{k}={v}" for k, v in value.items()}
    elif isinstance(value, (list, tuple, set)):
        out = {x if isinstance(x, str) else json.dumps(x, sort_keys=True, ensure_ascii=False) for x in value if x is not None}
    else:
        out = {value if isinstance(value, str) else json.dumps(value)}
    return sorted(t.strip() for t in out if t.strip())


def _records(text: str) -> Iterator[tuple]:
    data = json.loads(text)
    if isinstance(data, dict):
        data = data["apps"] if isinstance(data.get("apps"), list) else [{"app_id": k, **v} for k, v in data.items() if isinstance(v, dict)]
    for item in data if isinstance(data, list) else []:
        if not isinstance(item, dict):
            continue
        app = next((item[k] for k in ("app_id", "id", "name") if item.get(k)), None)
        if app is None:
            raise ValueError("a record has no app_id")
        found = next((item[k] for k in ("layers", "features") if isinstance(item.get(k), dict)), item)
        yield str(app), {layer: coerce_tokens(found.get(layer)) for layer in LAYERS}, item.get("apk_path")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON files: a list, {"apps": [...]}, or {app_id: {...}}; a record without an id is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for text in pdf["value"] for r in _records(text)], columns=["app_id", "layers", "apk_path"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, RECORD)


def _candidates(text: str) -> Iterator[tuple]:
    data = json.loads(text)
    if isinstance(data, dict):
        key = next((k for k in WRAPPERS if k in data), None)
        if key is None and not {"app_a", "query_app_id"} & set(data):
            raise ValueError("no candidate list found")
        data = data[key] if key else [data]
    for row in [data] if isinstance(data, dict) else data:
        a, b = row.get("query_app_id") or row.get("app_a"), row.get("candidate_app_id") or row.get("app_b")
        a, b = (x.get("app_id") if isinstance(x, dict) else x for x in (a, b))
        score = row.get("retrieval_score", row.get("score"))
        yield a, b, None if score is None else float(score), row.get("retrieval_rank"), row.get("screening_status") or "preliminary_positive"


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows from JSON, in the present or the older form (app_a, app_b), under any known wrapper key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for text in pdf["value"] for r in _candidates(text)]
            yield pd.DataFrame(rows, columns=["query_app_id", "candidate_app_id", "retrieval_score", "retrieval_rank", "screening_status"]).astype({"retrieval_rank": "Int32", "retrieval_score": "float64"})

    return spark.read.text(path, wholetext=True).mapInPandas(run, "query_app_id string, candidate_app_id string, retrieval_score double, retrieval_rank int, screening_status string")


def check_candidates(rows: DataFrame) -> DataFrame:
    """Rows under the contract: trimmed ids that are there and differ, a known status; raises at run time otherwise."""
    a, b = F.trim("query_app_id"), F.trim("candidate_app_id")
    status = F.coalesce("screening_status", F.lit("preliminary_positive"))
    good = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (a != b) & status.isin(*CANDIDATE_STATUS)
    checked = rows.withColumns({"query_app_id": F.when(good, a).otherwise(F.raise_error(F.lit("candidate row breaks the contract")).cast("string")), "candidate_app_id": b, "screening_status": status})
    return checked


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, label): labelled pairs with known spellings of headers and labels."""
    raw = spark.read.option("header", True).csv(path)
    pick = lambda *names: F.coalesce(*(F.col(n) for n in raw.columns if n.strip().lower() in names), F.lit(None).cast("string"))
    label = F.lower(F.trim(pick("label", "is_clone", "class", "ground_truth")))
    known = F.when(label.isin("clone", "1", "true", "yes", "positive"), "clone").when(label.isin("non_clone", "non-clone", "0", "false", "no", "negative"), "non_clone").otherwise(label)
    return raw.select(F.trim(pick("app_a", "apk_1", "first", "a")).alias("a"), F.trim(pick("app_b", "apk_2", "second", "b")).alias("b"), known.alias("label"))


def _migrated(rows: DataFrame) -> DataFrame:
    old = F.coalesce("schema_version", F.lit("timeout-incident-v1")) == "timeout-incident-v1"
    fill = {"feature_cache_hit": False, "decoded_dirs_present": False, "worker_started": True, "queued_timeout": False}
    out = rows.withColumns({c: F.coalesce(F.col(c), F.when(old, v)) for c, v in fill.items()})
    return out.withColumns({"tmp_cleanup_status": F.coalesce("tmp_cleanup_status", F.when(old, "unknown")), "schema_version": F.lit("timeout-incident-v2")})


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident log from JSON lines; older rows get defaults, lines that cannot be parsed keep their text in _corrupt_record."""
    return _migrated(spark.read.schema(INCIDENT).option("mode", "PERMISSIVE").json(path))


def stream_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream of files."""
    return _migrated(spark.readStream.schema(INCIDENT).option("mode", "PERMISSIVE").json(path))


def append_incidents(rows: DataFrame, path: str) -> None:
    """Appends incidents as JSON lines; rows without a known status are an error."""
    if rows.where(~F.coalesce(F.col("status").isin(*INCIDENT_STATUS), F.lit(False))).limit(1).count():
        raise ValueError("unknown incident status")
    rows.drop("_corrupt_record").write.mode("append").json(path)


def parse_config(text: str) -> dict:
    """A configuration tree from JSON or YAML text (tabs are an error)."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    if "\t" in text:
        raise ValueError("tabs are not allowed in YAML")
    import yaml

    return yaml.safe_load(text) or {}


def screening_config(tree: dict) -> dict:
    """Validated screening stage: ordered distinct layers, metric, threshold and candidate index."""
    from kindred.functions.similarity import canonical_metric

    stage = tree.get("stages", {}).get("screening", {})
    layers = list(dict.fromkeys(stage.get("features") or LAYERS))
    if unknown := [x for x in layers if x not in LAYERS]:
        raise ValueError(f"unknown layers: {unknown}")
    metric = canonical_metric(stage.get("metric", "jaccard"))
    index = stage.get("candidate_index")
    if index:
        num_perm, bands = int(index.get("num_perm", 128)), int(index.get("bands", 32))
        if num_perm % bands:
            raise ValueError("bands must divide num_perm")
        if metric != "jaccard":
            raise ValueError("a candidate index needs the metric jaccard")
        index = {"num_perm": num_perm, "bands": bands, "seed": int(index.get("seed", 42))}
    return {"layers": layers, "metric": metric, "threshold": float(stage.get("threshold", 0.7)), "index": index, "reject_triggers": tree.get("noise_gate", {}).get("reject_triggers", []) if tree.get("noise_gate", {}).get("enabled") else []}


def feature_cache_misses(wanted: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """(sha256 ...) rows that the cache does not hold in this version."""
    return wanted.join(cache.where(F.col("feature_version") == version).select("sha256"), "sha256", "left_anti")


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new records in place of those with the same (sha256, feature_version)."""
    key = ["sha256", "feature_version"]
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def purge_cache(cache: DataFrame, manifest: dict[str, str]) -> DataFrame:
    """Records with a well-formed sha256 whose version is the manifest's for their kind."""
    current = F.lit(False)
    for kind, version in manifest.items():
        current = current | ((F.col("kind") == kind) & (F.col("feature_version") == version))
    return cache.where(current & F.col("sha256").rlike("^[0-9a-f]{64}$"))


RECORD_SCHEMA = T.StructType([T.StructField("app_id", T.StringType(), False), T.StructField("layers", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
