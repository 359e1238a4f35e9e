"""Scans of archives and graph files: one row of tokens for each file, read by Spark's own readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NODE = re.compile(r'^\s*"?([^"\s\[]+)"?\s*\[(?:[^\]]*?)label="((?:[^"\\]|\\.)*)"', re.M)
_EDGE = re.compile(r'^\s*"?([^"\s\[]+)"?\s*->\s*"?([^"\s\[;]+)"?', re.M)


def count_bucket(n: int) -> str:
    """0, 1_3, 4_7, 8_15, 16_31, 32_63, 64_plus."""
    return "0" if n <= 0 else "1_3" if n <= 3 else next((f"{1 << k}_{(2 << k) - 1}" for k in range(2, 6) if n < 2 << k), "64_plus")


def archive_layers(raw: bytes, name: str) -> dict[str, list[str]]:
    """The five token layers of an app archive, from its entry names alone."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
    dex = sorted(n for n in names if re.fullmatch(r"classes\d*\.dex", n))
    suffix = lambda n: n.rsplit(".", 1)[-1].lower() if "." in n.rsplit("/", 1)[-1] else "none"
    res = [n for n in names if n.startswith("res/")]
    layers = {
        "code": {f"dex:{n}" for n in dex} or {"dex:absent"},
        "component": {f"layout:{n.rsplit('/', 1)[-1].rsplit('.', 1)[0]}" for n in res if "/layout" in f"/{n}"},
        "resource": {f"res_type:{n.split('/')[1].split('-')[0]}" for n in res if n.count("/") > 1} | {f"res_ext:{suffix(n)}" for n in res} | {f"asset_ext:{suffix(n)}" for n in names if n.startswith("assets/")},
        "metadata": {f"apk_name:{name}", f"entry_bin:{count_bucket(len(names))}", f"dex_count_bin:{count_bucket(len(dex))}", f"manifest_present:{int('AndroidManifest.xml' in names)}", f"resources_arsc_present:{int('resources.arsc' in names)}"},
        "library": {f"lib_abi:{n.split('/')[1]}" for n in names if n.startswith("lib/") and n.count("/") > 1} | {f"meta_inf_ext:{suffix(n)}" for n in names if n.startswith("META-INF/")},
    }
    return {k: sorted(v) for k, v in layers.items()}


def read_archives(spark: SparkSession, path: str, pattern: str = "*.apk") -> DataFrame:
    """(app_id, layers, status, sha256) of every archive below a path; a bad archive gives a row with status error."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                name = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows.append((name, archive_layers(raw, name), "ok", hashlib.sha256(raw).hexdigest()))
                except (zipfile.BadZipFile, IndexError):
                    rows.append((name, {}, "error", hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["app_id", "layers", "status", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, "app_id string, layers map<string,array<string>>, status string, sha256 string")


def parse_dot(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(nodes with label, edges) of a Graphviz file; defaults and blank nodes are passed over."""
    nodes = [(n, label) for n, label in _NODE.findall(text) if n not in ("node", "edge", "graph", "\\n")]
    return nodes, [(a, b) for a, b in _EDGE.findall(text)]


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, nodes array<struct<id, data>>, edges array<struct<src, dst>>) of Graphviz files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                nodes, edges = parse_dot(text)
                rows.append((file.rsplit("/", 1)[-1], [{"id": a, "data": b} for a, b in nodes], [{"src": a, "dst": b} for a, b in edges]))
            yield pd.DataFrame(rows, columns=["graph_id", "nodes", "edges"])

    files = spark.read.option("pathGlobFilter", "*.dot").option("recursiveFileLookup", True).text(path, wholetext=True).selectExpr("_metadata.file_path file", "value")
    return files.mapInPandas(run, "graph_id string, nodes array<struct<id:string,data:string>>, edges array<struct<src:string,dst:string>>")
