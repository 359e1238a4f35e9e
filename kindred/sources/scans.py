"""Scans of decoded apps and of the binaries inside archives: one row for each file, from Spark's binary reader."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.scalars import byte_bucket

_ANDROID = "{http://schemas.android.com/apk/res/android}"
_KINDS = {"activity": "activities", "activity-alias": "activities", "service": "services", "receiver": "receivers", "provider": "providers"}
COMPONENTS = "package string, min_sdk int, target_sdk int, permissions array<string>, features array<string>, components array<struct<kind:string,name:string,exported:boolean,filters:array<struct<actions:array<string>,categories:array<string>,data:array<string>,priority:int>>>>, status string"


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def manifest_components(text: str) -> tuple:
    """Package, SDK numbers, permissions, features and components with intent filters of a manifest."""
    root = ET.fromstring(text)
    get = lambda e, name: e.get(_ANDROID + name)
    names = lambda e, tag: sorted({get(x, "name") for x in e.iter(tag) if get(x, "name")})
    sdk = root.find("uses-sdk")
    package = root.get("package")
    components = []
    for e in root.iter():
        if e.tag in _KINDS and get(e, "name"):
            name = get(e, "name")
            full = f"{package}{name}" if name.startswith(".") and package else name
            filters = [
                {
                    "actions": names(f, "action"), "categories": names(f, "category"),
                    "data": sorted({"/".join(get(d, k) or "" for k in ("scheme", "host", "mimeType")) for d in f.iter("data")}), "priority": _number(get(f, "priority")) or 0,
                }
                for f in e.iter("intent-filter")
            ]
            components.append({"kind": _KINDS[e.tag], "name": full, "exported": {"true": True, "false": False}.get(get(e, "exported") or "", bool(filters)), "filters": filters})
    low, high = (None, None) if sdk is None else (_number(get(sdk, "minSdkVersion")), _number(get(sdk, "targetSdkVersion")))
    return package, low, high, names(root, "uses-permission"), names(root, "uses-feature"), components


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, ...) of every decoded AndroidManifest.xml below a path; app_id is its folder's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                app = file.rsplit("/", 2)[-2]
                try:
                    rows.append((app, *manifest_components(text), "ok"))
                except ET.ParseError:
                    rows.append((app, None, None, None, [], [], [], "error"))
            yield pd.DataFrame(rows, columns=["app_id", "package", "min_sdk", "target_sdk", "permissions", "features", "components", "status"]).astype({"min_sdk": "Int32", "target_sdk": "Int32"})

    files = spark.read.option("pathGlobFilter", "AndroidManifest.xml").option("recursiveFileLookup", True).text(path, wholetext=True).selectExpr("_metadata.file_path file", "value")
    return files.mapInPandas(run, f"app_id string, {COMPONENTS}")


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, path, digest, size) of all files under res/ and assets/ of decoded apps; app_id is the folder above."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.regexp_extract("path", r"/([^/]+)/((?:res|assets)/.+)$", 2)
    rows = files.withColumns({"app_id": F.regexp_extract("path", r"/([^/]+)/(?:res|assets)/.+$", 1), "rel": parts}).where("rel <> ''")
    return rows.select("app_id", F.col("rel").alias("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))


def resource_subsets(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, subset, token) of decoded apps: names of strings, drawables and layouts, and assets with their size buckets."""
    files = read_resources(spark, path).withColumns({"name": F.element_at(F.split("path", "/"), -1), "folder": F.regexp_extract("path", "^res/([a-z]+)(?:-[^/]*)?/[^/]+$", 1)})
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    subset = F.when(F.col("folder").isin("drawable", "mipmap"), "drawable").when((F.col("folder") == "layout") & F.lower("name").endswith(".xml"), "layout").when(F.col("path").startswith("assets/"), "asset")
    named = F.when(subset == "asset", F.concat_ws(":", F.lit("asset"), "path", byte_bucket(F.col("size")))).otherwise(F.concat_ws(":", subset, stem))
    plain = files.select("app_id", subset.alias("subset"), named.alias("token")).where("subset is not null")
    texts = spark.read.option("pathGlobFilter", "strings.xml").option("recursiveFileLookup", True).text(path, wholetext=True).selectExpr("_metadata.file_path file", "value")
    strings = texts.select(F.regexp_extract("file", r"/([^/]+)/res/values[^/]*/strings\.xml$", 1).alias("app_id"), F.explode(F.regexp_extract_all("value", F.lit('<string[^>]*\\sname="([^"]+)"'), F.lit(1))).alias("name"))
    strings = strings.where("app_id <> '' and trim(name) <> ''").select("app_id", F.lit("string").alias("subset"), F.concat(F.lit("string:"), F.trim("name")).alias("token"))
    return plain.union(strings).distinct()


def uleb128(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it) of an unsigned LEB128 number."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def dex_types(data: bytes) -> list[str]:
    """Descriptors of the classes that a DEX file defines."""
    if data[:4] != b"dex\n":
        raise ValueError("not a DEX file")
    strings, types, classes = (struct.unpack_from("<II", data, at) for at in (0x38, 0x40, 0x60))

    def string(i: int) -> str:
        (at,) = struct.unpack_from("<I", data, strings[1] + 4 * i)
        _, start = uleb128(data, at)
        return data[start : data.index(b"\0", start)].decode("utf-8", "replace")

    out = []
    for i in range(classes[0]):
        (kind,) = struct.unpack_from("<I", data, classes[1] + 32 * i)
        (name,) = struct.unpack_from("<I", data, types[1] + 4 * kind)
        out.append(string(name))
    return out


def packages_of(descriptors: list[str]) -> list[str]:
    """Distinct dotted packages of class descriptors, the default package left out."""
    return sorted({d[1:].rsplit("/", 1)[0].replace("/", ".") for d in descriptors if d.startswith("L") and "/" in d})


def top_strings(data: bytes, limit: int = 20) -> list[str]:
    """The most frequent runs of four printable characters or more; of equal counts the first."""
    counts = Counter(m[0] for m in re.finditer(rb"[\x20-\x7e]{4,}", data))
    return [x.decode() for x, _ in sorted(counts.items(), key=lambda kv: -kv[1])[:limit]]


def elf_dynamic(data: bytes) -> dict:
    """soname, needed, imports and exports of a shared library's dynamic section, and the top strings of its rodata."""
    if data[:4] != b"\x7fELF":
        raise ValueError("not an ELF file")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    offset, size, count = struct.unpack_from(order + ("Q" if wide else "I"), data, 0x28 if wide else 0x20)[0], *struct.unpack_from(order + "HH", data, 0x3A if wide else 0x2E)
    sections, labels = [], []
    (names,) = struct.unpack_from(order + "H", data, 0x3E if wide else 0x32)
    for i in range(count):
        at = offset + i * size
        kind = struct.unpack_from(order + "I", data, at + 4)[0]
        place, length, link = (*struct.unpack_from(order + "QQI", data, at + 0x18),) if wide else (*struct.unpack_from(order + "III", data, at + 0x10),)
        sections.append((kind, place, length, link))
        labels.append(struct.unpack_from(order + "I", data, at)[0])
    text = lambda table, i: data[table + i : data.index(b"\0", table + i)].decode("utf-8", "replace")
    out: dict = {"soname": None, "needed": [], "imports": [], "exports": []}
    for kind, place, length, link in sections:
        table = sections[link][1] if link < len(sections) else 0
        if kind == 6:  # the dynamic section
            step = 16 if wide else 8
            for at in range(place, place + length, step):
                tag, value = struct.unpack_from(order + ("QQ" if wide else "II"), data, at)
                if tag == 0:
                    break
                if tag == 1:
                    out["needed"].append(text(table, value))
                elif tag == 14:
                    out["soname"] = text(table, value)
        elif kind == 11:  # the dynamic symbols
            step = 24 if wide else 16
            for at in range(place + step, place + length, step):
                name = struct.unpack_from(order + "I", data, at)[0]
                home = struct.unpack_from(order + "H", data, at + (6 if wide else 14))[0]
                if name:
                    out["exports" if home else "imports"].append(text(table, name))
    out = {k: sorted(set(v)) if isinstance(v, list) else v for k, v in out.items()}
    read_only = next((s for s, label in zip(sections, labels, strict=True) if 0 < names < count and text(sections[names][1], label) == ".rodata"), None)
    return {**out, "strings": top_strings(data[read_only[1] : read_only[1] + read_only[2]]) if read_only else []}


def _inside(spark: SparkSession, path: str, wanted: str, schema: str, columns: list[str], row: Callable[[str, str, bytes], tuple]) -> DataFrame:
    """A row for each archive entry whose name matches, with `status`: ok, unreadable, or bad_archive for a whole archive.

    Of an entry that cannot be parsed the row has app_id and, where there is
    one, its file name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                app = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for name in sorted(n for n in z.namelist() if re.fullmatch(wanted, n)):
                            try:
                                rows.append((*row(app, name, z.read(name)), "ok"))
                            except (ValueError, IndexError, struct.error):
                                known = {"app_id": app, "file": name.rsplit("/", 1)[-1], "abi": name.split("/")[1] if "/" in name else None}
                                rows.append((*(known.get(c) for c in columns), "unreadable"))
                except zipfile.BadZipFile:
                    rows.append((app, *[None] * (len(columns) - 1), "bad_archive"))
            out = pd.DataFrame(rows, columns=[*columns, "status"])
            yield out.astype({"size": "Int64"}) if "size" in columns else out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.apk").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, f"{schema}, status string")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, file, packages, status) of the code files of archives."""
    return _inside(spark, path, r"classes\d*\.dex", "app_id string, file string, packages array<string>", ["app_id", "file", "packages"], lambda app, name, raw: (app, name, packages_of(dex_types(raw))))


def read_native_libraries(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, abi, file, size, sha256, soname, needed, imports, exports, strings, status) of shared libraries in archives."""
    import hashlib

    def row(app: str, name: str, raw: bytes) -> tuple:
        d = elf_dynamic(raw)
        return app, name.split("/")[1], name.rsplit("/", 1)[-1], len(raw), hashlib.sha256(raw).hexdigest(), d["soname"], d["needed"], d["imports"], d["exports"], d["strings"]

    columns = ["app_id", "abi", "file", "size", "sha256", "soname", "needed", "imports", "exports", "strings"]
    return _inside(spark, path, r"lib/[^/]+/[^/]+\.so", "app_id string, abi string, file string, size long, sha256 string, soname string, needed array<string>, imports array<string>, exports array<string>, strings array<string>", columns, row)
