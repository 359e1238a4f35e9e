"""Scans of hand-made binaries and manifests, and the sinks."""

import hashlib
import io
import json
import struct
import zipfile

from kindred.operators import views
from kindred.sources import dex as dex_files
from kindred.sources import scans, signing, sinks

MANIFEST = """<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.me">
<uses-sdk android:minSdkVersion="21" android:targetSdkVersion="x"/><uses-permission android:name="android.permission.INTERNET"/>
<application><activity android:name=".Main" android:exported="true"><intent-filter android:priority="3"><action android:name="VIEW"/><data android:scheme="https" android:host="h"/></intent-filter></activity>
<service android:name="com.other.S"/></application></manifest>"""


def dex(names):
    strings = sorted(names)
    head, ids = 0x70, 0x70 + 0
    types_at = head + 4 * len(strings)
    classes_at = types_at + 4 * len(strings)
    data_at = classes_at + 32 * len(strings)
    body, offsets = b"", []
    for s in strings:
        offsets.append(data_at + len(body))
        body += bytes([len(s)]) + s.encode() + b"\0"
    raw = bytearray(head)
    raw[:8] = b"dex\n035\0"
    struct.pack_into("<II", raw, 0x38, len(strings), ids)
    struct.pack_into("<II", raw, 0x40, len(strings), types_at)
    struct.pack_into("<II", raw, 0x60, len(strings), classes_at)
    return bytes(raw) + b"".join(struct.pack("<I", o) for o in offsets) + b"".join(struct.pack("<I", i) for i in range(len(strings))) + b"".join(struct.pack("<8I", i, *[0] * 7) for i in range(len(strings))) + body


def elf():
    table = b"\0libx.so\0libc.so\0malloc\0mine\0"
    at = {n: table.index(n.encode()) for n in ("libx.so", "libc.so", "malloc", "mine")}
    dynamic = b"".join(struct.pack("<QQ", t, v) for t, v in ((14, at["libx.so"]), (1, at["libc.so"]), (0, 0)))
    symbol = lambda name, home: struct.pack("<IBBHQQ", name, 0, 0, home, 0, 0)
    symbols = symbol(0, 0) + symbol(at["malloc"], 0) + symbol(at["mine"], 5)
    places, body = [], b""
    for part in (table, dynamic, symbols):
        places.append((64 + len(body), len(part)))
        body += part
    section = lambda kind, place, link: struct.pack("<IIQQQQIIQQ", 0, kind, 0, 0, place[0], place[1], link, 0, 0, 0)
    sections = section(0, (0, 0), 0) + section(3, places[0], 0) + section(6, places[1], 1) + section(11, places[2], 1)
    head = bytearray(64)
    head[:6] = b"\x7fELF\x02\x01"
    struct.pack_into("<Q", head, 0x28, 64 + len(body))
    struct.pack_into("<HH", head, 0x3A, 64, 4)
    return bytes(head) + body + sections


def test_binaries_inside_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("classes.dex", dex(["Lcom/me/A;", "Lcom/me/B;", "LDefault;", "Lorg/x/C;"]))
        z.writestr("classes2.dex", b"broken")
        z.writestr("lib/arm64-v8a/libx.so", elf())
        z.writestr("lib/arm64-v8a/bad.so", b"no")
    (tmp_path / "app.apk").write_bytes(raw.getvalue())
    (tmp_path / "bad.apk").write_bytes(b"x")
    found = {(r.app_id, r.file, tuple(r.packages or ()), r.status) for r in scans.read_packages(spark, str(tmp_path)).collect()}
    assert found == {("app", "classes.dex", ("com.me", "org.x"), "ok"), ("app", "classes2.dex", (), "unreadable"), ("bad", None, (), "bad_archive")}
    every = scans.read_native_libraries(spark, str(tmp_path)).collect()
    assert {(x.app_id, x.file, x.status) for x in every} == {("app", "libx.so", "ok"), ("app", "bad.so", "unreadable"), ("bad", None, "bad_archive")}
    r = [x for x in every if x.status == "ok"]
    assert len(r) == 1 and (r[0].abi, r[0].soname, r[0].needed, r[0].imports, r[0].exports) == ("arm64-v8a", "libx.so", ["libc.so"], ["malloc"], ["mine"])
    assert scans.uleb128(bytes([0xE5, 0x8E, 0x26]), 0) == (624485, 3)


def code_file():
    """A code file with class A: run() calls java.util.List.size, its own run and android.os.Bundle.get, with a switch between; stop() is empty."""
    strings = ["A", "LA;", "Landroid/os/Bundle;", "Ljava/util/List;", "V", "get", "run", "size", "stop"]
    types = [strings.index(x) for x in ("LA;", "Landroid/os/Bundle;", "Ljava/util/List;", "V")]
    methods = [(0, "run"), (1, "get"), (2, "size"), (0, "stop")]
    places, at = {}, 0x70
    for name, size in (("strings", 4 * len(strings)), ("types", 4 * len(types)), ("protos", 12), ("methods", 8 * len(methods)), ("classes", 32)):
        places[name], at = at, at + size
    body, offsets = b"", []
    for x in strings:
        offsets.append(at + len(body))
        body += bytes([len(x)]) + x.encode() + b"\0"
    body += b"\0" * (-len(body) % 4)
    invoke = lambda m: [0x1071, m, 0]
    units = [0x0000, *invoke(2), 0x002B, 6, 0, *invoke(0), 0x0100, 1, 0, 0, 0, 0, *invoke(1), 0x000E]
    code = at + len(body)
    body += struct.pack("<4HII", 1, 0, 1, 0, 0, len(units)) + struct.pack(f"<{len(units)}H", *units)
    members = at + len(body)
    uleb = lambda n: bytes([n & 0x7F | 0x80, n >> 7]) if n > 0x7F else bytes([n])
    body += bytes([0, 0, 2, 0]) + bytes([0, 1]) + uleb(code) + bytes([3, 1, 0])
    raw = bytearray(0x70)
    raw[:8] = b"dex\n035\0"
    for name, place, n in (("strings", 0x38, len(strings)), ("types", 0x40, len(types)), ("protos", 0x48, 1), ("methods", 0x58, len(methods)), ("classes", 0x60, 1)):
        struct.pack_into("<II", raw, place, n, places[name])
    tables = b"".join(struct.pack("<I", o) for o in offsets) + b"".join(struct.pack("<I", t) for t in types) + struct.pack("<III", 4, 3, 0)
    tables += b"".join(struct.pack("<HHI", c, 0, strings.index(n)) for c, n in methods) + struct.pack("<8I", 0, 1, 0, 0, 0, 0, members, 0)
    return bytes(raw) + tables + body


def test_methods_of_code_files(spark, tmp_path):
    for app, files in (("one", {"classes.dex": code_file(), "classes2.dex": b"dex\n" + b"\xff" * 200}), ("two", {"classes.dex": code_file()})):
        with zipfile.ZipFile(tmp_path / f"{app}.apk", "w") as z:
            for name, raw in files.items():
                z.writestr(name, raw)
    (tmp_path / "bad.apk").write_bytes(b"x")
    methods = dex_files.read_methods(spark, str(tmp_path))
    got = {(r.app_id, r.file): r for r in methods.collect()}
    r = got["one", "classes.dex"]
    assert (r.method_id, r.opcodes, r.families, r.pos) == ("LA;->run()V", [0x00, 0x71, 0x2B, 0x71, 0x00, 0x71, 0x0E], ["java.util", "android.os"], 0)
    assert got["one", "classes2.dex"].status == "unreadable" and got["bad", None].status == "bad_archive"
    same = views.compare_code(methods, spark.createDataFrame([("one", "two"), ("one", "bad")], "a string, b string"))
    assert {(r.b, r.score, r.status) for r in same.collect()} == {("two", 1.0, "fuzzy_ok"), ("bad", 0.0, "one_empty")}
    chain = views.markov_chain(views.framework_calls(methods), "app_id", "pos", "family", ["method"]).collect()
    assert {(r.app_id, r.from_state, r.to_state, r.prob) for r in chain} == {(a, "java.util", "android.os", 1.0) for a in ("one", "two")}


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def certificate(subject):
    name = lambda cn: der(0x30, der(0x31, der(0x30, der(6, b"\x55\x04\x06"), der(0x13, b"DE"))), der(0x31, der(0x30, der(6, b"\x55\x04\x03"), der(0x0C, cn.encode()))))
    return der(0x30, der(0x30, der(0xA0, der(2, b"\x02")), der(2, b"\x01"), der(0x30), name("Root, Inc"), der(0x30), name(subject), der(0x30)), der(0x30), der(3, b"\0"))


def prefixed(*parts):
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def signed(raw, entries):
    """An archive with a signing block before its central directory."""
    (directory,) = struct.unpack_from("<I", raw, raw.rfind(b"PK\x05\x06") + 16)
    pairs = b"".join(struct.pack("<QI", 4 + len(v), k) + v for k, v in entries.items())
    size = struct.pack("<Q", len(pairs) + 24)
    block = size + pairs + size + signing.MAGIC
    out = bytearray(raw[:directory] + block + raw[directory:])
    struct.pack_into("<I", out, out.rfind(b"PK\x05\x06") + 16, directory + len(block))
    return bytes(out)


def test_signatures_of_archives(spark, tmp_path):
    def archive(names):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, data in names.items():
                z.writestr(name, data)
        return raw.getvalue()

    cert = certificate("Me")
    pkcs = der(0x30, der(6, b"\x2a"), der(0xA0, der(0x30, der(2, b"\x01"), der(0x31), der(0x30), der(0xA0, cert), der(0x31))))
    level = prefixed(prefixed(cert) + struct.pack("<I", 1)) + struct.pack("<II", 0, 0) + prefixed(b"")
    attributes = prefixed(struct.pack("<I", signing.ROTATION) + prefixed(level, level))
    data = lambda extra: prefixed(b"", prefixed(cert)) + struct.pack("<II", 24, 30) + prefixed(extra)
    v3 = lambda extra: prefixed(prefixed(prefixed(data(extra)) + struct.pack("<II", 24, 30)))
    apps = {
        "plain": archive({"a": b"1", "META-INF/CERT.RSA": pkcs, "META-INF/Z.DSA": b"later"}), "none": archive({"a": b"1"}), "two": signed(archive({"a": b"1"}), {0x7109871A: b"x"}),
        "three": signed(archive({"a": b"1"}), {0xF05368C0: v3(b"")}), "rotated": signed(archive({"a": b"1"}), {0x7109871A: b"x", 0xF05368C0: v3(attributes)}), "bad": b"no archive",
    }
    for app, raw in apps.items():
        (tmp_path / f"{app}.apk").write_bytes(raw)
    rows = signing.read_signatures(spark, str(tmp_path))
    got = {r.app_id: r for r in rows.collect()}
    assert {k: (r.scheme, r.status) for k, r in got.items()} == {"plain": ("v1", "ok"), "none": (None, "unsigned"), "two": ("v2", "ok"), "three": ("v3", "ok"), "rotated": ("v3_with_rotation", "ok"), "bad": (None, "bad_archive")}
    assert got["plain"].fingerprint == hashlib.sha256(pkcs).hexdigest() and [tuple(c) for c in got["plain"].chain] == [("CN=Root\\, Inc,C=DE", "CN=Me,C=DE", hashlib.sha256(cert).hexdigest())]
    assert got["rotated"].signers == [hashlib.sha256(cert).hexdigest()] and got["rotated"].rotation_lineage == [hashlib.sha256(cert).hexdigest()] * 2
    tokens = rows.select("app_id", signing.signing_tokens(rows.fingerprint, rows.scheme, rows.rotation_lineage).alias("t"))
    assert {r.app_id: [x.split(":")[0] for x in r.t] for r in tokens.collect()}["rotated"] == ["signing_lineage_fp", "signing_prefix", "signing_present", "signing_scheme"]
    header = spark.createDataFrame([(b"dex\n039\0".hex(),), (b"dex\n03x\0".hex(),)], "h string")
    assert [r[0] for r in header.select(signing.version_token(header.h)).collect()] == ["dex_version:039", None]


def test_resource_subsets_of_decoded_apps(spark, tmp_path):
    for name, text in {"res/values-de/strings.xml": '<resources><string name="title">x</string></resources>', "res/drawable-hdpi/icon.png": "x", "res/layout/main.xml": "x", "res/layout/note.txt": "x", "assets/a/b.bin": "x" * 2000}.items():
        file = tmp_path / "app" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    got = {(r.app_id, r.subset, r.token) for r in scans.resource_subsets(spark, str(tmp_path)).collect()}
    assert got == {("app", "string", "string:title"), ("app", "drawable", "drawable:icon"), ("app", "layout", "layout:main"), ("app", "asset", "asset:assets/a/b.bin:<10KB")}


def test_decoded_apps(spark, tmp_path):
    for app, text in (("one", MANIFEST), ("two", "<broken")):
        (tmp_path / app / "res" / "raw").mkdir(parents=True)
        (tmp_path / app / "AndroidManifest.xml").write_text(text)
        (tmp_path / app / "res" / "raw" / "a.txt").write_text("same")
    got = {r.app_id: r for r in scans.read_manifests(spark, str(tmp_path)).collect()}
    one = got["one"]
    assert (one.package, one.min_sdk, one.target_sdk, one.permissions) == ("com.me", 21, None, ["android.permission.INTERNET"]) and got["two"].status == "error"
    assert [(c.kind, c.name, c.exported) for c in one.components] == [("activities", "com.me.Main", True), ("services", "com.other.S", False)]
    assert one.components[0].filters[0].data == ["https/h/"] and one.components[0].filters[0].priority == 3
    files = scans.read_resources(spark, str(tmp_path)).collect()
    assert {(r.app_id, r.path, r.size) for r in files} == {("one", "res/raw/a.txt", 4), ("two", "res/raw/a.txt", 4)} and len({r.digest for r in files}) == 1


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", None, 0.5), ("c", "d", 0.25, 0.9)], "app_a string, app_b string, final_score double, score double")
    stats = sinks.export_scored_csv(pairs, str(tmp_path / "csv")).first()
    assert tuple(stats) == (2, 0.25, 0.5)
    sinks.export_detailed(pairs, str(tmp_path / "json"))
    lines = [json.loads(line) for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert {x["pair_id"] for x in lines} == {"a__b", "c__d"} and all("evidence" in x for x in lines)
    sinks.export_results_csv(pairs, str(tmp_path / "results"))
    assert "0.250000" in "".join(f.read_text() for f in (tmp_path / "results").glob("*.csv"))
    records = spark.createDataFrame([("b", {"code": ["y", "x"]}), ("a", None)], "app_id string, layers map<string,array<string>>")
    sinks.export_signatures(records, str(tmp_path / "sig"), "v1")
    rows = {r.app_id: r for r in spark.read.json(str(tmp_path / "sig")).collect()}
    assert rows["b"].screening_signature == ["code:x", "code:y"] and rows["a"].status == "error"
    e = spark.createDataFrame([("p", [("pairwise", "layer_score", 0.5, "code")]), ("q", [])], "pair_id string, evidence array<struct<source_stage:string,signal_type:string,magnitude:double,ref:string>>")
    text = {r.pair_id: r.markdown for r in sinks.evidence_markdown(e).collect()}
    assert text["p"].endswith("| pairwise | layer_score | code | 0.5000 |") and text["q"] == "no evidence"
