"""Signatures of archives: certificate fingerprints, schemes, certificate chains and key rotation."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks and ids of the signing block and of its rotation attribute.
MAGIC = b"APK Sig Block 42"
SCHEMES = {0x7109871A: "v2", 0xF05368C0: "v3"}
ROTATION = 0x3BA06F8C
# Short names of the parts of a certificate's names.
NAME_PARTS = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.9": "STREET", "2.5.4.10": "O", "2.5.4.11": "OU", "0.9.2342.19200300.100.1.1": "UID", "0.9.2342.19200300.100.1.25": "DC"}
#: Bytes on each side of the mark that stand for a block without META-INF certificates.
AROUND = 4096
SIGNATURES = "app_id string, fingerprint string, scheme string, signers array<string>, rotation_lineage array<string>, chain array<struct<issuer:string,subject:string,sha256:string>>, status string"


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def block_entries(data: bytes) -> dict[int, bytes]:
    """Entries of the signing block before the central directory by id; empty without a sound one."""
    end = data.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(data):
        return {}
    (directory,) = struct.unpack_from("<I", data, end + 16)
    if directory < 24 or data[directory - 16 : directory] != MAGIC:
        return {}
    (size,) = struct.unpack_from("<Q", data, directory - 24)
    at, stop = directory - size, directory - 24
    out: dict[int, bytes] = {}
    while 8 <= at and at + 12 <= stop:
        length, key = struct.unpack_from("<QI", data, at)
        if length < 4 or at + 8 + length > stop:
            break
        out.setdefault(key, data[at + 12 : at + 8 + length])
        at += 8 + length
    return out


def fields(data: bytes) -> list[bytes]:
    """The parts of a sequence, each after its length; what follows a wrong length is left out."""
    out, at = [], 0
    while at + 4 <= len(data):
        (length,) = struct.unpack_from("<I", data, at)
        if at + 4 + length > len(data):
            break
        out.append(data[at + 4 : at + 4 + length])
        at += 4 + length
    return out


def signers_of(entry: bytes) -> tuple[list[str], list[str]]:
    """(fingerprints of the signers, of the rotated keys) of a v3 entry."""
    signers: list[str] = []
    lineage: list[str] = []
    for signer in fields((fields(entry) or [b""])[0]):
        signed = (fields(signer) or [b""])[0]
        parts = fields(signed)[:2]  # digests and certificates; two numbers and the attributes follow
        if len(parts) < 2:
            continue
        signers += [_digest(c) for c in fields(parts[1]) if c]
        rest = signed[8 + len(parts[0]) + len(parts[1]) + 8 :]
        for attribute in fields((fields(rest) or [b""])[0]):
            if len(attribute) >= 4 and struct.unpack_from("<I", attribute)[0] == ROTATION and not lineage:
                levels = [(fields((fields(level) or [b""])[0]) or [b""])[0] for level in fields(attribute[4:])]
                lineage = [_digest(c) for c in levels if c]
    return signers, lineage


def _der(data: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start of the content, end) of the element at a place."""
    tag, size = data[at], data[at + 1]
    start = at + 2
    if size & 0x80:
        count = size & 0x7F
        size, start = int.from_bytes(data[start : start + count], "big"), start + count
    if start + size > len(data):
        raise ValueError("an element reaches beyond the data")
    return tag, start, start + size


def _parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int, int]]:
    """(tag, place, start, end) of the elements between two places."""
    out = []
    while start < end:
        tag, a, b = _der(data, start)
        out.append((tag, start, a, b))
        start = b
    return out


def _oid(raw: bytes) -> str:
    numbers, value = [], 0
    for byte in raw:
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            numbers.append(value)
            value = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def _name(data: bytes, start: int, end: int) -> str:
    """A name as text, the last part first."""
    out = []
    for _, _, a, b in _parts(data, start, end):
        pairs = []
        for _, _, c, d in _parts(data, a, b):
            (_, _, k, l), (_, _, v, w) = _parts(data, c, d)[:2]  # noqa: E741
            text = data[v:w].decode("utf-8", "replace")
            key = _oid(data[k:l])
            pairs.append(f"{NAME_PARTS.get(key, key)}={''.join(chr(92) + x if x in ',+<>;=' + chr(34) + chr(92) else x for x in text)}")
        out.append("+".join(pairs))
    return ",".join(reversed(out))


def certificate_chain(blob: bytes) -> list[dict]:
    """issuer, subject and sha256 of the certificates of a PKCS#7 signature; empty if it cannot be read."""
    try:
        _, a, b = _der(blob, 0)
        content = _parts(blob, a, b)[1]
        _, a, b = _der(blob, content[2])
        held = next(p for p in _parts(blob, a, b) if p[0] == 0xA0)
        out = []
        for _, place, start, end in _parts(blob, held[2], held[3]):
            _, a, b = _der(blob, start)
            inside = [p for p in _parts(blob, a, b) if p[0] != 0xA0]  # serial, algorithm, issuer, dates, subject, ...
            out.append({"issuer": _name(blob, *inside[2][2:]), "subject": _name(blob, *inside[4][2:]), "sha256": _digest(blob[place:end])})
        return out
    except (ValueError, IndexError, StopIteration):
        return []


def signature_of(data: bytes) -> tuple:
    """(fingerprint, scheme, signers, rotation_lineage, chain, status) of an archive.

    The fingerprint is the digest of the first certificate file in META-INF, or
    else of what surrounds the last mark of a signing block.  Of schemes, the
    newest counts; a block with neither id is v2.
    """
    entries = block_entries(data)
    signers, lineage = next((signers_of(v) for k, v in entries.items() if SCHEMES.get(k) == "v3"), ([], []))
    blob = None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted(n for n in z.namelist() if n.startswith("META-INF/") and n.upper().endswith((".RSA", ".DSA", ".EC")))
            blob = z.read(names[0]) if names else None
    except zipfile.BadZipFile:
        return None, None, [], [], [], "bad_archive"
    found = {SCHEMES[k] for k in entries if k in SCHEMES}
    mark = data.rfind(MAGIC)
    if blob is not None:
        fingerprint = _digest(blob)
    else:
        fingerprint = _digest(data[max(0, mark - AROUND) : mark + len(MAGIC) + AROUND]) if mark >= 0 else None
    if "v3" in found:
        scheme = "v3_with_rotation" if lineage else "v3"
    else:
        scheme = "v2" if "v2" in found else "v1" if blob is not None else "v2" if mark >= 0 else None
    return fingerprint, scheme, signers, lineage, certificate_chain(blob) if blob else [], "ok" if fingerprint else "unsigned"


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """A row (SIGNATURES) for each archive below a path; status ok, unsigned or bad_archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(file.rsplit("/", 1)[-1].rsplit(".", 1)[0], *signature_of(raw)) for file, raw in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["app_id", "fingerprint", "scheme", "signers", "rotation_lineage", "chain", "status"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.apk").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, SIGNATURES)


def signing_tokens(fingerprint: Column, scheme: Column, lineage: Column) -> Column:
    """Sorted tokens of a signature: present, scheme, first eight digits, and those of rotated keys."""
    hexed = lambda x: F.when(x.rlike("^[0-9a-fA-F]{8}"), F.lower(F.substring(x, 1, 8)))
    rotated = F.transform(F.coalesce(lineage, F.array().cast("array<string>")), lambda x: F.concat(F.lit("signing_lineage_fp:"), hexed(x)))
    some = F.concat(F.array(F.lit("signing_present:1"), F.concat(F.lit("signing_scheme:"), scheme), F.concat(F.lit("signing_prefix:"), hexed(fingerprint))), rotated)
    return F.when(F.coalesce(fingerprint, F.lit("")) == "", F.array(F.lit("signing_present:0"))).otherwise(F.array_sort(F.array_distinct(F.array_compact(some))))


def version_token(header: Column) -> Column:
    """dex_version:NNN of the first eight bytes (hexadecimal) of a code file, null for others."""
    digits = F.concat(*(F.substring(header, 10 + 2 * i, 1) for i in range(3)))
    return F.when(F.lower(header).rlike("^6465780a(3[0-9]){3}00"), F.concat(F.lit("dex_version:"), digits))
