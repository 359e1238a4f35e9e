"""Method bodies of code files: opcodes of every method, and the framework packages that it calls."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kindred.sources.scans import uleb128

# Code units of an instruction by opcode, as (first, last, units); all others have one.
WIDTHS = (
    (0x02, 0x02, 2), (0x03, 0x03, 3), (0x05, 0x05, 2), (0x06, 0x06, 3), (0x08, 0x08, 2), (0x09, 0x09, 3), (0x13, 0x13, 2), (0x14, 0x14, 3), (0x15, 0x16, 2), (0x17, 0x17, 3),
    (0x18, 0x18, 5), (0x19, 0x1A, 2), (0x1B, 0x1B, 3), (0x1C, 0x1C, 2), (0x1F, 0x20, 2), (0x22, 0x23, 2), (0x24, 0x26, 3), (0x29, 0x29, 2), (0x2A, 0x2C, 3), (0x2D, 0x3D, 2),
    (0x44, 0x6D, 2), (0x6E, 0x72, 3), (0x74, 0x78, 3), (0x90, 0xAF, 2), (0xD0, 0xE2, 2), (0xFA, 0xFB, 4), (0xFC, 0xFD, 3), (0xFE, 0xFF, 2),
)
# Packages of the framework whose calls count.
FRAMEWORK = ("android", "java", "javax", "kotlin")
METHODS = "app_id string, file string, pos int, method_id string, opcodes array<int>, families array<string>, status string"

_UNITS = [1] * 256
for _first, _last, _units in WIDTHS:
    _UNITS[_first : _last + 1] = [_units] * (_last - _first + 1)


def instructions(units: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """(place, opcode) of each instruction; the data of switches and arrays count as one."""
    at = 0
    while at < len(units):
        unit = units[at]
        yield at, unit & 0xFF
        size = units[at + 1] if at + 1 < len(units) else 0
        if unit == 0x0100:
            at += 4 + 2 * size
        elif unit == 0x0200:
            at += 2 + 4 * size
        elif unit == 0x0300:
            count = units[at + 2] | units[at + 3] << 16 if at + 3 < len(units) else 0
            at += 4 + (size * count + 1) // 2
        else:
            at += _UNITS[unit & 0xFF]


class CodeFile:
    """The tables of a code file that methods need."""

    def __init__(self, data: bytes):
        if len(data) < 0x70 or data[:4] != b"dex\n":
            raise ValueError("not a DEX file")
        self.data = data
        self.sections = {name: struct.unpack_from("<II", data, at) for name, at in (("strings", 0x38), ("types", 0x40), ("protos", 0x48), ("methods", 0x58), ("classes", 0x60))}

    def _row(self, section: str, i: int, form: str) -> tuple:
        return struct.unpack_from(form, self.data, self.sections[section][1] + i * struct.calcsize(form))

    def string(self, i: int) -> str:
        _, start = uleb128(self.data, self._row("strings", i, "<I")[0])
        return self.data[start : self.data.index(b"\0", start)].decode("utf-8", "replace")

    def type(self, i: int) -> str:
        return self.string(self._row("types", i, "<I")[0])

    def owner(self, method: int) -> str:
        return self.type(self._row("methods", method, "<HHI")[0])

    def method_id(self, method: int) -> str:
        owner, proto, name = self._row("methods", method, "<HHI")
        _, result, at = self._row("protos", proto, "<III")
        count = struct.unpack_from("<I", self.data, at)[0] if at else 0
        taken = "".join(self.type(t) for t in struct.unpack_from(f"<{count}H", self.data, at + 4)) if count else ""
        return f"{self.type(owner)}->{self.string(name)}({taken}){self.type(result)}"

    def classes(self) -> Iterator[tuple[str, int]]:
        """(descriptor, place of its members or 0)."""
        for i in range(self.sections["classes"][0]):
            row = self._row("classes", i, "<8I")
            yield self.type(row[0]), row[6]

    def bodies(self) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(method, code units) of each method that has any."""
        for _, at in self.classes():
            if not at:
                continue
            counts = []
            for _ in range(4):
                n, at = uleb128(self.data, at)
                counts.append(n)
            for _ in range(2 * (counts[0] + counts[1])):
                _, at = uleb128(self.data, at)
            for n in counts[2:]:
                method = 0
                for _ in range(n):
                    step, at = uleb128(self.data, at)
                    _, at = uleb128(self.data, at)
                    code, at = uleb128(self.data, at)
                    method += step
                    if code:
                        (size,) = struct.unpack_from("<I", self.data, code + 12)
                        if size:
                            yield method, struct.unpack_from(f"<{size}H", self.data, code + 16)


def family(descriptor: str) -> str:
    """The first two parts of a class's dotted name."""
    name = descriptor[1:-1].replace("/", ".") if descriptor.startswith("L") and descriptor.endswith(";") else descriptor
    return ".".join(name.split(".")[:2])


def method_rows(files: list[tuple[str, bytes]]) -> Iterator[tuple]:
    """(file, pos, method_id, opcodes, families, status) of the code files of one app.

    families are the framework packages of calls to classes that the app does
    not define, in the order of the code.  A file that cannot be parsed gives
    one row with its status.
    """
    parsed, own = [], set()
    for name, raw in files:
        try:
            code = CodeFile(raw)
            own.update([c for c, _ in code.classes()])
            parsed.append((name, code))
        except (ValueError, IndexError, struct.error):
            yield name, None, None, None, None, "unreadable"
    for name, code in parsed:
        rows: list[tuple] = []
        try:
            for pos, (method, units) in enumerate(code.bodies()):
                steps = list(instructions(units))
                called = [code.owner(units[at + 1]) for at, op in steps if (0x6E <= op <= 0x72 or 0x74 <= op <= 0x78) and at + 1 < len(units)]
                met = [family(c) for c in called if c not in own]
                rows.append((name, pos, code.method_id(method), [op for _, op in steps], [f for f in met if f.startswith(FRAMEWORK)], "ok"))
        except (ValueError, IndexError, struct.error):
            rows = [(name, None, None, None, None, "unreadable")]
        yield from rows


def read_methods(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, file, pos, method_id, opcodes, families, status) of all methods with code in the archives below a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in METHODS.split(", ")]
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                app = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        files = [(n, z.read(n)) for n in sorted(z.namelist()) if re.fullmatch(r"classes.*\.dex", n)]
                    rows = [(app, *r) for r in method_rows(files)]
                except zipfile.BadZipFile:
                    rows = [(app, None, None, None, None, None, "bad_archive")]
                yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.apk").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, METHODS)
