"""Secret scans with DataFrame functions only.

Three plain patterns come first.  Then candidate strings are read with a
sliding window: the counts of its characters change by one character in and one
out at each step, and the Shannon entropy follows from a running sum.  Each
character class has its own threshold.  Candidates on the allow list, or which a
plain pattern has already found, are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "entropy")
#: Pattern of each plain kind, the group that counts, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PLAIN = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
#: Cheap tests that a text must pass before a plain pattern is tried.
GATE = {"assign": ASSIGN, "access": "AKIA", "hex": r"[0-9a-f]{32}"}

#: Characters of a candidate, its least length, and the window.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_=.-]{20})[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+"
WINDOW = 20
#: Classes, the first that fits counts: the pattern of the whole candidate, and bits of entropy in a window from which it counts.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 2.9), "letters": (r"^[A-Za-z]+$", 3.9), "alnum": (r"^[A-Za-z0-9]+$", 3.6), "dotted": (r"\.", 3.85), "base64": (r"", 3.75)}
#: Candidates that match one of these as a whole are no secrets: letters of one case, digits alone, UUIDs,
#: placeholders, the alphabet and the digits in order, and words and short numbers between separators.
ALLOWED = (
    r"^(?:[a-z+/_=.-]+|[A-Z+/_=.-]+|[0-9+/_=.-]+)$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?i:example|sample|dummy|placeholder|changeme|insert|here|your|secret|token|key|api|value|test|x|[+/_=.-]|[0-9]{1,2}(?![0-9]))++$",
    r"^(?i:abcdefghijklmnopqrstuvwxyz|0?123456789|[+/_=.-])++$",
    r"^(?:[+/_=.-]|[A-Za-z][a-z]{2,}+|[A-Z]{2,6}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[a-z]{1,2}(?![A-Za-z0-9])|[0-9]{1,4}(?![0-9]))++$",
)

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _found(text: Column, pattern: str, gate: Column, kind: str, judge) -> Column:
    """Spans of the matches of a pattern for which `judge` gives (from, to) within the match, or null."""
    rank = KINDS.index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def walk(m: Column, gaps: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(gaps, i))
            hit = _let(judge(F.get(m, i)), lambda h: F.when(h.isNotNull(), F.array(F.struct((begin + h["a"]).cast("int").alias("start"), F.lit(rank).alias("rank"), (begin + h["b"]).cast("int").alias("end"), F.lit(kind).alias("kind")))).otherwise(F.array().cast(_SPANS)))
            return F.struct((begin + F.length(F.get(m, i))).alias("at"), F.concat(acc["out"], hit).alias("out"))

        return F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step)["out"]).otherwise(F.array().cast(_SPANS))

    return F.when(gate, _let(matches, lambda m: _let(between, lambda g: walk(m, g)))).otherwise(F.array().cast(_SPANS))


def _whole(length: Column, least: int):
    return lambda m: F.when(length(m) >= least, F.struct(F.lit(0).alias("a"), F.length(m).alias("b")))


def _high_entropy(candidate: Column) -> Column:
    """(a, b) from the first to the last window of the candidate over its class's threshold, or null."""
    bits = F.lit(CLASSES["base64"][1])
    for name in ("dotted", "alnum", "letters", "hex"):
        bits = F.when(candidate.rlike(CLASSES[name][0]), CLASSES[name][1]).otherwise(bits)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    weight = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)))
    start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))

    def scan(codes: Column, least: Column) -> Column:
        def step(acc: Column, event: Column) -> Column:
            i, enters = F.floor(event / 2).cast("int"), event % 2 == 1
            place = F.get(codes, F.when(enters, i).otherwise(i - WINDOW))

            def change(n: Column) -> Column:
                now = n + F.when(enters, 1).otherwise(-1)
                total = acc["sum"] + F.get(weight, now) - F.get(weight, n)
                counts = F.overlay(acc["counts"], F.char(now + 48), place, F.lit(1))
                over = enters & (i >= WINDOW - 1) & (math.log2(WINDOW) - total / WINDOW >= least)
                return F.struct(counts.alias("counts"), total.alias("sum"), F.when(over & (acc["a"] < 0), i - WINDOW + 1).otherwise(acc["a"]).alias("a"), F.when(over, i + 1).otherwise(acc["b"]).alias("b"))

            return F.when(enters | (i >= WINDOW), _let(F.ascii(F.substring(acc["counts"], place, F.lit(1))) - 48, change)).otherwise(acc)

        done = F.aggregate(F.sequence(F.lit(0), F.size(codes) * 2 - 1), start, step)
        return _let(done, lambda d: F.when(d["a"] >= 0, F.struct(d["a"].alias("a"), d["b"].alias("b"))))

    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(~allowed, _let(F.filter(codes, lambda c: c > 0), lambda k: _let(bits, lambda least: scan(k, least))))


def secret_spans(text: Column) -> tuple[Column, Column]:
    """(spans of the plain patterns, spans that the entropy adds), in code points, by start."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = []
    for kind, (pattern, group, least) in PLAIN.items():
        gate = text.contains(GATE[kind]) if kind == "access" else text.rlike(GATE[kind])
        length = (lambda m, p=pattern, g=group: F.length(F.regexp_extract(m, p, g))) if group else F.length
        plain.append(_found(text, pattern, gate, kind, _whole(length, least)))
    base = F.array_sort(F.concat(*plain))
    more = _found(text, CANDIDATE, text.rlike(CANDIDATE), "entropy", _high_entropy)
    return base, more


def scan_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with `base_spans` and `secret_spans`, arrays of (start, rank, end, kind) by start.

    base_spans has the plain patterns' spans; secret_spans has these and those
    that high entropy adds outside them.  A null text is empty; empty texts
    have no spans; other columns and repeated rows stay as they are (columns of
    these two names are replaced); an empty table stays empty.
    """
    base, more = secret_spans(F.col("text"))
    added = fresh_name("added", docs.columns)
    fresh = F.filter(added, lambda m: ~F.exists("base_spans", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    out = docs.withColumn("base_spans", base).withColumn(added, more)
    return out.withColumn("secret_spans", F.when(F.size(added) > 0, F.array_sort(F.concat("base_spans", fresh))).otherwise(F.col("base_spans"))).drop(added)


def spans_text(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret in `text` replaced by `mark`; overlapping spans become one.

    Null texts stay null and empty ones empty; all other columns, those named
    base_spans and secret_spans too, and repeated rows stay as they are; an
    empty table stays empty.
    """
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = _let(F.aggregate("secret_spans", start, step), lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    kept = {c: fresh_name(f"its_{c}", docs.columns) for c in docs.columns if c.lower() in ("base_spans", "secret_spans")}
    found = scan_secrets(docs.withColumnsRenamed(kept)).withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(text))
    return found.select(*(F.col(kept.get(c, c)).alias(c) for c in docs.columns))
