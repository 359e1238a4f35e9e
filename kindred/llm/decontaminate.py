"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units turn into typed placeholders,
letters fold to lower case and punctuation goes.  A window that has names also
counts with its names as plain words, since capitals do not always mark them.
Windows of a template are hashed and hash-joined with the windows of the benchmark items.  A document
leaks an item if enough of the item's windows meet at one alignment and the
slots agree: each value of the item stands for one value of the document, and
each of these for one of the item, which also holds for a question with other
numbers and names.  Windows of mostly
placeholders say nothing as templates: they count by their plain words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as sh
from .common import durable

#: Words of a template window; an item of fewer words is one window.
WIDTH = 8
#: Words of an item, at least, that a document leaks by holding it; of a shorter one it must consist.
TELLING = 4
#: Percent of an item's telling windows, or of all its windows, that a leak has.
COVERAGE = 50
#: Benchmark windows that are sent to all tasks as a first filter (8 bytes each), at most.
FILTER = 1 << 21
#: Alignments are compared in steps of so many words, as a leak may gain or lose a few.
STEP = 16

# Units.
UNITS = "mm cm m km in ft mi g kg lb oz mg l ml s sec min h hr hour hours minutes seconds day days year years % usd eur dollars euros cents mph kmh hz khz mhz ghz kb mb gb tb w kw v a °c °f".split()

_U = np.uint64
_PLAIN, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
#: Ways to read a window: as a template, as a template with names as words, as plain words.
_TEMPLATE, _NAMED, _VERBATIM = 0, 1, 2
_HOLDERS = sh.mix(np.arange(4, dtype=np.uint64), 400)


def _table(yes) -> np.ndarray:
    return np.array([yes(b) for b in range(256)])


_SPACE = _table(lambda b: b == 32 or 9 <= b <= 13)
_DIGIT = _table(lambda b: 48 <= b <= 57)
_UPPER = _table(lambda b: 65 <= b <= 90)
_LETTER = _table(lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128)
_CORE = _DIGIT | _LETTER
_STOP = _table(lambda b: b in b".!?:;|")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _hash_words(buf: np.ndarray, at: np.ndarray, heads: np.ndarray) -> np.ndarray:
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    part = (_LOWER[buf[at]].astype(np.uint64) + _U(1)) * sh._powers(int(lengths.max()))[place]
    return sh.mix(np.add.reduceat(part, heads))


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    raw = raw[_CORE[raw]]
    return int(_hash_words(raw, np.arange(len(raw)), np.array([0]))[0]) if len(raw) else 0


_UNIT_HASHES = np.sort(np.array([h for u in UNITS if (h := _word_hash(u))], np.uint64))


class Templates:
    """The template words of some texts: hash, kind and place of each."""

    def __init__(self, texts: list[str | None]):
        self.raw = b"\n".join([b"", *((t or "").encode("utf-8", "surrogatepass") for t in texts), b""])
        buf = np.frombuffer(self.raw, np.uint8)
        ends = np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts]) + 1
        at = np.flatnonzero(_CORE[buf])
        space = np.cumsum(_SPACE[buf])  # words have no white space inside
        if not len(at):
            self.hash = self.named = self.plain = np.zeros(0, np.uint64)
            self.kind = self.start = self.stop = np.zeros(0, np.int64)
            self.bounds = np.zeros(len(texts) + 1, np.int64)
            return
        word = space[at]
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        tails = np.append(heads[1:], len(at)) - 1
        self.plain = plain = _hash_words(buf, at, heads)
        digits = np.add.reduceat(_DIGIT[buf[at]].astype(np.int64), heads)
        number = digits == np.diff(np.append(heads, len(at)))
        first = buf[at[heads]]
        second = buf[at[np.minimum(heads + 1, tails)]]
        # The last sign before the white space that ends the word before.
        gaps = np.flatnonzero(_SPACE[buf])
        gap = gaps[np.maximum(np.searchsorted(gaps, at[heads]) - 1, 0)]
        before = buf[np.maximum(gap - 1, 0)]
        begins = _STOP[before] | _SPACE[before] | (buf[gap] == 10) | (gap == 0)
        name = _UPPER[first] & ~_UPPER[second] & _LETTER[second] & (tails > heads) & ~begins
        unit = np.append(False, number[:-1]) & np.isin(plain, _UNIT_HASHES)
        self.kind = np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], _PLAIN)
        self.hash = np.where(self.kind == _PLAIN, plain, _HOLDERS[self.kind])
        self.named = np.where(self.kind == _NAME, plain, self.hash)  # with names as words
        self.start, self.stop = at[heads], at[tails] + 1
        self.bounds = np.concatenate([[0], np.searchsorted(at[heads], ends - 1)])

    def windows(self, width: int, form: int) -> np.ndarray:
        """Hashes of all windows, 0 for those that are left out; those at the end of a text reach into the next.

        As _NAMED, names are plain words, and windows that have none are left
        out.  Windows of mostly placeholders say nothing, except as _VERBATIM.
        """
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        words = (self.hash, self.named, self.plain)[form]
        odd = [sh.mix(np.array([j + 1], np.uint64), (900 if form == _VERBATIM else 500) + width)[0] | _U(1) for j in range(width)]
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += words[j : n + j] * odd[j]
        total = sh.mix(total)
        if form == _VERBATIM:
            return total
        total[2 * self._inside(self.kind != _PLAIN if form == _TEMPLATE else (self.kind == _NUMBER) | (self.kind == _UNIT), width) > width] = 0
        if form == _NAMED:
            total[self._inside(self.kind == _NAME, width) == 0] = 0
        return total

    def _inside(self, marks: np.ndarray, width: int) -> np.ndarray:
        return np.cumsum(np.append(0, marks))[width:] - np.cumsum(np.append(0, marks))[:-width]

    def verbatim(self, width: int) -> np.ndarray:
        """The windows that can equal a _VERBATIM one of an item: with a number, or with a unit first."""
        n = max(len(self.hash) - width + 1, 0)
        return (self._inside(self.kind == _NUMBER, width) > 0) | (self.kind[:n] == _UNIT) if n else np.zeros(0, bool)

    def slots(self, a: int, width: int, form: int) -> list[str]:
        kept = ((_NUMBER, _UNIT, _NAME), (_NUMBER, _UNIT), (_NUMBER,))[form]
        return [self.raw[self.start[i] : self.stop[i]].decode("utf-8", "replace").lower() for i in range(a, a + width) if self.kind[i] in kept]


_ITEMS = "item_id long, item_windows long, telling_windows long, width int, item_pos int, telling boolean, verbatim boolean, window long, item_slots array<string>"


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
            t = Templates([text])
            width = min(WIDTH, len(t.hash))
            if width:
                got = {form: t.windows(width, form) for form in (_TEMPLATE, _NAMED, _VERBATIM)}
                telling = (got[_TEMPLATE] != 0) | (got[_NAMED] != 0)
                # A word that begins the item may become a unit after a number of the document.
                got[_VERBATIM][telling & ((np.arange(len(telling)) > 0) | ~np.isin(t.plain[: len(telling)], _UNIT_HASHES))] = 0
                for form, hashes in got.items():
                    rows += [(item, len(telling), int(telling.sum()), width, i, bool(telling[i]), form == _VERBATIM, int(h.view(np.int64)), t.slots(i, width, form)) for i, h in enumerate(hashes) if h]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ITEMS.split(", ")])


def _doc_windows(widths: list[tuple[int, int]], known: np.ndarray | None):
    """The windows of documents in the given widths and forms; with `known`, only those that an item has."""
    bits = 22
    if known is not None:
        sieve = np.zeros(1 << bits, bool)
        sieve[known >> _U(64 - bits)] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = list(pdf["doc_id"]), list(pdf["text"])
            for start, raw in sh.chunks(texts):
                t = Templates(texts[start : start + len(raw)])
                rows = []
                for width, form in widths:
                    got = t.windows(width, form)
                    owner = np.searchsorted(t.bounds, np.arange(len(got)), side="right") - 1
                    ok = (got != 0) & (np.arange(len(got)) + width <= t.bounds[owner + 1])
                    if width < TELLING:
                        ok &= np.diff(t.bounds)[owner] == width
                    if form == _VERBATIM:
                        ok &= t.verbatim(width)
                    if known is not None:
                        ok &= sieve[got >> _U(64 - bits)]
                        ok[ok] = np.isin(got[ok], known)
                    rows += [(ids[start + owner[i]], width, int(i - t.bounds[owner[i]]), int(got[i].view(np.int64)), t.slots(int(i), width, form)) for i in np.flatnonzero(ok)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "width", "pos", "window", "slots"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage) for each leak.

    `coverage` is the share of the item's telling template windows that the
    document has at one alignment (give or take some words) with slots that
    agree; or, where it is greater, the share of all its windows, of which the
    others (mostly placeholders) must have the same words and numbers.  So an
    item of placeholders only is found by its verbatim copies.  An item of
    fewer than TELLING words is leaked by documents that are nothing else.  A
    place of the item that meets the document twice counts once.  Null or empty
    texts and rows with a null id leak nothing; repeated rows count once; an
    empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    items = durable(items.mapInPandas(_item_windows, _ITEMS).distinct())
    forms = lambda verbatim: (_VERBATIM,) if verbatim else (_TEMPLATE, _NAMED)
    widths = [(width, form) for width, verbatim in items.select("width", "verbatim").distinct().collect() for form in forms(verbatim)]
    known = None
    if items.count() <= FILTER:
        known = np.sort(np.array([r[0] for r in items.select("window").distinct().collect()], np.int64).view(np.uint64))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = docs.mapInPandas(_doc_windows(widths, known), "doc_id long, width int, pos int, window long, slots array<string>")
    hits = found.join(items, ["window", "width"]).withColumn("place", F.floor((F.col("pos") - F.col("item_pos")) / STEP))
    whole = ["doc_id", "item_id", "item_windows", "telling_windows"]
    # Equal slots first, so that a verbatim copy agrees with itself.
    hits = hits.where(F.size("slots") == F.size("item_slots")).groupBy(*whole, "place", "item_pos").agg(F.max("telling").alias("telling"), F.min(F.struct(F.col("slots") != F.col("item_slots"), "pos", "slots", "item_slots")).alias("x"))
    hits = durable(hits.select(*whole, "place", "item_pos", "telling", "x.slots", "x.item_slots"))  # or texts would be read again below
    # Each value of the item stands for the value that it most often meets, and the other way round.
    at = ["doc_id", "item_id", "place"]
    met = hits.select(*at, F.explode(F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours"))).alias("z")).select(*at, "z.theirs", "z.ours").groupBy(*at, "theirs", "ours").count()
    best = lambda a, b: Window.partitionBy(*at, a).orderBy(F.desc("count"), F.col("theirs") != F.col("ours"), b)
    odd = met.withColumn("r", F.row_number().over(best("theirs", "ours"))).withColumn("q", F.row_number().over(best("ours", "theirs"))).where("r > 1 or q > 1").select(*at, F.concat_ws("\x1f", "theirs", "ours").alias("bad"))
    odd = odd.groupBy(*at).agg(F.collect_set("bad").alias("bad"))
    said = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.concat_ws("\x1f", z["item_slots"], z["slots"]))
    sound = hits.join(odd, at, "left").where(F.col("bad").isNull() | ~F.arrays_overlap("bad", said))
    # Two neighbouring places are looked at together.
    sound = sound.select(*whole, "telling", "item_pos", F.explode(F.array(F.col("place"), F.col("place") - 1)).alias("place"))
    by_place = sound.groupBy(*whole, "place").agg(F.count_distinct(F.when(F.col("telling"), F.col("item_pos"))).alias("told"), F.count_distinct("item_pos").alias("n"))
    out = by_place.groupBy(*whole).agg(F.max("told").alias("told"), F.max("n").alias("n"))
    share = lambda n, of: F.struct(F.try_divide(n, of).alias("coverage"), F.col(n).alias("windows"), F.col(of).alias("item_windows"))
    out = out.select("doc_id", "item_id", F.greatest(share("told", "telling_windows"), share("n", "item_windows")).alias("x"))
    return out.where(F.col("x.windows") * 100 >= F.col("x.item_windows") * coverage).select("doc_id", "item_id", "x.windows", "x.item_windows", "x.coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """`docs`, with all their columns, without the documents that leak an item.

    Rows with a null doc_id and null or empty texts stay; of rows with one
    doc_id all go if one leaks; an empty table on either side changes nothing.
    """
    return docs.join(leaks(docs, benchmark, coverage).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
