"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton.

Texts are folded first (compatibility forms, marks on letters, homoglyphs,
digits and signs that stand for letters inside a word).  Entries are whole words and word beginnings
that labelled documents show to be much more frequent in toxic texts; each has
the log-odds as weight.  Exception phrases are pairs of words with a hit that
clean documents have and toxic ones do not; hits inside them do not count.  A
document's hits are summed, and the sum, plain and by length, goes through a
logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out_remainder

#: Labelled documents of each label from which the lexicon is learned, at most.
SAMPLE = 6_000
#: Entries that are considered, at most.
CANDIDATES = 100_000
#: Documents of the toxic sample in which an entry occurs, at least.
SUPPORT = 3
#: Entries that may come in by chance alone, on average, and log-odds of an entry, at least.
BY_CHANCE, ODDS = 0.1, 1.5
#: A beginning has so many times the documents of a longer entry; a longer entry so much more weight than its beginning.
WIDER, CLEARER = 1.3, 0.7
#: Lengths of the word beginnings that are considered.
STEMS = range(3, 9)
#: Clean documents that have an exception phrase, at least, and exception phrases, at most.
SPARED, PHRASES = 3, 10_000

# Letters that look like Latin ones.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһӏνοαεικρτυ", "aeopcyxijsdhlvoaeikptu")
# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LEET_DIGITS = re.compile(r"[013457]+")
_LEET_SIGN = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = re.compile("[\u0300-\u036f]+")
_FROM_DIGITS = str.maketrans({k: v for k, v in LEET.items() if k.isdigit()})
_OTHER = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The words of a text in folded form, each between single spaces."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _MARKS.sub("", unicodedata.normalize("NFKD", text))).translate(HOMOGLYPHS)
    text = _LEET_SIGN.sub(lambda m: LEET[m[0]], text)

    def letters(m: re.Match) -> str:  # a run of such digits stands for letters if a letter is beside it
        a, b = m.span()
        beside = a > 0 and _LETTER.match(text, a - 1) or b < len(text) and _LETTER.match(text, b)
        return m[0].translate(_FROM_DIGITS) if beside else m[0]

    text = _LEET_DIGITS.sub(letters, text)
    return f" {_OTHER.sub(' ', text).strip()} "


def _entries(folded: str) -> set[str]:
    """Whole words as ' word ', beginnings as ' stem'."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        for n in STEMS:
            if len(word) >= n:
                out.add(f" {word[:n]}")
    return out


def _counter(only: frozenset[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[str] = Counter()
            for text in pdf["text"]:
                found = _entries(fold(text))
                seen.update(found if only is None else found & only)
            yield pd.DataFrame({"entry": list(seen), "docs": list(seen.values())})

    return run


def _ratio(t: int, c: int, toxic: int, clean: int) -> float:
    """Twice the log-likelihood ratio of an entry in t of `toxic` and c of `clean` documents."""
    cells = [(t, toxic), (toxic - t, toxic), (c, clean), (clean - c, clean)]
    have = (t + c) / (toxic + clean)
    return 2 * sum(n * math.log(n / (of * p)) for (n, of), p in zip(cells, (have, 1 - have) * 2, strict=True) if n and of * p)


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entry to weight.

    A beginning comes in if it stands in clearly more toxic documents than any
    longer entry under it, which then need a clearly greater weight to stay.
    """
    # Many entries are tried, so each must show more than chance: twice a log-likelihood ratio exceeds x with probability near exp(-x / 2).
    evidence = 2 * math.log(max(len(toxic), 1) / BY_CHANCE)
    weights: dict[str, float] = {}
    for entry, t in toxic.items():
        c = clean.get(entry, 0)
        weight = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if t >= SUPPORT and weight >= ODDS and _ratio(t, c, n_toxic, n_clean) >= evidence:
            weights[entry] = weight
    stems = lambda e: [e[: n + 1] for n in STEMS if n + 1 < len(e)]
    under: dict[str, int] = {}
    for entry in weights:
        for stem in stems(entry):
            under[stem] = max(under.get(stem, 0), toxic[entry])
    weights = {e: w for e, w in weights.items() if toxic[e] > WIDER * under.get(e, 0)}
    return {e: w for e, w in sorted(weights.items()) if w > max((weights[s] + CLEARER for s in stems(e) if s in weights), default=0.0)}


@dataclass
class Lexicon:
    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = ()

    def matcher(self):
        """A function from text to (weights of hits, summed up, and words)."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            automaton.add_word(entry, (len(entry), (weight, entry)))
        for phrase in self.exceptions:
            automaton.add_word(fold(phrase), (len(fold(phrase)), None))
        automaton.make_automaton()

        def match(text: str | None) -> tuple[float, int]:
            folded = fold(text)
            hits: dict[int, tuple[float, str]] = {}
            spared: list[tuple[int, int]] = []
            for end, (n, weight) in automaton.iter(folded):
                start = end - n + 1
                if weight is None:
                    spared.append((start, end))
                else:
                    hits[start] = max(weight, hits.get(start, (0.0, "")))
            if spared:
                begins = sorted(a for a, _ in spared)
                last, reach = {}, -1
                for a, b in sorted(spared):
                    last[a] = reach = max(reach, b)
                hits = {at: hit for at, hit in hits.items() if not (k := bisect_right(begins, at)) or at >= last[begins[k - 1]]}
            times = Counter(hits.values())
            total = sum(w * (1 + math.log(n)) for (w, _), n in sorted(times.items()))  # the same entry again tells less
            return total, folded.count(" ") - 1

        return match if len(automaton) else lambda text: (0.0, 0)

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        x = a + b * np.log1p(total) + c * np.log1p(100 * total / (words + 50))
        return np.where(total > 0, 1 / (1 + np.exp(-np.clip(x, -30, 30))), 1 / (1 + math.exp(-min(max(a, -30), 30))))


def _phrase_counter(lexicon: Lexicon):
    """Counts documents, by label, for each pair of neighbouring words of which one is a hit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stems = {e for e in lexicon.weights if not e.endswith(" ")}
        known: dict[str, bool] = {}
        for pdf in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                words, pairs = fold(text).split(), set()
                for w in set(words):
                    if w not in known:
                        known[w] = f" {w} " in lexicon.weights or any(f" {w[:n]}" in stems for n in STEMS)
                for a, b in zip(words, words[1:]):  # noqa: B905
                    if known[a] or known[b]:
                        pairs.add((f"{a} {b}", label))
                seen.update(pairs)
            yield pd.DataFrame([(p, *((n, 0) if label else (0, n))) for (p, label), n in seen.items()], columns=["phrase", "toxic", "clean"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, out: int, most: int, worst=F.max) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents of each label.

    Rows whose remainder is `out` are left out.  Which rows come in is settled
    by a hash of doc_id; a document with several labels has what `worst` makes
    of them, and one with several texts the greatest text.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marks = marks.where(held_out_remainder("doc_id", modulus) != out).groupBy("doc_id").agg(worst("label").alias("label"))
    parts = [marks.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    few = F.broadcast(parts[0].union(parts[1]))  # 2 * most rows of two numbers
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("doc_id", "text", "label")


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, out: int = 0) -> Lexicon:
    """Learns the lexicon from labelled documents; without toxic or clean ones it is empty."""
    sample = durable(training_sample(docs, labels, "toxic", modulus, out, SAMPLE))
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Lexicon({}, (-30.0, 0.0, 0.0))
    schema = "entry string, docs long"
    total = F.sum("docs").alias("docs")
    toxic = sample.where("label = 1").select("text").mapInPandas(_counter(None), schema).groupBy("entry").agg(total).where(F.col("docs") >= SUPPORT)
    toxic = {r[0]: r[1] for r in toxic.orderBy(F.desc("docs"), "entry").limit(CANDIDATES).collect()}
    clean = sample.where("label = 0").select("text").mapInPandas(_counter(frozenset(toxic)), schema).groupBy("entry").agg(total)
    lexicon = Lexicon(choose(toxic, {r[0]: r[1] for r in clean.collect()}, sizes[1], sizes[0]), (0.0, 0.0, 0.0))
    if lexicon.weights:
        phrases = sample.select("text", "label").mapInPandas(_phrase_counter(lexicon), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        lexicon.exceptions = tuple(sorted(r[0] for r in phrases.where((F.col("toxic") == 0) & (F.col("clean") >= SPARED)).orderBy(F.desc("clean"), "phrase").limit(PHRASES).collect()))
    rows = sample.mapInPandas(_sums(lexicon), "doc_id long, total double, words long, label int").select("total", "words", "label").collect()
    total, words, y = (np.array([r[i] for r in rows], float) for i in range(3))
    x = np.column_stack([np.log1p(total), np.log1p(100 * total / (words + 50))])
    lexicon.curve = tuple(float(v) for v in logistic(x, y))
    return lexicon


def _sums(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = lexicon.matcher()
        for pdf in batches:
            got = [match(text) for text in pdf["text"]]
            out = pdf.drop(columns="text")
            out.insert(1, "total", [g[0] for g in got])
            out.insert(2, "words", [g[1] for g in got])
            yield out

    return run


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`docs` with a column `toxicity` from 0 to 1 besides its own columns (one of that name is replaced).

    A null or empty text has no hits and gets the score of the curve at zero;
    an empty lexicon gives 0 or nearly 0 everywhere.  Repeated rows and ties
    are scored alike; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = lexicon.matcher()
        for texts in batches:
            got = np.array([match(t) for t in texts], float).reshape(-1, 2)
            yield pd.Series(lexicon.score(got[:, 0], got[:, 1]))

    return docs.withColumn("toxicity", scored(F.col("text").cast("string")))
