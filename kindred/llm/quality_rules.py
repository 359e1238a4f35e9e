"""Quality rules: learned decision lists over text statistics, with DataFrame functions only.

Statistics of each text are built-in expressions.  Sequential covering learns
an ordered list of rules from a bounded sample of labelled statistics: a rule
is a conjunction of thresholds, grown one condition at a time for information
gain on one part of the sample and pruned back on the other; documents that it
covers are set aside before the next rule grows.  The list becomes one Spark
conditional expression.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, fresh_name
from .toxicity import training_sample

#: Labelled documents of each label from which rules are learned, at most.
SAMPLE = 2_500
#: Thresholds that are tried for a statistic, conditions of a rule, and rules, at most.
THRESHOLDS, CONDITIONS, RULES = 24, 3, 12
#: Share of low-quality documents among those that a rule covers, at least, and documents covered, at least.
PURE, COVER = 0.95, 4

WINDOW = 5
#: Base rule: fewer words, or more than so many percent of the words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Statistics that rules may use; all are shares or means, so that length alone decides nothing.
STATISTICS = ("mean_word", "symbols", "upper", "digits", "letters", "pipes", "bangs", "dup_lines", "repeated", "distinct", "line_words", "stops")


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _stripped(text: Column, chars: str) -> Column:
    """Number of characters of `chars` in the text."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more.

    Windows are compared by 64-bit hashes of their words' hashes.  Only texts
    with a repeated hash are looked into further: hashes are sorted with their
    places, equal neighbours mark a place, and the marked windows' lengths are
    added up without what overlaps.
    """

    def windows(h: Column) -> Column:
        n = F.size(h) - WINDOW + 1
        return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            twice = F.filter(p, lambda e, j: F.coalesce(F.get(p, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == e["h"], F.lit(False)))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
            return F.aggregate(F.array_sort(F.transform(twice, lambda e: e["i"])), start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(placed, marked))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: _let(windows(h), covered)).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the STATISTICS.

    A null text is empty; a text without words has counts 0 and statistics 0.
    """
    names = docs.columns
    its_text, its_words, its_lines = (fresh_name(x, names) for x in ("its_text", "its_words", "its_lines"))
    text = F.col(its_text)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    out = docs.withColumn(its_text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    in_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"), F.size(F.array_distinct(w)).alias("d"))
    in_lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))
    out = out.withColumns({its_words: _let(words, in_words), its_lines: _let(lines, in_lines)})
    out = out.withColumns({
        "n_words": F.col(f"{its_words}.n"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _stripped(text, "#*$%&|<>").cast("long"),
        "n_dup_lines": F.col(f"{its_lines}.n") - F.col(f"{its_lines}.d"),
        "n_repeat_words": F.col(f"{its_words}.r"),
    })
    chars, count = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    marks = lambda c: _stripped(text, c)
    out = out.withColumns({
        "mean_word": F.col("word_chars") / count,
        "symbols": F.col("n_symbols") / count,
        "upper": marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        "digits": marks("0123456789") / chars,
        "letters": marks("abcdefghijklmnopqrstuvwxyz") / chars,
        "pipes": marks("|") / count,
        "bangs": marks("!?") / count,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col(f"{its_lines}.n"), F.lit(1)),
        "repeated": F.col("n_repeat_words") / count,
        "distinct": F.col(f"{its_words}.d") / count,
        "line_words": F.least(F.col("n_words") / F.greatest(F.col(f"{its_lines}.n"), F.lit(1)), F.lit(1000.0)),
        "stops": marks(".") / count,
    })
    return out.drop(its_text, its_words, its_lines)


@dataclass
class Rule:
    """Documents that meet all conditions (statistic, is it at least, threshold) are of low quality."""

    conditions: list[tuple[str, bool, float]]

    def covers(self, row: dict) -> bool:
        return all((row[s] >= t) == up for s, up, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for s, up, t in self.conditions:
            out = out & ((F.col(s) >= t) if up else (F.col(s) < t))
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """True for documents that no rule rejects: CASE WHEN rule THEN false ... ELSE true."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(False)).otherwise(out)
        return out


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(low: list[dict], good: list[dict], cuts: dict[str, list[float]]) -> Rule:
    rule = Rule([])
    while good and len(rule.conditions) < CONDITIONS:
        best = (0.0, None)
        for s in STATISTICS:
            ours, theirs = sorted(r[s] for r in low), sorted(r[s] for r in good)
            for t in cuts[s]:
                below, under = bisect_left(ours, t), bisect_left(theirs, t)
                for up, p, n in ((True, len(ours) - below, len(theirs) - under), (False, below, under)):
                    best = max(best, (_gain(len(low), len(good), p, n), (s, up, t)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        low, good = ([r for r in rows if rule.covers(r)] for rows in (low, good))
    return rule


def _worth(rule: Rule, low: list[dict], good: list[dict]) -> float:
    p, n = sum(map(rule.covers, low)), sum(map(rule.covers, good))
    return (p - n) / (p + n) if p + n else -1.0


def _margin(rule: Rule, low: list[dict], good: list[dict]) -> Rule:
    """Moves each threshold to the middle between the values that meet it and good documents' values that do not."""
    moved = list(rule.conditions)
    for i, (s, up, t) in enumerate(moved):
        rest = Rule(moved[:i] + moved[i + 1 :])
        inside = [r[s] for r in low if rule.covers(r)]
        outside = [r[s] for r in good if rest.covers(r) and (r[s] >= t) != up]
        if inside and outside:
            t = (min(inside) + max(outside)) / 2 if up else (max(inside) + min(outside)) / 2
        moved[i] = (s, up, t)
    return Rule(moved)


def learn_rules(rows: list[dict]) -> DecisionList:
    """The decision list from labelled statistics (`label` 1 is good); empty without both labels."""
    found = DecisionList()
    rows = sorted(rows, key=lambda r: r["order"])
    low, good = ([r for r in rows if r["label"] == v] for v in (0, 1))
    while len(low) >= COVER and good and len(found.rules) < RULES:
        # Two of three rows grow a rule, the third prunes it.
        grow = [[r for i, r in enumerate(x) if i % 3] for x in (low, good)]
        prune = [[r for i, r in enumerate(x) if not i % 3] for x in (low, good)]
        cuts = {}
        for s in STATISTICS:
            values = sorted({r[s] for x in grow for r in x})
            cuts[s] = sorted({values[len(values) * i // THRESHOLDS] for i in range(1, THRESHOLDS)}) if values else []
            low_values = sorted(r[s] for r in grow[0])
            cuts[s] = sorted({*cuts[s], *(low_values[len(low_values) * i // THRESHOLDS] for i in range(THRESHOLDS))})
        rule = _grow(*grow, cuts)
        while len(rule.conditions) > 1:
            shorter = Rule(rule.conditions[:-1])
            if _worth(shorter, *prune) < _worth(rule, *prune):
                break
            rule = shorter
        if not rule.conditions:
            break
        wide = _margin(rule, low, good)
        for r in (wide, rule):
            p, n = sum(map(r.covers, low)), sum(map(r.covers, good))
            if p >= COVER and p >= PURE * (p + n):
                found.rules.append(r)
                low = [x for x in low if not r.covers(x)]
                break
        else:
            break
    return found


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2) -> DecisionList:
    """Learns from at most SAMPLE labelled documents of each label; remainder `out` of crc32(doc_id) is held out.

    Null and other labels are passed over; a document with several labels has the least.
    """
    # Kept before it is measured: else the test of base_failed, which needs texts only, would move below the join to all documents.
    sample = durable(training_sample(docs, labels, "quality", modulus, out, SAMPLE, F.min))
    rows = with_statistics(sample).withColumn("failed", base_failed()).where("not failed").select("label", F.xxhash64("doc_id").alias("order"), *STATISTICS)
    return learn_rules([r.asDict() for r in rows.collect()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """`docs` with the counts and statistics, base_failed, and kept.

    kept is false if base_failed, else what the first rule that covers the
    document says.  Null and empty texts have no words and so fail the base
    rule; without labels the list is empty and only the base rule rejects.
    Columns of the same names are replaced; repeated rows are judged alike; an
    empty table stays empty.
    """
    out = with_statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.verdict())
