"""License scans: fuzzy search for short notices.

Each notice may have a number of edits.  By the pigeonhole principle a notice
that is cut into one part more than it may have edits holds one part unchanged;
parts are found exactly, and only around them the `regex` library's
bounded-error matching verifies the notice, counts the edits and gives the span.
Plain phrases of words are found first and keep their labels.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices in folded form (words between single spaces), their labels, and the words that tell them apart.
NOTICES = {
    "released under the mit license": ("mit", "mit"),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", "permission"),
    "licensed under the apache license version 2 0": ("apache", "apache"),
    "this work is licensed under the gnu general public license": ("gpl", "general public"),
    "licensed under the gnu lesser general public license": ("lgpl", "lesser general"),
    "licensed under the gnu affero general public license": ("agpl", "affero"),
    "redistribution and use in source and binary forms with or without modification": ("bsd", "redistribution"),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", "permission to use"),
    "subject to the terms of the mozilla public license": ("mpl", "mozilla"),
    "made available under the terms of the eclipse public license": ("epl", "eclipse"),
    "this software is provided as is without any express or implied warranty": ("zlib", "provided as is"),
    "this is free and unencumbered software released into the public domain": ("unlicense", "unencumbered"),
    "boost software license version 1 0": ("boost", "boost software"),
    "licensed under a creative commons attribution": ("cc", "creative commons"),
    "spdx license identifier": ("spdx", "spdx"),
    "all rights reserved": ("reserved", "rights reserved"),
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Notice:
    text: str
    label: str
    key: str

    def __post_init__(self):
        import regex

        self.edits = max(1, len(self.text) // CHARS_PER_EDIT)
        n, k = len(self.text), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rf"(?e)(?:{regex.escape(self.text, special_only=True, literal_spaces=True)}){{e<={self.edits}}}")
        #: The telling words may have an edit for every fifth character.
        self.masks: dict[str, int] = {}
        for i, char in enumerate(self.text):
            self.masks[char] = self.masks.get(char, 0) | 1 << i
        spare = len(self.key) // 5
        self.telling = regex.compile(rf"(?:{regex.escape(self.key, special_only=True, literal_spaces=True)}){{e<={spare}}}")
        at = [len(self.key) * i // (spare + 1) for i in range(spare + 2)]
        self.key_parts = [self.key[a:b] for a, b in zip(at, at[1:], strict=False)]

    def distance(self, window: str) -> int:
        """The edits between the notice and the part of the window nearest to it (Myers's bit vectors), a cheap test before the regex."""
        size = len(self.text)
        last, whole = 1 << (size - 1), (1 << size) - 1
        up, down, score, least = whole, 0, size, size
        for char in window:
            same = self.masks.get(char, 0)
            diagonal = (((same & up) + up) ^ up) | same | down
            more, less = down | ~(diagonal | up) & whole, up & diagonal
            score += bool(more & last) - bool(less & last)
            least = min(least, score)
            more, less = more << 1 & whole, less << 1 & whole
            up, down = (less | ~(diagonal | more)) & whole, more & diagonal
        return least

    def near(self, flat: str, a: int, b: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the notice in flat[a:b]; one part of the telling words is there unchanged."""
        if a >= b or all(flat.find(part, a, b) < 0 for part in self.key_parts) or self.distance(flat[a:b]) > self.edits:
            return None
        m = self.pattern.search(flat, a, b)
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m and self.telling.search(m[0]) else None


def _automaton(notices: list[Notice]):
    import ahocorasick

    out: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for seed, at in notice.seeds:
            out.setdefault(seed, []).append((i, at))
    machine = ahocorasick.Automaton()
    for seed, owners in out.items():
        machine.add_word(seed, (len(seed), owners))
    machine.make_automaton()
    return machine


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, str]] = NOTICES):
        self.phrases = [(re.compile(rf"(?<= ){re.escape(p)}(?= )"), label) for p, label in phrases.items()]
        self.notices = [Notice(t, label, key) for t, (label, key) in notices.items()]
        self.machine = _automaton(self.notices)

    def scan(self, text: str | None) -> dict:
        words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        flat = f" {' '.join(words)} "
        starts = [1]  # of the words in `flat`
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        places, base = [], set()
        for pattern, label in self.phrases:
            for m in pattern.finditer(flat):
                places.append(bisect_left(starts, m.start()))
                base.add(label)
        matches = self._notices(flat, starts)
        labels = base | {m["label"] for m in matches}
        score = 1.0 if base else max((1 - m["edits"] / len(m["notice"]) for m in matches), default=0.0)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "notices": matches,
        }

    def _notices(self, flat: str, starts: list[int]) -> list[dict]:
        spots: dict[int, set[int]] = {}
        for end, (length, owners) in self.machine.iter(flat):
            for i, at in owners:
                spots.setdefault(i, set()).add(end - length + 1 - at)
        out = []
        for i, begins in sorted(spots.items()):
            notice, done = self.notices[i], 0
            for begin in sorted(begins):
                if begin + notice.edits < done:  # inside the match before
                    continue
                if begin >= done and flat.startswith(notice.text, begin):
                    found = (begin, begin + len(notice.text), 0)
                else:
                    found = notice.near(flat, max(begin - notice.edits, done), min(begin + len(notice.text) + notice.edits, len(flat)))
                if found:
                    done = found[1]
                    start = found[0] + (flat[found[0]] == " ")
                    end = done - (flat[done - 1] == " ")
                    out.append({"label": notice.label, "notice": notice.text, "edits": found[2], "first_word": bisect_right(starts, start) - 1, "last_word": bisect_right(starts, end - 1) - 1})
        return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,notice:string,edits:int,first_word:long,last_word:long>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document: doc_id and the columns of SCHEMA.

    first_word and last_word are the smallest and greatest start of a base
    phrase, in words from 0, null without one; `notices` has each fuzzy match
    with its edits and the words that it spans.  A null or empty text has no
    words and score 0; other columns are not read; repeated rows are repeated
    in the result; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, notices)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            got = [scanner.scan(t) for t in pdf["text"]]
            out = pd.DataFrame({c: pd.Series([g[c] for g in got], dtype=object) for c in names})
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64", "doc_id": "Int64"})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(run, f"doc_id long, {SCHEMA}")
