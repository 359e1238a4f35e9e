"""Every operator on texts of a megabyte and more, in time that grows with the length."""

import time

import pytest

from kindred.llm import decontaminate, html_text, licenses, ngram_join, quality_model, quality_rules, toxicity

N = 1 << 20
LONG = {
    "digits": "a" + "0" * N,
    "loose digits": "0" * N,
    "words": "some words of a very long text " * (N // 31),
    "spaces": " " * N,
    "one word": "x" * N,
    "signs": "a!" * (N // 2),
    "phrases": "trash can mit license idiot " * (N // 28),
    "notices": "licensed under the apache license version 2 0 " * (N // 47),
}


def took(run, *args):
    began = time.process_time()
    run(*args)
    return time.process_time() - began


@pytest.mark.parametrize("kind", LONG)
def test_plain_functions(kind):
    text = LONG[kind]
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " trash": 2.0}, (0.0, 1.0, 1.0), ("trash can",))
    scan = licenses.Scanner().scan
    for run in (toxicity.fold, lexicon.matcher(), quality_model.features, html_text.main_text, lambda t: decontaminate.Templates([t]).windows(8, 0)):
        assert took(run, text) < 8
    assert took(scan, text) < 30
    assert took(html_text.main_text, f"<article><p>{text.replace(' ', ' <b>')}") < 20


def test_folding_changes_whole_runs():
    assert toxicity.fold("a001 100a 1001 x2001y ïdiöt") == " aooi iooa 1001 x2ooiy idiot "


def test_spark_functions(spark):
    # A sixteenth of the length: rows of a megabyte took longer than a test should.
    count = (N >> 4) // 31
    words = "some words of a very long text " * count
    rows = [(0, "a" + "0" * (N >> 4), "s"), (1, words, "s"), (2, " " * (N >> 4), "s"), (3, words, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 1}
    judged = quality_rules.quality_rules(docs, quality_rules.DecisionList())
    assert {r.doc_id: r.n_repeat_words for r in judged.collect()}[1] == count * 7
