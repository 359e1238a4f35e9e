"""The pipeline over planted documents, stage by stage against plain versions."""

import re

import numpy as np
import pytest

import corpus_pipeline
from kindred.llm import mixing

ITEM = "what is the weight of the red barrel if the blue barrel that stands beside it weighs twice as much as the small green one"


def plain_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = np.random.default_rng(7)
    words = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(260):
        text = list(rnd.choice(words, int(rnd.integers(20, 60))))
        if i % 6 == 0:
            text[5:7] = ["vermin", "scumbag"]
        docs.append((i, " ".join(text), f"src{i % 4}"))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(300 + k, docs[k * 7 + 1][1].replace("word1 ", "word2 ", 1) if k % 2 else docs[k * 7 + 1][1], "src9") for k in range(10)]
    docs += [(400, f"{docs[1][1]} {ITEM}", "src1"), (401, "only some words of the weight of the red barrel here", "src2"), (402, f"a key token = 'abcdefgh1234' in {docs[2][1]}", "src3"), (403, None, None), (404, "", "src1")]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*d, "en", len(d[1] or "")) for d in docs], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs


def test_stages(spark, folder):
    where, planted = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    want = {d: t for d, t, _ in planted if 'scumbag' not in (t or '')}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, where).checkpoint()
        if name == "ngram_jaccard_join":
            sets = {d: plain_sets(t) for d, t in want.items()}
            keep = dict(want)
            for d in sorted(want):
                for e in sorted(keep):
                    both = len(sets[d] & sets[e])
                    if e < d and both and 100 * both >= 75 * len(sets[d] | sets[e]):
                        keep.pop(d, None)
            want = keep
        elif name == "benchmark_decontamination":
            want = {d: t for d, t in want.items() if ITEM not in (t or "")}
        elif name == "secret_scans":
            want = {d: t and re.sub(r"token = '[a-z0-9]{8,}", "[SECRET]", t) for d, t in want.items()}
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got == want, name
        assert docs.columns == ["doc_id", "text", "source", "lang", "n_chars"]
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, where)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.copies}
    assert {r.doc_id: r.taken for r in mixed.collect()} == taken
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, where).collect()} == set(taken.items())
