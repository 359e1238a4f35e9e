"""The n-gram join and decontamination against plain versions."""

import random
import re

import numpy as np

from kindred.llm import decontaminate, ngram_join, shingles
from kindred.llm.graph import components
from kindred.llm.ngram_join import ngram_jaccard_join, one_of_each_group


def plain_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [plain_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                label[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(d, best.get(find(i), d))
    return sorted((d, len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_shingle_sets_have_the_sizes_of_plain_ones():
    texts = [None, "", " \t\n", "a", "A b", "a b c d e", "A B c D e a b c d e a b c d e", "x y z", "ß Ä é " * 40]
    assert [len(s) for s in shingles.shingle_sets([(t or "").encode().lower() for t in texts])] == [len(plain_sets(t)) for t in texts]


def test_chunks_do_not_change_results():
    texts = [f"w{i} " * (i % 9) + "tail of text" for i in range(50)]
    one = [s.tolist() for _, raw in shingles.chunks(texts, 1 << 20) for s in shingles.shingle_sets(raw)]
    many = [s.tolist() for _, raw in shingles.chunks(texts, 30) for s in shingles.shingle_sets(raw)]
    assert one == many


def test_join_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=60))
    rows = []
    for base in range(14):
        words = rnd.choices(vocabulary, k=rnd.choice([6, 30, 120]))
        for _ in range(rnd.choice([1, 2, 5])):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                copy = copy[: int(len(copy) * rnd.uniform(0.7, 1))]
            text = " ".join(copy)
            rows.append(text.upper() if base % 3 == 0 else text + (" " + passage if base % 4 == 0 else ""))
    rows += [None, "", "  ", "one", "One", "one two", "one two three four", passage, passage]
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == plain_components(rows)


def test_a_group_is_opened_for_a_member_that_ends_before_another_ones_hits(spark):
    # Words for which x (a part of y, exactly at the threshold) and y are not compared as likely copies, while z,
    # an edited y, lacks shingles of x behind y's prefix but has the last one of x's prefix.
    y = [f"w3019x{i}" for i in range(804)]
    z = [f"z{i}" if i in (151, 315, 429, 545) else w for i, w in enumerate(y)]
    rows = [(i, " ".join(words)) for i, words in enumerate((y[:604], z, y), 1)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == plain_components(rows) == [(1, 600, 1), (2, 800, 1), (3, 800, 1)]


def test_join_of_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    assert ngram_jaccard_join(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 1), (None, "q", 1)], "doc_id long, text string, n_shingles int")
    assert sorted(map(tuple, ngram_jaccard_join(twice).collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None)], key=str)


def near_copies(rnd, groups, vocabulary):
    rows = []
    for _ in range(groups):
        words = rnd.choices(vocabulary, k=rnd.choice([8, 25, 60]))
        for _ in range(rnd.choice([1, 3, 9])):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 1, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy[: int(len(copy) * rnd.uniform(0.75, 1))])))
    return rows


def test_join_is_exact_when_all_shingles_are_hot_and_no_group_is_found_by_hashes(spark, monkeypatch):
    rows = near_copies(random.Random(11), 30, [f"w{i}" for i in range(60)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BUCKET", 4)  # every cell that is met fills a bucket
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect())) == plain_components(rows)
    nothing = lambda pairs, *rest: first.pop()(pairs, *rest)
    first = [ngram_join._promising] * 9 + [lambda pairs, *rest: ngram_join_promising(pairs, *rest).limit(0)]
    ngram_join_promising = ngram_join._promising
    monkeypatch.setattr(ngram_join, "_promising", nothing)  # the stars come to nothing, the matrix finds all
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect())) == plain_components(rows)


def test_bitmaps_never_overstate_a_difference():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        n, m = rnd.integers(1, 400, 2)
        x = rnd.choice(np.arange(1, 1000, dtype=np.uint64), n, replace=False)
        y = rnd.choice(np.arange(1, 1000, dtype=np.uint64), m, replace=False)
        got = ngram_join.least_difference(ngram_join.parity_bits(x), ngram_join.parity_bits(y))
        assert 0 <= got <= len(np.setxor1d(x, y))
        assert ngram_join.least_difference(ngram_join.parity_bits(x), ngram_join.parity_bits(x)) == 0


def test_one_of_each_group_stays(spark):
    a, b = "one two three four five six", "another text of seven words in all"
    rows = [(5, a, "x"), (3, a.upper(), "y"), (3, a.upper(), "z"), (None, a, "n"), (7, b, "x"), (7, "", "e"), (7, "", "e"), (None, "", "e"), (None, None, "e"), (None, "q r", "p"), (None, "q r", "q"), (9, "q", "r"), (7, "some quite different words for the same id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, its_id string")
    got = one_of_each_group(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(3, a.upper()), (7, b), (7, ""), (7, ""), (None, ""), (None, None), (None, "q r"), (9, "q"), (7, rows[-1][1])], key=str)
    assert one_of_each_group(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 10 for i in range(10, 31)}, **{i: 100 for i in range(100, 120)}}


def plain_template(text):
    import re

    out, unit_hashes, last = [], set(decontaminate.UNITS), "."
    newline = True
    for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text):
        raw = m[0]
        core = re.sub(r"[^0-9A-Za-z\x80-\U0010ffff]", "", raw)
        if core:
            gap = text[: m.start()]
            begins = newline or (gap and gap[-1] == "\n") or last in ".!?:;|"
            if core.isdigit():
                out.append("<number>")
            elif out and out[-1] == "<number>" and core.lower() in unit_hashes:
                out.append("<unit>")
            elif len(core) > 1 and core[0].isascii() and core[0].isupper() and not (core[1].isascii() and core[1].isupper()) and core[1].isalpha() and not begins:
                out.append("<name>")
            else:
                out.append(core.lower())
        newline, last = False, raw[-1]
    return out


def test_templates_equal_plain_ones():
    text = "The train to Paris took 45 minutes, 3 km more. Then Anna, with 12.5 apples | Bob left!\nCARS cost 9 usd"
    t = decontaminate.Templates([text])
    want = plain_template(text)
    names = {int(h): n for h, n in zip(decontaminate._HOLDERS, ["", "<number>", "<name>", "<unit>"], strict=True)}
    assert [names.get(int(h), "word") for h in t.hash] == [w if w.startswith("<") else "word" for w in want]


ITEM = "A farmer named Miller has 12 apples and gives 5 of them to his neighbour Jones who pays 3 dollars for each of them"


def test_leaks_copies_and_other_parameters_but_not_inconsistent_ones(spark):
    before, after = "some words that stand before it all", "and others that come after the whole of it"
    docs = [
        (1, f"{before} {ITEM} {after}"),
        (2, f"{before} {ITEM.replace('12', '40').replace('Miller', 'Smith').replace('Jones', 'Baker')} {after}"),
        (3, f"{before} {after} apples and gives them"),
        (4, None), (5, ""), (None, ITEM),
        (6, ITEM.upper().replace(" ", "!! ")),
        (7, " ".join(ITEM.split()[:10])),
        (1, f"{before} {ITEM} {after}"),
    ]
    items = [(1, ITEM), (2, None), (3, ""), (4, "4 5 6 7"), (None, "words that stand before")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (6, 1)}
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 7]


def test_slots_must_agree(spark):
    item = "the sum of 7 and 9 is more than 7 but less than twice 9 since 7 is less than 9 in any case at all"
    bad = "the sum of 1 and 2 is more than 3 but less than twice 4 since 5 is less than 6 in any case at all"
    good = item.replace("7", "70").replace("9", "90")
    docs = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=60)
    assert {r.doc_id for r in found.collect()} == {1}


def test_items_of_mostly_numbers_are_found(spark):
    items = ["Compute 12 + 34 - 56 * 78", "Compute 3 + 5 + 7 + 9 + 11 + 13 + 15 and give the result", "4 5 6 7", "min of 2 sets or more", "1 2 3 4 5 6 7 8 9 10 11 12"]
    before, after = "some words that stand before it", "and others that come after the whole"
    docs = [(i, f"{before} {t} {after}") for i, t in enumerate(items)]
    docs += [
        (10, f"{before} 2020 {items[3]} {after}"),
        (11, f"{before} Compute 30 + 50 + 70 + 90 + 110 + 130 + 150 and give the result {after}"),
        (12, f"{before} Compute 13 + 34 - 56 * 78 {after} 5 6 7 4 {after} 2 3 1"),
        (13, "1 2 3 4 5 6 7 8 10 9 12 11"),
    ]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.windows, r.item_windows) for r in found.collect()}
    assert got == {(0, 0): (1, 1), (1, 1): (5, 5), (2, 2): (1, 1), (3, 3): (1, 1), (4, 2): (1, 1), (4, 4): (5, 5), (10, 3): (1, 1), (11, 1): (1, 1), (13, 2): (1, 1)}


def test_short_items_and_repeated_places(spark):
    words = [f"word{i}" for i in range(32)]
    items = [(1, "photosynthesis"), (2, "at all"), (3, " ".join(words))]
    part = " ".join(words[:15])
    docs = [(1, "plants live by photosynthesis and not at all otherwise"), (2, "At all!"), (3, f"{part} {part}"), (4, f"{part} x {part} y z {part}"), (5, " ".join(words[:25]))]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.windows) for r in found.collect()} == {(2, 2, 1), (5, 3, 18)}


def test_two_values_do_not_become_one(spark):
    item = "from 7 to 9 it takes less time than from 9 to 7 and more than from 7 to 7 in all of these cases"
    docs = spark.createDataFrame([(1, item.replace("7", "5").replace("9", "6")), (2, item.replace("7", "5").replace("9", "5"))], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {1}


def plain_leaks(docs, items):
    """Verbatim leaks of items without numbers or names: half of the 8-word windows at places at most two steps apart."""
    out = set()
    cut = lambda t: [tuple(w[i : i + 8]) for w in [[re.sub("[^0-9a-z]", "", x) for x in t.lower().split()]] for i in range(len(w) - 7)]
    for d, text in docs:
        have = {}
        for i, w in enumerate(cut(text)):
            have.setdefault(w, []).append(i)
        for k, item in items:
            windows = cut(item)
            places = {}
            for i, w in enumerate(windows):
                for at in have.get(w, []):
                    p = (at - i) // decontaminate.STEP
                    places.setdefault(p, set()).add(i)
                    places.setdefault(p - 1, set()).add(i)
            if places and 2 * max(map(len, places.values())) >= len(windows):
                out.add((d, k))
    return out


def test_leaks_equal_plain_ones(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}x" for i in range(300)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([9, 20, 50])))) for k in range(25)]
    docs = []
    for d in range(120):
        words = rnd.choices(vocabulary, k=rnd.choice([0, 5, 60]))
        for _ in range(rnd.choice([0, 1, 2])):
            part = rnd.choice(items)[1].split()
            a, b = sorted((rnd.randrange(len(part)), len(part) - rnd.randrange(len(part))))
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part[a:b] if rnd.random() < 0.7 else part
        docs.append((d, " ".join(words)))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_leaks(docs, items)
    assert want and {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.leaks(docs, full).count() == 0
    assert decontaminate.leaks(full.withColumnRenamed("item_id", "doc_id"), items).count() == 0
