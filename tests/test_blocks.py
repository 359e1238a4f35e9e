"""Pairs inside groups: counts against plain sets, and plans that move no row for each pair."""

import itertools
import random
import re

import __spark_entry__
import duckdb
import pytest

from kindred.operators import blocks
from kindred.plans import bindings


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_group_counts_equal_plain_sets(spark, block):
    rng = random.Random(5)
    sets = {i: {"x": rng.sample([*map(str, range(40)), None], rng.randint(0, 20)), "y": [k for k in range(30) if rng.random() < 0.8]} for i in range(60) if i % 7}
    members = [(i, i % 3 if i % 11 else None, f"m{i}") for i in range(60)] + [(None, 1, "none")]
    got = blocks.group_counts(
        spark.createDataFrame([(i, v["x"], v["y"]) for i, v in sets.items()], "app_id long, x array<string>, y array<long>"),
        spark.createDataFrame(members, "app_id long, grp int, name string").repartition(3), ["x", "y"], block, ("name",),
    ).collect()
    want = {}
    for (a, g, m), (b, h, n) in itertools.combinations([r for r in members if r[0] is not None and r[1] is not None], 2):
        if g == h:
            counts = []
            for layer in "xy":
                s, t = (sets.get(k, {}).get(layer, []) for k in (a, b))
                counts += [len((set(s) & set(t)) - {None}), len(s), len(t)]
            want[a, b] = (*counts, m, n)
    assert len(got) == len(want) and {(r.a, r.b): tuple(r)[2:] for r in got} == want


PAIRED = [
    "allowed_pairs",
    "evidence_summary",
    "layer_ablation",
    "method_comparison",
    "pairwise_decisions",
    "set_difference",
    "view_channels",
    "weight_grid_search",
    "weighted_layer_score",
    "evidence_taxonomy",
    "layer_scores",
    "replay_deltas",
    "resource_subset_scores",
    "shortcut_pairs",
    "weight_vector_ablation",
    "library_reduced",
]


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_of_suppliers_are_not_shuffled(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(b#" not in plan


def _below(plan: str, node: str) -> list[str]:
    """What stands below each such node of a plan."""
    lines, out = plan.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith(node):
            out.append("\n".join(itertools.takewhile(lambda x, at=depth(line): depth(x) > at, lines[i + 1 :])))
    return out


@pytest.mark.parametrize("name", ["idf_weighted_jaccard", "layer_scores", "shortcut_pairs"])
def test_lines_move_without_what_follows_from_their_part(spark, monkeypatch, name):
    monkeypatch.setattr(bindings, "LINES", 10, raising=False)  # as tables of many lines would have it
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    moved = [x for x in _below(plan, "RepartitionByExpression") if "l_suppkey" in x]
    assert moved and not any("p_partkey" in x for x in moved)
    assert all(int(n) > 100 for n in re.findall(r"RepartitionByExpression \[app_id#\d+L\], (\w+)", plan))


@pytest.mark.parametrize("parts", [1 << 21, 1])
def test_weights_count_each_supplier_of_a_part_once(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(bindings, "PARTS", parts)
    rng, flags = random.Random(3), [("A", "F"), ("N", "O"), (None, "F")]
    lines = [(s, rng.choice([1, 2, 3, 4, 5, 6, 99, None]), *rng.choice(flags)) for s in [1, 2, 3, 4, 5, None] for _ in range(4)]
    tables = {
        "lineitem": (lines, "l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string"),
        "part": ([(k, f"b{k % 2}", None if k == 3 else f"t{k % 3}", k % 4) for k in range(1, 7)], "p_partkey long, p_brand string, p_type string, p_size int"),
        "supplier": ([(s, 1) for s in [1, 2, 3, 4, 5, 6, None]], "s_suppkey long, s_nationkey int"),
    }
    sql = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("idf_weighted_jaccard", "layer_scores"):
        got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(sql.execute(__spark_entry__.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("kind", ["long", "int"])
def test_packed_sets_equal_plain_ones(spark, kind):
    rng, top = random.Random(9), 2 ** (63 if kind == "long" else 31) - 1
    pool = [*range(-20, 20), 127, 128, 300, 20_000, top // 3, top, -top, -top - 1, None]
    sets = {i: [rng.sample(pool, rng.randint(0, len(pool))) for _ in range(2)] for i in range(70)}
    have = spark.createDataFrame([(i, *v) for i, v in sets.items()], f"app_id long, x array<{kind}>, y array<{kind}>")
    members = spark.createDataFrame([(i, i % 2) for i in range(75)], "app_id long, grp int")
    tiles = blocks._tiles(have, members, ["x", "y"], 3, (), blocks._whole(have, ["x", "y"]))
    assert tiles.groupBy("app_id").count().agg({"count": "max"}).first()[0] == blocks.SPREAD  # 13 blocks of 3 otherwise
    got = blocks.group_counts(have, members, ["x", "y"], 3).collect()
    want = {}
    for a, b in itertools.combinations(range(75), 2):
        if a % 2 == b % 2:
            both = [(s, t) for s, t in zip(sets.get(a, [[], []]), sets.get(b, [[], []]), strict=True)]
            want[a, b] = tuple(n for s, t in both for n in (len((set(s) & set(t)) - {None}), len(s), len(t)))
    assert len(got) == len(want) and {(r.a, r.b): tuple(r)[2:] for r in got} == want


@pytest.mark.parametrize("name", ["layer_scores", "shortcut_pairs"])
def test_sets_of_pairs_move_packed(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    [moved] = [x for x in _below(plan, "Exchange hashpartitioning(grp#") if "p#" in x and "MapInArrow" in x]
    assert moved
    sets, layers = bindings.supplier_sets(spark, "/root/testdata/sf0.01"), list(bindings.LAYERS)
    tiles = blocks._tiles(sets, bindings.supplier_members(spark, "/root/testdata/sf0.01"), layers, blocks.BLOCK, (), blocks._whole(sets, layers))
    sizes = ["+".join(f"{f}({c}_{i})" for i in range(len(layers))) for f, c in (("length", "t"), ("", "n"))]
    stored, tokens = tiles.selectExpr(f"sum({sizes[0]})", f"sum({sizes[1]})").first()
    assert 0 < stored < 2 * tokens


def test_shortcut_tests_the_key_before_it_works_out_the_score(spark):
    plan = __spark_entry__.queries()["shortcut_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    [kept] = [x for x in plan.splitlines() if "Filter" in x and "0.95" in x]
    assert kept.index("% 2") < kept.index("shared_0")
