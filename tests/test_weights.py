"""Pairs weighed by rare tokens, and the lines of suppliers: results against SQL on odd rows, and plans that move no row for each pair."""

import __spark_entry__
import duckdb
import pytest

from kindred.plans import bindings

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """sf0.001 with lines without a supplier, a brand that is missing, suppliers of no nation or without lines, and a part twice."""
    out = tmp_path_factory.mktemp("odd")
    rows = {
        "supplier": f"SELECT * REPLACE (CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE s_nationkey % 2 END AS s_nationkey) FROM '{SMALL}/supplier.parquet'",
        "part": f"SELECT * REPLACE (CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS p_brand) FROM '{SMALL}/part.parquet' UNION ALL SELECT * FROM '{SMALL}/part.parquet' WHERE p_partkey < 3",
        "lineitem": f"SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey) FROM '{SMALL}/lineitem.parquet' WHERE l_suppkey <> 3 AND l_orderkey % 7 = 0",
    }
    for name, sql in rows.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


def equals_sql(spark, name, path):
    con = duckdb.connect()
    for t in ("supplier", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {__spark_entry__.oracle_sql()[name]}")
    want = {r[:2]: r[2:] for r in con.execute("SELECT * FROM want").fetchall()}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in __spark_entry__.queries()[name](spark, path).collect()}
    assert len(want) > 3 and got.keys() == want.keys()
    assert all(v == pytest.approx(want[k], abs=1.1e-6) for k, v in got.items())


IDF = ["idf_weighted_tversky", "idf_weighted_jaccard"]


@pytest.mark.parametrize("name", IDF)
def test_weighted_pairs(spark, odd, name, monkeypatch):
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "hashpartitioning(a#" not in plan and "hashpartitioning(b#" not in plan
    equals_sql(spark, name, odd)
    monkeypatch.setattr(bindings, "VALUES", 3)  # too many values to number them
    equals_sql(spark, name, odd)


@pytest.mark.parametrize("name", ["layer_scores", "shortcut_pairs"])
def test_lines_move_once(spark, odd, name, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_partkey#" not in plan
        monkeypatch.setattr(bindings, "PARTS", 3)
        plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_partkey#" in plan  # parts without a bound are not broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_values_are_numbers(spark, odd):
    kinds = dict(bindings.supplier_sets(spark, odd).dtypes)
    assert kinds["component"] == kinds["resource"] == kinds["library"] == "array<int>"
    con = duckdb.connect()
    want = con.execute(f"SELECT l_suppkey, count(DISTINCT p_brand), count(DISTINCT p_type), bool_or(p_brand IS NULL) FROM '{odd}/lineitem.parquet' JOIN '{odd}/part.parquet' ON l_partkey = p_partkey GROUP BY 1").fetchall()
    got = {r.app_id: (len([x for x in r.component if x is not None]), len(r.resource), None in r.component) for r in bindings.supplier_sets(spark, odd).collect()}
    assert got == {r[0]: tuple(r[1:]) for r in want}
