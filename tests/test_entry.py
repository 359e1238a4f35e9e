"""The driver contract on the small tables: every query against its SQL twin, with and without the training-data part."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return float(value) if type(value).__name__ == "Decimal" else value


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith(("op", "pipeline")) or n == "operating_point"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry_works_without_the_training_data_part(tmp_path):
    for item in ROOT.iterdir():
        if item.name not in ("kindred", "corpus_pipeline.py", ".git"):
            (tmp_path / item.name).symlink_to(item)
    (tmp_path / "kindred").mkdir()
    for item in (ROOT / "kindred").iterdir():
        if item.name != "llm":
            (tmp_path / "kindred" / item.name).symlink_to(item)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith('op1') or q == 'pipeline'))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split(maxsplit=1)[1].strip() == "[]"
