import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from maskwright.plans import registry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, sql, name):
    df = registry.QUERIES[name](spark, small)
    got = df.collect()
    if name in registry.ORACLES:
        want = sql.execute(registry.ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, want.fetchall())


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 200
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_operators(tmp_path):
    """What the package holds besides maskwright.llm and the pipeline imports neither."""
    for p in [*ROOT.glob("maskwright/**/*.py"), ROOT / "__spark_entry__.py"]:
        where = p.relative_to(ROOT)
        if "llm" not in where.parts:
            (tmp_path / where).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / where).write_text(p.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert out.stdout.strip() == str(len(registry.QUERIES)), out.stderr[-500:]
