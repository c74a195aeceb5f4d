"""Every registered query against its oracle on the smallest driver tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from sparkfathom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    want = tables.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    at = [want.columns.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_oracles_are_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "sparkfathom", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "sparkfathom")
    for name in os.listdir(f"{root}/sparkfathom"):
        if name != "llm":
            os.symlink(f"{root}/sparkfathom/{name}", tmp_path / "sparkfathom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') for n in q if n != 'outcomes')"
    os.remove(tmp_path / "__spark_entry__.py")
    with open(f"{root}/__spark_entry__.py") as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
