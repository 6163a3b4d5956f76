import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "herdlens", tmp_path / "herdlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bouts' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_training_data_operators():
    others = [p for p in (ROOT / "herdlens").rglob("*.py") if "llm" not in p.parts]
    assert others and not any("llm" in p.read_text() for p in others)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["pair_angles", "node_distances", "bout_initiators", "feature_matrix", "per_second_table", "state_hold"])
def test_columns_of_queries_and_their_sql(spark, data, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.execute(f"create view {table} as select * from '{data}/sf0.001/{table}.parquet'")
    got, want = e.queries()[name](spark, f"{data}/sf0.001"), con.sql(e.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(*sorted(got.columns)).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, want.df()[sorted(got.columns)].itertuples(index=False, name=None)))
