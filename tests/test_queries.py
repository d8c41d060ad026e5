"""Every query with SQL gives what the SQL gives; the others run and have stable columns."""

from __future__ import annotations

import pytest
from conftest import assert_same

from corpusloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    assert_same(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert all(len(r) == len(df.columns) for r in df.collect())


def test_topk_is_one_ordered_limit(spark, sf):
    plan = catalogue.QUERIES["knn_filtered"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan


def test_entry_without_training_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
