"""The registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from provenant.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return f"{float(v):.8f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalogue.QUERIES) <= set(entry_points.queries())


def test_entry_points_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry_points.__file__).parent
    shutil.copytree(root / "provenant", tmp_path / "provenant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})


def test_entry_points_without_a_library_that_only_training_data_needs(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry_points.__file__).parent
    shutil.copytree(root / "provenant", tmp_path / "provenant", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(x.startswith('op') for x in q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True)


def test_a_pool_is_searched_for_once(spark):
    """What reads a pool several times reads a table of it, not the index."""
    from provenant.plans import catalogue

    for name in ("retrieve_expand_rerank", "rerank_overlap"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "_postings" not in plan and "positions" not in plan
