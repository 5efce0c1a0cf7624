"""Every query with SQL against DuckDB, on the smallest driver tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from vellum.plans import catalog, corpus, derived  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "" if pd.isna(v) else round(v, 12)
    if v is None or v is pd.NaT:
        return ""
    return str(v)[:10] if isinstance(v, datetime.date) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([cell(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        cols, expected = rows(db.execute(catalog.ORACLE_SQL[name]).fetchdf())
        own_cols, own = rows(got)
        assert own_cols == cols
        assert [r.replace(".0,", ",").replace(".0]", "]") for r in own] == [r.replace(".0,", ",").replace(".0]", "]") for r in expected]
    else:
        assert len(got) > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(os.path.join(os.path.dirname(e.__file__), "bench.py"))


def test_without_the_training_data_part(tmp_path):
    """The entry works where the training-data part is deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/bench.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root]  # libraries may come through it, the repository may not
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), *kept])}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests", "-k", "test_numbers or test_entry or test_limits or required_words"], cwd=tmp_path, check=True, env=env, timeout=300)


def test_without_the_tokenizers(tmp_path):
    """The entry works where the training-data part is there but cannot be imported."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)
