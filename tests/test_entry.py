"""The driver's contract, and the library without the llm folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 30


def test_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vector_topk' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; import quarry.cli, quarry.streaming.ingest"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
def test_catalogue_against_its_sql(spark):
    import duckdb

    from quarry.plans import catalogue

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")

    def canonical(frame):
        rows = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).values.tolist()
        return sorted(tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)

    for name, sql in catalogue.ORACLES.items():
        got, want = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert canonical(got) == canonical(want), name
