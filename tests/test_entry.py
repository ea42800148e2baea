"""The entry module, with and without the training-data folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "o43_pattern_summaries" in __spark_entry__.queries()


def test_without_the_llm_folder(tmp_path):
    shutil.copytree(REPO / "loglattice", tmp_path / "loglattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_flagship(spark):
    found = __spark_entry__.QUERIES["o56_rebuild"](spark, "/root/testdata/sf0.001").collect()
    assert found and sum(r["count"] for r in found) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
