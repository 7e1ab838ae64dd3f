"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_without_a_session():
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql = map(int, said.stdout.split()[-2:])
    assert n > sql > 100


def test_without_the_training_data_operators(tmp_path):
    """The rest works where the llm folders and the pipeline are missing."""
    (tmp_path / "orgwatch").mkdir()
    for p in (ROOT / "orgwatch").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "orgwatch" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert "op1_" not in said.stdout and "pipeline" not in said.stdout and "t2_top_per_category" in said.stdout


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "category" in df.columns
