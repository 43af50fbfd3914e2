"""The driver's entry module, with and without the corpus operators."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from codelake.testbed import QUERIES
from codelake.testbed_sql import SQL

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(SQL) == {"cycle_findings"}


def test_without_the_corpus_operators(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("codelake.llm", "corpus_pipeline") else real(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_nothing_else_imports_them():
    for at in (ROOT / "codelake").rglob("*.py"):
        if "llm" not in at.relative_to(ROOT).parts:
            assert "llm" not in at.read_text(), at


def test_workers_find_the_checkout_from_any_folder(tmp_path):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        return
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); import __spark_entry__ as e; print('rows', e.queries()['clone_windows'](s, {data!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert "rows" in done.stdout, done.stderr[-2000:]
