"""The driver's entry file without the corpus subpackage."""

import importlib.util
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

HIDDEN = """
import importlib.abc, sys

class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in HIDE:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name in HIDE else real(name, package)
sys.meta_path.insert(0, Hide())
import __spark_entry__
queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
assert len(queries) > 150 and "srs" in queries and set(sql) <= set(queries)
assert not any(q == "pipeline" or q.startswith("op1_") for q in queries)
"""


def run_without(*names):
    code = f"HIDE = {set(names)!r}\n" + HIDDEN
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)


def test_entry_without_the_corpus_operators():
    """The pipeline file may stay while its operators are gone."""
    done = run_without("phasewise.llm")
    assert done.returncode == 0, done.stderr


def test_entry_without_the_pipeline_file_too():
    done = run_without("phasewise.llm", "corpus_pipeline")
    assert done.returncode == 0, done.stderr


def test_sql_only_for_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if importlib.util.find_spec("phasewise.llm") is None:
        assert "pipeline" not in __spark_entry__.queries()
