"""The library without the folders tidemark/llm and tests/llm."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASKED = """
import importlib.util
import __spark_entry__ as e
names, sql = sorted(e.queries()), sorted(e.oracle_sql())
assert names and set(sql) <= set(names), names
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert importlib.util.find_spec("tidemark.llm.queries") is None if importlib.util.find_spec("tidemark.llm") else True
print(",".join(names))
"""


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_other_queries_are_there_without_the_subpackage(tmp_path, also):
    left_out = {"tidemark/llm", "tests/llm", ".git", *also}
    skip = lambda d, names: [n for n in names if str(Path(d, n).relative_to(REPO)) in left_out or n == "__pycache__"]
    shutil.copytree(REPO, tmp_path / "repo", ignore=skip)
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo"), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", ASKED], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    from tidemark.plans import reading_queries, table_queries, tree_queries

    assert set(out.stdout.strip().split(",")) == {*table_queries.queries(), *tree_queries.queries(), *reading_queries.queries()}


def test_nothing_outside_imports_the_subpackage():
    for path in (REPO / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path
