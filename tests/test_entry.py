"""The engine stands without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_llm(tmp_path):
    shutil.copytree(ROOT / "stressframe", tmp_path / "stressframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 100


def test_other_tests_pass_without_llm(tmp_path):
    """With both folders and the pipeline gone, all remaining tests are found, and some of operators and plans pass."""
    shutil.copytree(ROOT / "stressframe", tmp_path / "stressframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(filter(None, [str(tmp_path), *sys.path, os.environ.get("PYTHONPATH", "")]))}
    for args in (["tests", "--collect-only"], ["tests/test_plans.py", "tests/test_operators.py", "-k", "pushed or columns or graph or doubles or percentile_filters"]):
        said = subprocess.run([sys.executable, "-m", "pytest", *args, "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
        assert said.returncode == 0, said.stdout[-2000:]
