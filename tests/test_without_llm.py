"""The rest works where the training-data subpackage, its tests and the pipeline's imports are gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_llm_folders(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("vectaria/llm", "tests/llm"):
        shutil.rmtree(to / folder, ignore_errors=True)
    code = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in [*q, *o]), 'ivf_search_batch' in q)"
    env = {**os.environ, "PYTHONPATH": str(to)}
    out = subprocess.run([sys.executable, "-c", code], cwd=to, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, of_llm, there = out.stdout.split()
    assert int(n) > 50 and of_llm == "0" and there == "True"
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=to, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout
