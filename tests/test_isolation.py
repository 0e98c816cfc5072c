"""The library without its training-data part."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert q and o and set(o) <= set(q) and "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in q)
"""


def test_queries_without_the_corpus_part(tmp_path):
    bare = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, tmp_path / "repo", ignore=bare)
    assert not (tmp_path / "repo/cueloom/llm").exists()
    if os.path.exists(f"{REPO}/corpus_pipeline.py"):
        assert (tmp_path / "repo/corpus_pipeline.py").exists()
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "repo/corpus_pipeline.py").unlink(missing_ok=True)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
