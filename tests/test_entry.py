"""The driver's contract, with and without the optional subpackage."""

import os
import re
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_optional_subpackage(tmp_path):
    """A copy without the training-data operators still has all queries of the engine and their SQL."""
    shutil.copytree(os.path.join(REPO, "grovekit"), tmp_path / "grovekit", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    for pipeline in (False, True):
        if pipeline and os.path.exists(os.path.join(REPO, "corpus_pipeline.py")):
            shutil.copy(os.path.join(REPO, "corpus_pipeline.py"), tmp_path)
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 130 and set(q) == set(s), (len(q), set(q) ^ set(s)); assert 'pipeline' not in q and not [k for k in q if k.startswith('op')]"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_subpackage():
    for folder, _, files in os.walk(os.path.join(REPO, "grovekit")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    assert not re.search(r"^\s*(from|import)\b.*\bllm\b", source.read(), re.M), f
