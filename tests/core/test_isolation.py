"""The rest works without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert "corpus_report" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names, names
assert set(e.oracle_sql()) <= names
"""


def test_without_the_llm_folders(tmp_path):
    for removed in (("mdlake/llm", "tests/llm"), ("mdlake/llm", "tests/llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(removed))
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
        for name in removed:
            path = copy / name
            shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=120)


def test_shared_folder_on_a_cluster(monkeypatch):
    import pytest

    from mdlake import shared

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session)
