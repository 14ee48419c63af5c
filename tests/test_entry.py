"""The entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    env = {**os.environ, "PYTHONPATH": root, "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.split()


def copy_without(target, *left_out):
    def ignore(folder, inside):
        at = os.path.relpath(folder, ROOT)
        return [n for n in inside if n in (".git", "__pycache__") or os.path.normpath(os.path.join(at, n)) in left_out]

    shutil.copytree(ROOT, target, ignore=ignore)
    return str(target)


def test_imports_without_the_optional_folders(tmp_path):
    llm = os.path.join("longfeat", "llm"), os.path.join("tests", "llm")
    bare = names(copy_without(tmp_path / "bare", *llm))
    assert "day_facts" in bare and "pipeline" not in bare and not any(n.startswith("op") for n in bare)
    assert names(copy_without(tmp_path / "less", *llm, "corpus_pipeline.py")) == bare


def test_imports_without_the_pipeline(tmp_path):
    assert "pipeline" not in names(copy_without(tmp_path / "rest", "corpus_pipeline.py"))
