import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), set(e.oracle_sql()) <= set(e.queries()))"


def names(folder):
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_queries_without_the_training_data_folders(tmp_path):
    """With the subpackage deleted, and with the pipeline deleted too, the rest is as it was."""
    left_out = shutil.ignore_patterns("llm", "tests", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    assert names(tmp_path / "copy") == ["True", "True"]
    if (tmp_path / "copy" / "corpus_pipeline.py").exists():
        os.remove(tmp_path / "copy" / "corpus_pipeline.py")
    assert names(tmp_path / "copy") == ["True", "True"]
