import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True)
    return out.stdout.split()


def copied(tmp_path, *left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", *left_out)
    return shutil.copytree(ROOT, tmp_path / "-".join(["copy", *left_out]), ignore=skip)


def test_queries_without_the_training_data_operators(tmp_path):
    rest = names(copied(tmp_path, "llm"))  # corpus_pipeline.py is still there
    assert len(rest) >= 163 and not [q for q in rest if q == "pipeline" or q.startswith("op")]
    assert names(copied(tmp_path, "llm", "corpus_pipeline.py")) == rest
    assert set(rest) <= set(names(ROOT))
