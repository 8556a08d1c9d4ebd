"""The driver's contract, with the training-data operators and without them."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), *sorted(e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) > 100 and not [n for n in got if n.startswith("op1") or n == "pipeline"]
    # what is missing for another reason is not taken for their absence
    (tmp_path / "repo" / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True).returncode != 0
