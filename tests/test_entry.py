"""The entry module with and without the training-data folders."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SAY = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder):
    run = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr
    return json.loads(run.stdout)


def test_the_rest_imports_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    kept, oracles = names(copy)  # corpus_pipeline.py is there, its package is not
    (copy / "corpus_pipeline.py").unlink()
    assert names(copy) == [kept, oracles]
    assert len(kept) >= 134 and set(oracles) <= set(kept)
    assert not [n for n in kept if n == "pipeline" or (n.startswith("op") and n[2:3].isdigit())]


def test_another_missing_module_is_an_error(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    run = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode != 0 and "no_such_module_at_all" in run.stderr
