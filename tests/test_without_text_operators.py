"""The library without its optional part: the entry point imports, and the other queries are there."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); print('optional', any(n.startswith('op1_') for n in q))"


def run(folder):
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "spotweave", tmp_path / "spotweave", ignore=lambda _, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert run(tmp_path).stdout.strip() == "optional False"


def test_a_missing_library_is_an_error(tmp_path):
    """Only the part itself may be missing, not what it needs."""
    for n in ("spotweave", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / n).is_dir() else shutil.copy)(ROOT / n, tmp_path / n)
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    found = run(tmp_path)
    assert found.returncode and "a_library_that_is_not_there" in found.stderr
