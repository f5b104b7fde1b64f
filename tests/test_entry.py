"""The entry points with and without the optional folder and file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "gleaner", tmp_path / "gleaner", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    return tmp_path


def said(folder):
    return subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True)


def test_without_the_optional_parts(copy):
    whole = said(copy).stdout.split()
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    without_pipeline = said(copy).stdout.split()
    assert without_pipeline[1:] == [whole[1], "False", "True"]
    shutil.rmtree(copy / "gleaner" / "llm", ignore_errors=True)
    n, ops, pipeline, twins = said(copy).stdout.split()
    assert int(n) >= 40 and (ops, pipeline, twins) == ("0", "False", "True")


def test_pipeline_without_its_operators(copy):
    shutil.rmtree(copy / "gleaner" / "llm", ignore_errors=True)
    assert said(copy).stdout.split()[1:] == ["0", "False", "True"]


def test_other_import_errors_are_not_swallowed(copy):
    folder = copy / "gleaner" / "llm"
    if not folder.exists():
        pytest.skip("the folder is optional")
    (folder / "packing.py").write_text("import gleaner.llm.misspelt\n")
    assert "misspelt" in said(copy).stderr and not said(copy).stdout
