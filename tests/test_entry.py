"""The library and the driver's entry without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import pkgutil, importlib, leafmill
for m in pkgutil.walk_packages(leafmill.__path__, "leafmill."):
    importlib.import_module(m.name)
import __spark_entry__ as e
named = e.queries()
assert set(e.oracle_sql()) <= set(named)
print(len([n for n in named if n.startswith("q_")]), len([n for n in named if n.startswith("op") or n == "pipeline"]))
"""


@pytest.mark.parametrize("gone", [("leafmill/llm",), ("leafmill/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
            (copy / name / "__pycache__").mkdir(parents=True)  # what a deletion may leave
        else:
            (copy / name).unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    plain, trained = map(int, got.stdout.split())
    has_llm = (ROOT / "leafmill/llm/queries.py").exists() and "leafmill/llm" not in gone
    assert plain > 70 and trained == (10 if has_llm else 0)
