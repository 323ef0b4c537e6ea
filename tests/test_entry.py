"""The entry without the corpus part: whatever of it is left over, the other queries are there."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("leftover", ["nothing", "an empty folder", "a broken part"])
def test_other_queries_stay(tmp_path, leftover):
    shutil.copytree(ROOT / "leafmill", tmp_path / "leafmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if leftover == "an empty folder":
        (tmp_path / "leafmill/llm/__pycache__").mkdir(parents=True)
    if leftover == "a broken part":
        (tmp_path / "leafmill/llm").mkdir()
        (tmp_path / "leafmill/llm/__init__.py").touch()
        (tmp_path / "leafmill/llm/registry.py").write_text("import no_such_library\n")
        (tmp_path / "corpus_pipeline.py").touch()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=True)
    n, sql, has_corpus = said.stdout.split()[-3:]
    assert int(n) > 150 and int(sql) > 150 and has_corpus == "False"
