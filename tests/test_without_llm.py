"""The core works with the subpackage llm taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_does_not_import_llm():
    for path in (ROOT / "docketry").rglob("*.py"):
        if "llm" not in path.parts:
            assert "docketry.llm" not in path.read_text(encoding="utf-8"), path


def test_entry_without_llm(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "docketry", tmp_path / "docketry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert not e.LLM_QUERIES and 'p2_found' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
