"""The registry works without the corpus operators, whose folders and pipeline may be taken away."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def listed(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}).stdout.split()


def test_queries_without_the_corpus_operators(tmp_path):
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    plain = listed(tmp_path)
    assert plain == sorted(n for n in __spark_entry__.queries() if not re.match(r"op\d+_|pipeline$", n))
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(tmp_path) == plain


def test_nothing_else_imports_them():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tidemark.llm" not in path.read_text()
