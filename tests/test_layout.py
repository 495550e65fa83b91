"""The library works without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_corpus_part_may_be_absent(tmp_path):
    for name in ("fenwright", "tests", "__spark_entry__.py"):
        here = ROOT / name
        if here.is_dir():
            shutil.copytree(here, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(here, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(o) <= set(q)"
    for args in (["-c", code], ["-m", "pytest", "tests", "--collect-only", "-q"]):
        done = subprocess.run([sys.executable, *args], cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stdout[-500:] + done.stderr[-500:]


def test_nothing_else_imports_the_corpus_part():
    for p in (ROOT / "fenwright").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
