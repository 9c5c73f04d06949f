import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_is_consistent():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_imports_without_llm(tmp_path):
    """The rest works where the llm folders are gone."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    r = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p9_found' not in q"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert r.returncode == 0, r.stderr
