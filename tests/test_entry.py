"""The entry point with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("diamondlap.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in names) and len(names) > 150, names
assert set(e.oracle_sql()) <= names
"""


def test_entry_works_without_the_llm_folder():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_llm_folder():
    for path in (ROOT / "diamondlap").rglob("*.py"):
        if "llm" not in path.parts:
            assert "diamondlap.llm" not in path.read_text(), path
