"""The entry without optional libraries, in a process of its own."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from folionaut.plans.portfolio_queries import QUERIES
assert set(QUERIES) == set(entry.queries()), set(entry.queries()) - set(QUERIES)
"""


def run(*names):
    return subprocess.run([sys.executable, "-c", WITHOUT.format(names=names, root=str(ROOT))], capture_output=True, text=True, timeout=120)


def test_entry_without_optional_libraries():
    for names in (("folionaut.llm",), ("ahocorasick",), ("sentencepiece", "ahocorasick"), ("corpus_pipeline", "folionaut.llm")):
        done = run(*names)
        assert done.returncode == 0, done.stderr


def test_other_errors_are_not_hidden():
    assert run("folionaut.llm.common").returncode != 0 or not (ROOT / "folionaut" / "llm").exists()
