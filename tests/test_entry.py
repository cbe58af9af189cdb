"""The entry module without the text operators, or without a module that only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {1!r})
import __spark_entry__ as e
names = e.queries()
print(len(names), any(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("name", ["zstandard", "xxhash", "aerolake.llm", "corpus_pipeline"])
def test_text_queries_are_left_out(name):
    from aerolake.catalog import QUERIES

    out = subprocess.run([sys.executable, "-W", "ignore", "-c", BLOCKED.format(name, str(ROOT))], capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False", "False"]


def test_a_fault_of_the_library_itself_is_not_hidden():
    out = subprocess.run([sys.executable, "-c", BLOCKED.format("aerolake.plans.quantiles", str(ROOT))], capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode != 0
