"""The driver's contract without the subpackage llm, or without a package that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("hidden", ["zstandard", "xxhash", "regex", "terrafold.llm", "corpus_pipeline"])
def test_all_else_stays(hidden):
    code = f"""
import sys, warnings
sys.path.insert(0, {ROOT!r})
sys.modules[{hidden!r}] = None
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
from terrafold.jobs import QUERIES, ORACLE_SQL
assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())
assert any("without" in str(w.message) for w in said), said
print(len(e.queries()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) >= 56
