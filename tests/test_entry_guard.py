"""The entry module works without the optional training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("hidden", ["zstandard", "tessera.llm", "corpus_pipeline"])
def test_entry_without(hidden):
    code = (f"import sys; sys.modules[{hidden!r}] = None\n"
            "import __spark_entry__ as E\n"
            "q = E.queries()\n"
            "assert len(q) >= 100 and set(E.oracle_sql()) <= set(q)\n"
            "assert not any(k == 'pipeline' or k.startswith('op') and k[2].isdigit() for k in q)\n")
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
