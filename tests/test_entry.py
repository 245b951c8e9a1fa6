"""The entry module can be imported before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and int(run.stdout.split()[-1]) > 100, run.stderr
