"""The entry module as a driver uses it."""

from __future__ import annotations

import subprocess
import sys

from .conftest import ROOT


def test_sql_is_there_before_queries_are_asked_for():
    code = "import __spark_entry__ as e; s = e.oracle_sql(); q = e.queries(); assert len(s) > 60 and set(s) <= set(q), set(s) - set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
