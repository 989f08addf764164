"""The driver's contract."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.FLAGSHIP in e.queries()


def test_flagship(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5


def test_without_the_training_data_operators():
    code = "import sys; sys.modules['patchwright.llm'] = None; import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert not any(name[:2] == "p1" for name in json.loads(out))


def test_nothing_else_imports_them():
    for p in (ROOT / "patchwright").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_shipping_is_done_once(spark):
    from patchwright import session

    session.ship(spark)
    n = len(session._SHIPPED)
    session.ship(spark)
    assert len(session._SHIPPED) == n
