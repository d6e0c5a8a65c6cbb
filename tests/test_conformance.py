"""Every registered query against its SQL twin on whole small tables."""

import subprocess
import sys
from pathlib import Path

import pytest

from conformance.cases import ORACLES, QUERIES
from conformance.compare import connect, differences
from docketlens import rules as R

# The single checks share one plan; "mechanical_checks" compares them all at once.
SINGLE = {r[0] for r in R.MECHANICAL_CHECKS} | {"PG-002", "PG-003", "PG-005"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SINGLE])
def test_query(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir).toPandas()
    assert len(frame) > 0
    if name in ORACLES:
        assert differences(frame, con.execute(ORACLES[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert len(rows) == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_outlive_a_missing_library():
    code = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert 'AGG-1' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)")
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=False).returncode == 0
