from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_point

needs_tables = pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the generated tables")


@needs_tables
def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["pc5", "month", "mcc", "n_names", "spend"]
    assert df.count() > 0


def test_every_twin_has_a_query():
    queries, twins = entry_point.queries(), entry_point.oracle_sql()
    assert set(twins) <= set(queries)
    own = {n for n in queries if n != "pipeline" and not n.startswith("op")}
    assert own <= set(twins)
