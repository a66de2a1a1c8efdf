"""Every checked query against its SQL twin, on tables where every twin has rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from checks.queries import CHECKS, _scenarios, _select, inputs
from placewise.operators import common

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.fixture(scope="module")
def given(spark):
    return inputs(spark, SF_DIR)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if c.sql is not None])
def test_same_rows(name, duck, given):
    check = CHECKS[name]
    df = check.spark(given)
    columns = sorted(df.columns)
    found = ordered([[row[c] for c in columns] for row in df.collect()])
    result = duck.execute(check.duckdb())
    names = [d[0] for d in result.description]
    wanted = ordered([[row[names.index(c)] for c in columns] for row in result.fetchall()])
    assert wanted and found == wanted


SHUFFLED = ["flag_hub_rows", "resolve_place", "till_rep_join", "merchant_tx", "raw_to_merchant", "average_rank", "district_join", "training_rows", "shop_card_months", "demand"]


@pytest.fixture(scope="module")
def given_apart(spark):
    # Another spelling of the folder, so that no stage of the other tests is read.
    return inputs(spark, f"{SF_DIR}/.")


@pytest.mark.parametrize("name", SHUFFLED)
def test_same_rows_without_broadcast_lookups(name, duck, given_apart, monkeypatch):
    """The joins as they are beyond the size up to which lookups are broadcast."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    test_same_rows(name, duck, given_apart)


def test_selection_is_feasible(given):
    chosen = _select(given).toPandas()
    asked = _scenarios(given).toPandas().set_index("scenario_id")
    assert len(chosen) and set(chosen["scenario_id"]) <= set(asked.index)
    for scenario, rows in chosen.groupby("scenario_id"):
        assert len(rows) <= asked.loc[scenario, "k"] and rows["postal_code"].is_unique
        assert rows["total_cost"].sum() <= asked.loc[scenario, "budget"] + 1e-6
        assert rows["profit"].sum() <= rows["bound"].max() + 1e-6
