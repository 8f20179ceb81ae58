"""Every registered query runs, and equals its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from foliant.plans import catalog

SMALL = "/root/testdata/sf0.001"


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(norm, value))
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    rows = frame.select(columns).collect()
    assert rows
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        assert sorted(c[0] for c in found.description) == columns
        order = [[c[0] for c in found.description].index(c) for c in columns]
        expected = sorted((tuple(norm(r[i]) for i in order) for r in found.fetchall()), key=repr)
        assert sorted((tuple(map(norm, r)) for r in rows), key=repr) == expected
