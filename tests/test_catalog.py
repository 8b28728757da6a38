"""Every query with SQL gives the rows of its SQL."""

import pytest
from conftest import SF, assert_same

from gridloom import catalog
from gridloom.catalog import images


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    assert_same(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, duck)


@pytest.mark.parametrize("name", ["fft_roundtrip", "fft_matches_dft"])
def test_transforms_take_all_events(name, spark, monkeypatch):
    seen, fft_lines = [], images.m.fft_lines
    monkeypatch.setattr(images.m, "fft_lines", lambda signal, *a, **b: seen.append(signal) or fft_lines(signal, *a, **b))
    assert images.QUERIES[name](spark, SF).first().ok
    values = [r.value for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()]
    got = [r.re for r in seen[0].orderBy("line", "i").collect()]
    assert got[: len(values)] == values and not any(got[len(values) :]) and len(got) % images.POINTS == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SF
