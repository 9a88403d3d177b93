"""Every query with an oracle matches DuckDB on the small scale (names, rows, values)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_harness import compare, duck

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF_SMALL, name, entry.queries()[name], ORACLES[name], con)
    assert res.get("match"), res


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 7 and set(df.columns) == {"grade_code", "n_loans", "n_defaults", "default_rate"}


def test_fixture_counts(spark):
    """Row counts of the fixture, staging and mart as documented for sf0.001."""
    from riskloom.operators.staging import build_layers
    from riskloom.sources.fixture import raw_loans
    raw = raw_loans(spark, SF_SMALL)
    layers = build_layers(raw)
    assert raw.count() == 1500
    assert layers["stg_loans"].count() == 952
    assert layers["mart_training"].count() == 928
    assert layers["mart_training"].filter("target = 1").count() == 400


def test_valid_applications_count(spark):
    from riskloom.operators.applications import applications_from_loans, split_rejects
    from riskloom.sources.fixture import raw_loans
    valid, rejected = split_rejects(applications_from_loans(raw_loans(spark, SF_SMALL)))
    assert valid.count() == 736 and rejected.count() == 1500 - 736
