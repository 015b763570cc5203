"""Every registered query against its SQL twin on the smallest tables."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_two_runs_agree(spark, name):
    """Queries without a twin; what they return is tested beside their operators."""
    first, second = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == second


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject_id", "event_index", "burden", "events", "corroborated"]
    assert df.count() > 0


def events_only(tmp_path, rows):
    """A folder with one table of (user_id, event_type, seconds, value) events and a DuckDB view of it."""
    con, path = duckdb.connect(), str(tmp_path / "events.parquet")
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", [[i, datetime(2024, 1, 1) + timedelta(seconds=t), u, kind, v] for i, (u, kind, t, v) in enumerate(rows)])
    con.execute(f"COPY e TO '{path}' (FORMAT PARQUET)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    return con


def test_lag_needs_common_days(spark, tmp_path):
    """User 1 runs against itself, so a lag without common days (correlation 0) would win; user 2 has one device only, user 3 has no common day in reach."""
    rows = [(1, kind, 86400 * day + 60, v) for kind, pair in (("click", (1.0, 3.0)), ("view", (3.0, 1.0))) for day, v in zip((0, 10), pair)]
    rows += [(2, "click", 60, 1.0), (2, "click", 86460, 2.0), (3, "click", 60, 1.0), (3, "view", 86400 * 20, 1.0)]
    con = events_only(tmp_path, rows)
    for name in ("ds2_best_lag", "ds2_best_lag_fft"):
        ok, note = compare(spark, con, QUERIES[name], ORACLES[name], str(tmp_path))
        assert ok, note


def test_negatives_may_cover_empty_intervals(spark, tmp_path):
    """Empty awake rows every 20,000 s: a negative of 60,000 s lies over some of them and still leaves no free stretch."""
    rows = [(1, "error", 1000, 100.0), (1, "click", 200000, 1.0), (1, "view", 200000, 1.0)] + [(1, "signup", t, 0.0) for t in range(70000, 200000, 20000)]
    con = events_only(tmp_path, rows)
    ok, note = compare(spark, con, QUERIES["iv6_place_negatives_strict"], ORACLES["iv6_place_negatives_strict"], str(tmp_path))
    assert ok, note
