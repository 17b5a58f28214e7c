"""Event time: late rows, windows that close once, sessions and histories that go on from one arrival to the next."""

import datetime as dt

import pytest

from tessera.streaming import sessions

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Nine days in three arrivals; row 11 comes late, long after its window was closed; row 22 late, but its session goes on."""
    at = lambda day, hour: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day, hours=hour)
    rows = [(8, at(0, 0), 1, "a", 1.0), (11, at(1, 0), 1, "late", 5.0), (1, at(1, 1), 1, "b", 1.0), (2, at(2, 23), 1, "c", 1.0), (22, at(2, 23.5), 2, "x", 1.0), (3, at(3, 1), 1, "d", 1.0), (4, at(3, 2), 2, "y", 1.0), (5, at(5, 0), 2, None, 1.0), (6, at(8, 23), 1, "e", 1.0), (7, at(9, 0), 1, "f", 1.0)]
    d = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/events.parquet")
    return str(d)


def test_late_rows_of_closed_windows_are_dropped(spark, folder):
    got = {(r["start"].strftime("%d %H:%M"), r["key"]): r["n"] for r in sessions.closed(spark, folder, "tumbling").collect()}
    assert ("02 00:00", "late") not in got  # its window was closed when it came
    assert ("09 23:00", "e") not in got and ("10 00:00", "f") not in got  # still open at the end
    assert got[("02 01:00", "b")] == 1 and len(got) == 7


def test_sliding_windows_hold_a_row_three_times(spark, folder):
    got = [r["start"].strftime("%d %H:%M") for r in sessions.closed(spark, folder, "sliding").where("key = 'b'").collect()]
    assert sorted(got) == ["02 00:40", "02 00:50", "02 01:00"]


def test_sessions_go_on_over_arrivals(spark, folder):
    got = sorted((r["key"], r["start"].strftime("%d %H:%M"), r["n"]) for r in sessions.closed(spark, folder, "session").collect())
    assert ("1", "03 23:00", 2) in got  # 23:00 in the first arrival, 1:00 in the second
    assert ("2", "03 23:30", 2) in got  # late, but not too late
    assert len(got) == len(set(got)) and sum(n for *_, n in got) == 7


def test_histories_go_on_and_are_forgotten(spark, folder):
    got = {r["event_id"]: r["history"] for r in sessions.histories(spark, folder).collect()}
    # 8 days 23 hours comes after a long pause; the last day isn't over
    assert got == {8: "", 11: "a", 1: "late a", 2: "b late a", 3: "c b late a", 22: "", 4: "x", 5: "y x"}
