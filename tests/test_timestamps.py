import datetime as dt

import pytest

from sievebench.operators.timestamps import normalise_timestamps, parse_instant


def us(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "zone", "order", "expected"),
    [
        ("2023-01-01T10:00:00Z", None, None, us(2023, 1, 1, 10)),
        ("2023-01-01 10:00", "Europe/Berlin", None, us(2023, 1, 1, 9)),
        ("2023-01-01", "Asia/Kolkata", None, us(2022, 12, 31, 18, 30)),
        ("20230101T100000+0530", None, None, us(2023, 1, 1, 4, 30)),
        ("2023-W01-1T00:00", "Etc/UTC", None, us(2023, 1, 2)),
        ("03/04/2023 1:00 pm", "Etc/UTC", "dmy", us(2023, 4, 3, 13)),
        ("03/04/2023 1:00p.m.", "Etc/UTC", "mdy", us(2023, 3, 4, 13)),
        ("03/04/2023", "Etc/UTC", "ymd", None),
        ("12/31/2022 12:05 AM", "Etc/UTC", "mdy", us(2022, 12, 31, 0, 5)),
        ("1 January 2023, 10:00:00 GMT+0545", None, None, us(2023, 1, 1, 4, 15)),
        ("January 1, 2023 at 10:00", "Etc/UTC", None, us(2023, 1, 1, 10)),
        ("Sun, 01 Jan 2023 10:00:00 UTC-5:00", None, None, us(2023, 1, 1, 15)),
        ("Mon, 01 Jan 2023 10:00:00 Z", None, None, None),
        ("2023-01-01T10:00:00 IST", "Asia/Kolkata", None, us(2023, 1, 1, 4, 30)),
        ("2023-01-01T10:00:00 IST", None, None, None),
        ("2023-01-01T10:00:00[America/St_Johns]", "Asia/Kolkata", None, us(2023, 1, 1, 13, 30)),
        ("2023-01-01T10:00:00 America/Denver", None, None, us(2023, 1, 1, 17)),
        ("2023-01-01T10:00:00−05:00", None, None, us(2023, 1, 1, 15)),
        ("'2023-01-01T10:00:00Z'", None, None, us(2023, 1, 1, 10)),
        ("1672531200", None, None, us(2023, 1, 1)),
        ("1672531200123", None, None, us(2023, 1, 1) + 123_000),
        ("1672531200123456789", None, None, us(2023, 1, 1) + 123_456),
        ("1672531200.5", None, None, us(2023, 1, 1) + 500_000),
        ("2023-01-01T10:00:00.123456789Z", None, None, us(2023, 1, 1, 10) + 123_456),
        ("2023-10-29 02:30", "Europe/Berlin", None, us(2023, 10, 29, 0, 30)),  # twice: the earlier
        ("2023-03-26 02:30", "Europe/Berlin", None, us(2023, 3, 26, 1, 30)),  # skipped: offset before the gap
        ("2023-10-29 02:30 CET", "Europe/Berlin", None, us(2023, 10, 29, 1, 30)),
        ("2023-02-29", "Etc/UTC", None, None),
        ("2023-01-01T24:00", "Etc/UTC", None, None),
        ("2023-01-01T10:61", "Etc/UTC", None, None),
        ("2023-01-01 13:00 pm", "Etc/UTC", None, None),
        ("2023-01-01T10:00", None, None, None),
        ("2023-01-01T10:00", "No/Where", None, None),
        ("null", "Etc/UTC", None, None),
        ("", "Etc/UTC", None, None),
        (None, "Etc/UTC", None, None),
        ("9" * 100_000, "Etc/UTC", None, None),
    ],
)
def test_parse(text, zone, order, expected):
    assert parse_instant(text, zone, order) == expected


SCHEMA = "ord long, ts_raw string, collector_id string, utc_us string, zone_name string"


def test_rows_are_never_lost(spark):
    rows = [(1, "2023-01-01T00:00", "a", "x", "y"), (1, "2023-01-01T00:00", "a", "x", "y"), (2, None, "a", "x", "y"), (3, "2023-01-01T00:00", None, "x", "y"), (4, "2023-01-01T00:00Z", "zz", "x", "y")]
    sources = spark.createDataFrame([("a", "Etc/UTC", "dmy"), ("a", "Etc/UTC", "dmy"), (None, "Asia/Tokyo", None)], "collector_id string, zone_name string, date_order string")
    got = normalise_timestamps(spark.createDataFrame(rows, SCHEMA), sources, keep=["ord"]).collect()
    day = us(2023, 1, 1)
    assert sorted((r["ord"], r["utc_us"]) for r in got if r["utc_us"] is not None) == [(1, day), (1, day), (4, day)]
    assert sorted(r["ord"] for r in got if r["utc_us"] is None) == [2, 3]


def test_empty_table(spark):
    sources = spark.createDataFrame([], "collector_id string, zone_name string, date_order string")
    assert normalise_timestamps(spark.createDataFrame([], SCHEMA), sources, keep=["ord"]).collect() == []
