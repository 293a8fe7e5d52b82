"""The timestamp normaliser against written-out instants and against Python's zone database."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from tallyspan.operators.instants import changed_instants, normalise_instants

PROVIDERS = [("ny", "America/New_York", "mdy"), ("lon", "Europe/London", "dmy"), ("sh", "Asia/Shanghai", "ymd"), ("syd", "Australia/Sydney", "dmy")]
SCHEMA = "pos bigint, provider string, metadata map<string,string>, retrieved_at string, as_of string, published_at string, utc string, extra string"

CASES = [
    ("lon", None, "2023-01-02T04:05:06Z", "2023-01-02T04:05:06.000000Z"),
    ("lon", None, "2023-01-02t04:05:06z", "2023-01-02T04:05:06.000000Z"),
    ("lon", None, "2023-01-02T04:05:06.123456789Z", "2023-01-02T04:05:06.123456Z"),
    ("lon", None, "2023-01-02T04:05:06,5+0530", "2023-01-01T22:35:06.500000Z"),
    ("lon", None, "２０２３-０１-０２T０４:０５:０６-０５:００", "2023-01-02T09:05:06.000000Z"),
    ("ny", None, "2023-03-12 02:30:00", "2023-03-12T07:30:00.000000Z"),  # skipped: the offset before the change
    ("ny", None, "2023-11-05 01:30:00", "2023-11-05T05:30:00.000000Z"),  # twice: the earlier
    ("ny", None, "2023-11-05 01:30 EST", "2023-11-05T06:30:00.000000Z"),
    ("sh", None, "2023-07-01 10:00 CST", "2023-07-01T02:00:00.000000Z"),
    ("ny", {"timezone": "Europe/Berlin"}, "2023-07-01 10:00", "2023-07-01T08:00:00.000000Z"),
    ("ny", {"timezone": "Mars/Base"}, "2023-07-01 10:00", "2023-07-01T14:00:00.000000Z"),
    ("ny", None, "03/04/2023 5:06 PM", "2023-03-04T22:06:00.000000Z"),
    ("lon", None, "03/04/2023 05:06", "2023-04-03T04:06:00.000000Z"),
    ("sh", None, "03/04/2023 05:06", None),
    ("ny", None, "13/04/2023", None),
    ("sh", None, "2023年1月4日下午2:04", "2023-01-04T06:04:00.000000Z"),
    ("lon", None, "Mon, 02 Jan 2023 00:25:42 +0000", "2023-01-02T00:25:42.000000Z"),
    ("lon", None, "Feb 16, 2023, 5:47 PM GMT", "2023-02-16T17:47:00.000000Z"),
    ("lon", None, "February 12, 2023 at 12:10am", "2023-02-12T00:10:00.000000Z"),
    ("syd", None, "14 January 2023", "2023-01-13T13:00:00.000000Z"),
    ("lon", None, "2023-02-06T09:21:28+11:00[Australia/Sydney]", "2023-02-05T22:21:28.000000Z"),
    ("lon", None, "2023-01-05T19:50:08[Asia/Tokyo]", "2023-01-05T10:50:08.000000Z"),
    ("lon", None, "1672902290.82", "2023-01-05T07:04:50.820000Z"),
    ("lon", None, "1672902290820", "2023-01-05T07:04:50.820000Z"),
    ("lon", None, "1672902290820123", "2023-01-05T07:04:50.820123Z"),
    ("ny", None, "20230105102720", "2023-01-05T15:27:20.000000Z"),
    ("ny", None, "20230105T102720Z", "2023-01-05T10:27:20.000000Z"),
    ("ny", None, "20230105", "2023-01-05T05:00:00.000000Z"),
    ("lon", None, ' "2023-01-02T04:05:06Z"\n', "2023-01-02T04:05:06.000000Z"),
    ("lon", None, "2025-08-06T24:00:00Z", "2025-08-07T00:00:00.000000Z"),
    ("nobody", None, "2023-01-02 04:05", None),
    (None, None, "2023-01-02T04:05:06+01:00", "2023-01-02T03:05:06.000000Z"),
    *[("lon", None, v, None) for v in (
        None, "", " ", "-", "n/a", "NaT", "yesterday", "2 hours ago", "Q3 2026", "FY2025", "2025", "2026-07", "2025-01-01/2025-12-31",
        "2026-02-30", "2025-06-31 12:00", "2025-13-05T10:00:00Z", "2026-07-30T25:10:00Z", "0000-00-00", "2023-02-29", "1900-02-29", "2023-01-02T04:05:06+00:00",
    )],
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, p, m, v, None, None, "clash", "x") for i, (p, m, v, _) in enumerate(CASES)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA), spark.createDataFrame(PROVIDERS, "provider string, tz_name string, date_order string")


def test_every_written_form(tables):
    got = {r["pos"]: r["utc"] for r in changed_instants(*tables).collect()}
    wrong = [(v, want, got.get(i)) for i, (_, _, v, want) in enumerate(CASES) if got.get(i) != want]
    assert not wrong


def test_repeated_rows_come_once_and_empty_tables_have_none(spark, tables):
    sources, providers = tables
    found = changed_instants(sources, providers)
    assert found.count() == found.distinct().count()
    assert changed_instants(sources.limit(0), providers).count() == 0
    assert changed_instants(sources, providers.limit(0)).count() > 0
    assert normalise_instants(sources.limit(0), providers).columns[0] == "pos"


def test_local_times_agree_with_the_zone_database(spark):
    start = datetime(2021, 1, 1)
    local = [start + timedelta(hours=13 * i) for i in range(1500)]
    rows = [(i, p[0], None, t.strftime("%Y-%m-%d %H:%M:%S"), None, None, "", "") for i, t in enumerate(local) for p in PROVIDERS[:1]]
    providers = spark.createDataFrame(PROVIDERS, "provider string, tz_name string, date_order string")
    got = {r["pos"]: r["utc"] for r in changed_instants(spark.createDataFrame(rows, SCHEMA), providers).collect()}
    zone = ZoneInfo("America/New_York")
    for i, t in enumerate(local):
        assert got[i] == t.replace(tzinfo=zone).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
