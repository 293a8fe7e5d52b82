"""Instants from timestamp strings of mixed formats, precisions and zones, as one column expression.

All formats are branches of one regular expression with named groups. The components are taken out in a single match
(a replacement that lists the named groups), checked against the calendar, and put together by integer day arithmetic.
No part of it leaves the JVM and nothing shuffles.

Defined results: null, blank, relative, incomplete and impossible values and periods give null. A value without zone is
local time in ``zone``; without a zone it gives null. A local time that occurs twice is the earlier instant, one that is
skipped counts with the offset before the change. ``24:00:00`` is the midnight that ends the day. Finer digits than
microseconds are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.text import fold_width

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?"
    "|Nov(?:ember)?|Dec(?:ember)?)"
)
_DAY_NAME = "(?:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?\\.?,?\\s+)?"
_DATE = (
    "(?:(?<ya>\\d{4})(?<sa>[-/.])(?<ma>\\d{1,2})\\k<sa>(?<da>\\d{1,2})"
    "|(?<yb>\\d{4})年\\s?(?<mb>\\d{1,2})月\\s?(?<db>\\d{1,2})日"
    "|(?<ca>\\d{1,2})(?<sc>[-/.])(?<cb>\\d{1,2})\\k<sc>(?<yc>\\d{4})"
    f"|{_DAY_NAME}(?<dd>\\d{{1,2}})(?:st|nd|rd|th)?[-\\s](?<md>(?i:{_MONTH}))\\.?,?[-\\s](?<yd>\\d{{4}})"
    f"|{_DAY_NAME}(?<me>(?i:{_MONTH}))\\.?\\s(?<de>\\d{{1,2}})(?:st|nd|rd|th)?,?\\s(?<ye>\\d{{4}}))"
)
_TIME = (
    "(?<cap>上午|下午)?(?<h>\\d{1,2}):(?<mi>\\d{2})(?::(?<s>\\d{2})(?:[.,](?<f>\\d+))?)?(?:\\s?(?<ap>(?i:[ap]\\.?m\\b\\.?)))?"
)
_ZONE = (
    "\\s?(?:(?<z>[Zz])|(?<off>[+-]\\d{2}(?::?\\d{2})?)(?:\\[[A-Za-z0-9_+/-]+\\])?"
    "|\\[(?<ra>[A-Za-z0-9_+/-]+)\\]|(?<rb>[A-Za-z_]+/[A-Za-z0-9_+/-]+)|(?<ab>[A-Z]{2,5}))"
)
_COMPACT = "(?<yf>\\d{4})(?<mf>\\d{2})(?<df>\\d{2})(?:[Tt]?(?<hf>\\d{2})(?<mif>\\d{2})(?<sf>\\d{2})(?<zf>[Zz])?)?"
_EPOCH = "(?<es>\\d{10})(?:\\.(?<ef>\\d+))?|(?<em>\\d{13})|(?<eu>\\d{16})"
PATTERN = f"^(?:{_DATE}(?:(?:[Tt]|\\s*,?\\s*(?:at\\s+)?){_TIME}(?:{_ZONE})?)?|{_EPOCH}|{_COMPACT})$"
GROUPS = (
    "ya ma da yb mb db ca cb yc dd md yd me de ye cap h mi s f ap z off ra rb ab yf mf df hf mif sf zf es ef em eu".split()
)
_MARK = "\u0001"

#: The one written form that needs no change: UTC with offset +00:00, no fraction or six digits of it.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{6})?\+00:00$"
# Names of summer time; every other abbreviation is the standard time of its place.
_SUMMER = r"^([A-Z]{1,3}DT|BST|CEST|EEST|WEST|MESZ|NZDT|AEDT)$"


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("bigint")


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic only."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def _days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def zone_or_null(zone: Column) -> Column:
    """The zone name when it is one that Spark knows, else null."""
    known = F.concat(F.lit("2020-01-01T00:00:00 "), zone).try_cast("timestamp").isNotNull()
    return F.when(zone.isNotNull() & known, zone)


def _to_utc(micros: Column, zone: Column) -> Column:
    """Local microseconds of a place to UTC: earlier instant in overlaps, offset before the change in gaps."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(micros), zone))


def match_groups(value: Column) -> Column:
    """All named groups of the one pattern as an array of strings, in the order of GROUPS; else a shorter array."""
    plain = F.regexp_replace(fold_width(value), r'^[\s"\u0001]+|[\s"\u0001]+$', "")
    listed = F.regexp_replace(plain, PATTERN, _MARK.join(f"${{{g}}}" for g in GROUPS) + _MARK)
    return F.split(listed, _MARK)


def _offset_micros(off: Column) -> Column:
    """Signed microseconds of a written offset, null when out of range."""
    hours, minutes = _int(F.substring(off, 2, 2)), F.coalesce(_int(F.regexp_extract(off, r"(\d{2})$", 1)), F.lit(0))
    minutes = F.when(F.length(off) > 3, minutes).otherwise(0)
    size = F.when((hours <= 18) & (minutes <= 59), (hours * 60 + minutes) * 60000000)
    return F.when(F.substring(off, 1, 1) == "-", -size).otherwise(size)


def with_instant(df: DataFrame, value: str, zone: str, order: str, out: str = "utc_micros", known_zones: bool = False) -> DataFrame:
    """Add ``out``: microseconds since 1970 UTC that ``value`` denotes, or null.

    ``zone`` names the column with the place's IANA zone (unknown names count as null; ``known_zones`` says that they have been
    looked up already), ``order`` the one with mdy, dmy
    or ymd for numeric dates that don't begin with the year. Each step is a projection of its own, so that a component
    is computed once and the plan stays small however often later steps use it.
    """
    p = f"__{out}_"
    keep = df.columns

    def g(name: str) -> Column:
        return F.nullif(F.col(p + "parts")[GROUPS.index(name)], F.lit(""))

    n = lambda name: F.col(p + name)
    df = df.withColumn(p + "all", match_groups(F.col(value)))
    df = df.withColumn(p + "parts", F.when(F.size(n("all")) == len(GROUPS) + 1, n("all")))
    month_text = F.lower(F.substring(F.coalesce(g("md"), g("me")), 1, 3))
    first, second = _int(g("ca")), _int(g("cb"))
    by_order = lambda mdy, dmy: F.when(F.col(order) == "mdy", mdy).when(F.col(order) == "dmy", dmy)
    df = df.withColumns(
        {
            p + "year": _int(F.coalesce(g("ya"), g("yb"), g("yc"), g("yd"), g("ye"), g("yf"))),
            p + "month": F.coalesce(
                _int(F.coalesce(g("ma"), g("mb"), g("mf"))),
                by_order(first, second),
                F.when(month_text.isNotNull(), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month_text)),
            ),
            p + "day": F.coalesce(
                _int(F.coalesce(g("da"), g("db"), g("dd"), g("de"), g("df"))), by_order(second, first)
            ),
            p + "half": F.coalesce(
                F.lower(F.substring(g("ap"), 1, 1)), F.when(g("cap") == "上午", "a").when(g("cap") == "下午", "p")
            ),
            p + "clock": F.coalesce(_int(F.coalesce(g("h"), g("hf"))), F.lit(0)),
            p + "minute": F.coalesce(_int(F.coalesce(g("mi"), g("mif"))), F.lit(0)),
            p + "second": F.coalesce(_int(F.coalesce(g("s"), g("sf"))), F.lit(0)),
            p + "fraction": _int(F.substring(F.rpad(F.coalesce(g("f"), F.lit("0")), 6, "0"), 1, 6)),
            p + "named": F.coalesce(g("ra"), g("rb")),
        }
    )
    df = df.withColumns(
        {
            p + "hour": F.when(n("half").isNull(), n("clock"))
            .when((n("half") == "p") & (n("clock") < 12), n("clock") + 12)
            .when((n("half") == "a") & (n("clock") == 12), F.lit(0))
            .otherwise(n("clock")),
            p + "days": F.when(
                (n("year") >= 1)
                & n("month").between(1, 12)
                & (n("day") >= 1)
                & (n("day") <= _days_in_month(n("year"), n("month"))),
                days_from_civil(n("year"), n("month"), n("day")),
            ),
            p + "place": F.when(n("named").isNotNull(), zone_or_null(n("named"))).otherwise(F.col(zone) if known_zones else zone_or_null(F.col(zone))),
            p + "january": days_from_civil(n("year"), F.lit(1), F.lit(1)) * 86400000000,
            p + "july": days_from_civil(n("year"), F.lit(7), F.lit(1)) * 86400000000,
        }
    )
    end_of_day = (n("hour") == 24) & (n("minute") == 0) & (n("second") == 0) & (n("fraction") == 0)
    # A half of the day with an hour from 13 on names the same hour twice and is taken as it stands.
    fits = F.when(n("half") == "a", n("clock").between(0, 12)).otherwise(n("hour").between(0, 23) | end_of_day)
    local = F.when(
        fits & n("minute").between(0, 59) & n("second").between(0, 59),
        (((n("days") * 24 + n("hour")) * 60 + n("minute")) * 60 + n("second")) * 1000000 + n("fraction"),
    )
    df = df.withColumn(p + "local", local)
    east = [n(moment) - _to_utc(n(moment), n("place")) for moment in ("january", "july")]
    fraction = _int(F.substring(F.rpad(F.coalesce(g("ef"), F.lit("0")), 6, "0"), 1, 6))
    instant = (
        F.when(g("es").isNotNull(), _int(g("es")) * 1000000 + fraction)
        .when(g("em").isNotNull(), _int(g("em")) * 1000)
        .when(g("eu").isNotNull(), _int(g("eu")))
        .when(n("local").isNull(), None)
        .when(g("z").isNotNull() | g("zf").isNotNull() | g("ab").isin("UTC", "GMT"), n("local"))
        .when(g("off").isNotNull(), n("local") - _offset_micros(g("off")))
        .when(n("place").isNull(), None)
        .when(g("ab").rlike(_SUMMER), n("local") - F.greatest(*east))
        .when(g("ab").isNotNull(), n("local") - F.least(*east))
        .otherwise(_to_utc(n("local"), n("place")))
    )
    # Filters on the result must not be pushed below it: that would write every step into the filter's expression.
    return df.select(*keep, F.explode(F.array(instant)).alias(out))


def utc_text(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of microseconds since 1970, by integer arithmetic: the session's zone has no part in it."""
    second, day = F.floor(micros / 1_000_000), F.floor(micros / 86_400_000_000)
    of_day = second - day * 86_400
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(of_day / 3600)), F.lit(":"), two(F.floor(of_day / 60) % 60), F.lit(":"), two(of_day % 60),
        F.lit("."), F.lpad((micros - second * 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )
