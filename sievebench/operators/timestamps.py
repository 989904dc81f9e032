"""Normalising timestamps that arrive in many spellings to one UTC instant.

The text goes through an ordered cascade of anchored patterns (epoch numbers, then date forms, each with an optional
time and an optional zone); the first pattern that matches the *whole* text decides, and its parts are then checked
strictly, so an impossible date or time never rolls over into another one.

Zone policy, in this order:

1. an offset, ``Z``/``UTC``/``GMT`` or a zone name in the text;
2. an abbreviation in the text, read as one of the source's own zone (``IST`` in Kolkata is +05:30);
3. the source's zone from the lookup table; without one the text denotes no instant.

Local times that occur twice mean the earlier instant; skipped ones take the offset in force before the gap.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import zoneinfo
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH_ORDINAL = dt.date(1970, 1, 1).toordinal()
UTC_NAMES = frozenset({"z", "utc", "gmt", "ut", "zulu"})
MONTHS = {
    name: i + 1
    for i, names in enumerate(
        (
            ("jan", "january"),
            ("feb", "february"),
            ("mar", "march"),
            ("apr", "april"),
            ("may",),
            ("jun", "june"),
            ("jul", "july"),
            ("aug", "august"),
            ("sep", "sept", "september"),
            ("oct", "october"),
            ("nov", "november"),
            ("dec", "december"),
        )
    )
    for name in names
}
WEEKDAYS = {
    name: i
    for i, names in enumerate(
        (
            ("mon", "monday"),
            ("tue", "tues", "tuesday"),
            ("wed", "wednesday"),
            ("thu", "thur", "thurs", "thursday"),
            ("fri", "friday"),
            ("sat", "saturday"),
            ("sun", "sunday"),
        )
    )
    for name in names
}

#: Micros for one unit of a bare number with so many digits before the point: seconds, milliseconds, microseconds and
#: nanoseconds (0) of the years 1973 to 2286; eleven digits are seconds too. Of other lengths no unit can be told (eight
#: and fourteen may be a written date), so these denote nothing.
EPOCH_UNITS = {9: 1_000_000, 10: 1_000_000, 11: 1_000_000, 12: 1_000, 13: 1_000, 15: 1, 16: 1, 18: 0, 19: 0}

_CLOCK = (
    r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
    r"(?:\s?(?P<ap>[ap])\.?m\b\.?)?"
)
_BASIC_CLOCK = r"(?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
_ZONE = (
    r"(?:\s?(?P<off>(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?))?"
    r"(?:\s?(?:\[(?P<zb>[a-z0-9_+\-/]+)\]|(?P<zn>z|[a-z]{2,}(?:/[a-z0-9_+\-]+)*)))?"
)


def _form(date: str, sep: str, clock: str = _CLOCK, optional: bool = True) -> re.Pattern[str]:
    tail = rf"(?:{sep}{clock}{_ZONE})" + ("?" if optional else "")
    return re.compile(rf"{date}{tail}\Z", re.IGNORECASE | re.ASCII)


_EPOCH = re.compile(r"(?P<sign>[+-]?)(?P<n>\d+)(?:\.(?P<f>\d*))?\Z", re.ASCII)
_DAY = r"(?:(?P<wd>[a-z]{3,9})\.?,?\s+)?"
#: The cascade; the first form that matches the whole text is the only one tried.
CASCADE: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("iso", _form(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})", r"(?:t|\s+)")),
    ("iso_basic", _form(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})", "t", _BASIC_CLOCK)),
    ("iso_week", _form(r"(?P<y>\d{4})-w(?P<w>\d{2})-(?P<d>\d)", r"(?:t|\s+)")),
    ("iso_ordinal", _form(r"(?P<y>\d{4})-(?P<j>\d{3})", r"(?:t|\s+)")),
    ("year_first", _form(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})", r"(?:t|,?\s+)")),
    ("by_source", _form(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2})", r"(?:t|,?\s+)")),
    ("day_name", _form(_DAY + r"(?P<d>\d{1,2})(?:[\s-]+)(?P<mon>[a-z]{3,9})\.?,?[\s-]+(?P<y>\d{4})", r"(?:,?\s+(?:at\s+)?)")),
    ("name_day", _form(_DAY + r"(?P<mon>[a-z]{3,9})\.?\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4})", r"(?:,?\s+(?:at\s+)?)")),
)


@functools.lru_cache(maxsize=1024)
def _zone(name: str) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


@functools.lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    return {name.lower(): name for name in zoneinfo.available_timezones()}


@functools.lru_cache(maxsize=4096)
def _abbreviations(zone: str, year: int) -> dict[str, int]:
    """Offsets in seconds of the abbreviations the zone uses around the year, lower case."""
    tz, out = _zone(zone), {}
    if tz is None:
        return out
    for y in (year - 1, year + 1, year):
        for month in range(1, 13):
            for day in (1, 15):
                at = dt.datetime(min(max(y, 1), 9999), month, day, 12, tzinfo=tz)
                out[at.tzname().lower()] = int(at.utcoffset().total_seconds())
    return out


def _local_offset(zone: str, day: int, second: int) -> int:
    """Offset in seconds of a local time; fold 0 is the earlier of two instants, and before the gap for a skipped one."""
    tz = _zone(zone)
    at = dt.datetime.combine(dt.date.fromordinal(day), dt.time(second // 3600, second // 60 % 60, second % 60), tz)
    return int(at.utcoffset().total_seconds())


def _day(parts: dict[str, str | None], form: str, order: str | None) -> int | None:
    """The proleptic ordinal of the date, None for an impossible one."""
    try:
        if form == "iso_week":
            return dt.date.fromisocalendar(int(parts["y"]), int(parts["w"]), int(parts["d"])).toordinal()
        if form == "iso_ordinal":
            first, n = dt.date(int(parts["y"]), 1, 1).toordinal(), int(parts["j"])
            return first + n - 1 if 1 <= n <= dt.date(int(parts["y"]), 12, 31).toordinal() - first + 1 else None
        if form == "by_source":
            if order not in ("dmy", "mdy", "ymd"):
                return None
            y, m, d = (int(parts["abc"[order.index(k)]]) for k in "ymd")
            if len(parts["abc"[order.index("y")]]) == 4:
                pass
            elif order == "ymd" and len(parts["c"]) == 4:
                return None
            else:
                y += 2000 if y < 70 else 1900
            return dt.date(y, m, d).toordinal()
        month = parts.get("m")
        m = int(month) if month else MONTHS.get(parts["mon"].lower())
        day = m and dt.date(int(parts["y"]), m, int(parts["d"])).toordinal()
        if day and parts.get("wd"):
            weekday = WEEKDAYS.get(parts["wd"].lower())
            if weekday is None or (day + 6) % 7 != weekday:
                return None
        return day or None
    except ValueError:
        return None


def _offset(text: str) -> int | None:
    sign, digits = (-1 if "-" in text else 1), re.sub(r"[^0-9:]", "", text)
    if ":" in digits:
        h, m = digits.split(":")
    else:
        h, m = (digits, "0") if len(digits) <= 2 else (digits[:-2], digits[-2:])
    h, m = int(h), int(m)
    return sign * (h * 3600 + m * 60) if h <= 18 and m < 60 else None


def parse_instant(raw: str | None, zone: str | None = None, order: str | None = None) -> int | None:
    """Micros since 1970 UTC of the instant the text denotes, None when it denotes none.

    ``zone`` is the IANA zone of the source, ``order`` (dmy, mdy, ymd) the order of the parts in its all-digit dates.
    Missing smaller units are zero, digits beyond micros are cut off, a date alone is its local midnight.
    """
    if raw is None:
        return None
    text = " ".join(raw.replace("−", "-").split()).strip("'\"")
    if not text or not any("0" <= c <= "9" for c in text):
        return None
    if number := _EPOCH.match(text):
        unit = EPOCH_UNITS.get(len(number["n"]))
        if unit is None:
            return None
        n = int(number["n"])
        micros = n // 1000 if unit == 0 else n * unit
        if number["f"] and unit > 1:
            micros += int((number["f"] + "000000")[:6]) * unit // 1_000_000
        return -micros if number["sign"] == "-" else micros
    for form, pattern in CASCADE:
        if match := pattern.match(text):
            break
    else:
        return None
    parts = match.groupdict()
    day = _day(parts, form, order)
    if day is None:
        return None
    second = fraction = 0
    if parts["H"] is not None:
        h, m, s = int(parts["H"]), int(parts["M"]), int(parts["S"] or 0)
        if half := parts.get("ap"):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if half.lower() == "p" else 0)
        if h > 23 or m > 59 or s > 59:
            return None
        second, fraction = h * 3600 + m * 60 + s, int(((parts["f"] or "") + "000000")[:6])
    offset = None
    if parts.get("off"):
        offset = _offset(parts["off"])
        if offset is None:
            return None
    name = parts.get("zb") or parts.get("zn")
    if name:
        low = name.lower()
        if low in UTC_NAMES:
            named = 0
        elif "/" in low:
            known = _zone_names().get(low)
            if known is None:
                return None
            named = _local_offset(known, day, second)
        else:
            named = _abbreviations(zone, dt.date.fromordinal(day).year).get(low) if zone else None
            if named is None:
                return None
        offset = named if offset is None else offset
    if offset is None:
        if not zone or _zone(zone) is None:
            return None
        offset = _local_offset(zone, day, second)
    return ((day - EPOCH_ORDINAL) * 86400 + second - offset) * 1_000_000 + fraction


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last three columns are text, zone and order; they are replaced by the instant."""
    for batch in batches:
        n = batch.num_columns - 3
        texts, zones, orders = (batch.column(i).to_pylist() for i in range(n, n + 3))
        micros = pa.array([parse_instant(*x) for x in zip(texts, zones, orders, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], micros], [*batch.schema.names[:n], "utc_us"])


def normalise_timestamps(
    df: DataFrame,
    sources: DataFrame,
    *,
    keep: list[str],
    raw: str = "ts_raw",
    source: str = "collector_id",
    zone: str = "zone_name",
    order: str = "date_order",
) -> DataFrame:
    """``keep`` columns of every row plus ``utc_us``, null where the text denotes no instant.

    Rows are never dropped: a null text, an unknown source or one listed twice in ``sources`` (its first zone and order
    in text order count) give a row all the same. ``sources`` is joined on its key without a hint, so Spark broadcasts
    it only below its own size threshold; the parsing itself needs no shuffle.
    """
    from pyspark.sql import types as T

    lookup = sources.groupBy(F.col(source).alias("__source")).agg(F.min(F.struct(zone, order)).alias("__of"))
    rows = df.select(*[F.col(c) for c in keep], F.col(raw).alias("__raw"), F.col(source).alias("__key"))
    joined = rows.join(lookup, F.col("__key") == F.col("__source"), "left")
    narrow = joined.select(*keep, "__raw", F.col(f"__of.{zone}").alias("__zone"), F.col(f"__of.{order}").alias("__order"))
    schema = T.StructType([*[narrow.schema[c] for c in keep], T.StructField("utc_us", T.LongType())])
    return narrow.mapInArrow(_parse_batches, schema)
