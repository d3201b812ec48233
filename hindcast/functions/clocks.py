"""Event clocks as columns.

Clocks are kept as zone-less UTC timestamps (`timestamp_ntz`), so no expression
depends on where a session runs, except casts of zoned text, for which
`session.configure` pins the session zone to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.fixed_values import EXCHANGE_ZONE, OPEN_CLOCK
from hindcast.functions.text import squeeze

HAS_CLOCK = r"\d{1,2}:\d{2}"
HAS_ZONE = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"
_ZONE_AT_END = r"\s*(?:[zZ]|[+-]\d{2}:?\d{2})$"

# Day patterns accepted besides ISO text; the month-first reading of 1/2/2020
# is the one pandas uses.
_DAY_PATTERNS = ("M/d/yyyy", "M/d/yy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")


def utc_from_zoned(text: Column) -> Column:
    """ISO text that carries an offset -> UTC; null when unparsable."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def utc_from_exchange(local: Column) -> Column:
    """New York wall time -> UTC, daylight saving included."""
    return F.convert_timezone(F.lit(EXCHANGE_ZONE), F.lit("UTC"), local)


def exchange_from_utc(clock: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(EXCHANGE_ZONE), clock)


def has_zone(text: Column) -> Column:
    return text.rlike(HAS_ZONE)


def _other_days(day_text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(day_text, p) for p in _DAY_PATTERNS])


def parse_calendar_date(text: Column) -> Column:
    """The date as written, with no zone shift; null when unparsable."""
    clean = squeeze(text)
    iso = F.regexp_extract(clean, r"^(\d{4}-\d{1,2}-\d{1,2})(?:$|[ T])", 1).try_cast("date")
    other = _other_days(F.trim(F.regexp_replace(clean, r"\s*\d{1,2}:\d{2}.*$", "")))
    return F.coalesce(iso, other)


def parse_published_at(text: Column) -> Column:
    """UTC clock of text that has a time of day; null for a bare date.

    Text without an offset is New York wall time.
    """
    clean = squeeze(text)
    wall = F.regexp_replace(clean, _ZONE_AT_END, "")
    iso = wall.try_cast("timestamp_ntz")
    clock = F.regexp_extract(wall, r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)", 1)
    spelled = F.concat_ws(" ", parse_calendar_date(clean).cast("string"), clock).try_cast("timestamp_ntz")
    local = F.coalesce(iso, spelled)
    offset = F.regexp_replace(F.regexp_extract(clean, f"({HAS_ZONE})", 1), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = utc_from_zoned(F.concat(local.cast("string"), F.upper(offset)))
    # Fractions of a second on wall time are dropped, as the source rule does.
    naive = utc_from_exchange(F.date_trunc("second", local).cast("timestamp_ntz"))
    return F.when(clean.rlike(HAS_CLOCK), F.when(has_zone(clean), zoned).otherwise(naive))


def open_stamp(day: Column) -> Column:
    """09:30 New York on that day, in UTC."""
    return utc_from_exchange(F.concat_ws(" ", day.cast("string"), F.lit(OPEN_CLOCK)).try_cast("timestamp_ntz"))


def published_at(text: Column) -> Column:
    return F.coalesce(parse_published_at(text), open_stamp(parse_calendar_date(text)))


def exchange_day(text: Column) -> Column:
    """New York calendar day of the instant; text without an offset is UTC."""
    clean = squeeze(text)
    wall = F.coalesce(
        F.regexp_replace(clean, _ZONE_AT_END, "").try_cast("timestamp_ntz"),
        parse_calendar_date(clean).cast("timestamp_ntz"),
    )
    clock = F.when(has_zone(clean) & clean.rlike(HAS_CLOCK), utc_from_zoned(clean)).otherwise(wall)
    return F.to_date(exchange_from_utc(clock))


# FIXED VALUES: zone names of RFC 2822 dates; any other name means UTC.
RSS_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "AST": "-0400", "ADT": "-0300",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_rss_date(text: Column) -> Column:
    """RFC 2822 date -> UTC; no zone means UTC; null when unparsable."""
    clean = F.regexp_replace(squeeze(text), r"^[A-Za-z]{3,9}\.?,?\s+|\s*\([^)]*\)$", "")
    plain = F.try_to_timestamp(
        F.regexp_replace(clean, r" (?:GMT|UTC?|Z)$", " +0000"), F.lit("d MMM yyyy H:mm[:ss][ xx]")
    ).cast("timestamp_ntz")
    # Nearly all dates take the one-pattern form; the rest is looked at only
    # when that fails.
    return F.coalesce(plain, _rss_date_by_parts(clean))


def _rss_date_by_parts(clean: Column) -> Column:
    """Zone names, long or lower-case months, two-digit years, dashes."""
    parts = r"^(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -](\d{4}|\d{2}) (\d{1,2}:\d{2})(:\d{2})?(?: ([A-Za-z]+|[+-]\d{4}))?$"
    piece = lambda i: F.regexp_extract(clean, parts, i)
    year = F.when(F.length(piece(3)) == 2, F.concat(F.when(piece(3) < "69", F.lit("20")).otherwise(F.lit("19")), piece(3))).otherwise(piece(3))
    second = F.when(piece(5) == "", F.lit(":00")).otherwise(piece(5))
    names = F.create_map(*[F.lit(v) for pair in RSS_ZONES.items() for v in pair])
    zone = F.when(piece(6).rlike(r"^[+-]"), piece(6)).otherwise(
        F.coalesce(F.try_element_at(names, F.upper(piece(6))), F.lit("+0000"))
    )
    plain = F.concat(piece(1), F.lit(" "), F.initcap(piece(2)), F.lit(" "), year, F.lit(" "), piece(4), second, F.lit(" "), zone)
    parsed = F.try_to_timestamp(plain, F.lit("d MMM yyyy H:mm:ss xx")).cast("timestamp_ntz")
    return F.when(clean.rlike(parts), parsed)


def iso_utc(clock: Column) -> Column:
    """2024-03-12T14:30:00+00:00, with microseconds only when there are any."""
    clock = clock.cast("timestamp_ntz")
    micros = F.date_format(clock, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
