"""Time arithmetic on integer microseconds and ISO-8601 text parsing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from wardwatch.schema import MICROS

# The shapes that the built-in cast reads exactly as intended; everything else takes the general path.
_COMMON_SHAPE = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?(Z|[+-](0\d|1[0-7]):[0-5]\d)?\z"
)

# General ISO-8601: calendar or week date, extended or basic, any one separator character.
_DATE = (
    r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})"
    r"|(\d{4})-W(\d{2})(?:-(\d))?|(\d{4})W(\d{2})(\d)?)"
)
_CLOCK = r"(\d{2})(?:(?::(\d{2})(?::(\d{2}))?|(\d{2})(\d{2})?)?)(?:[.,](\d+))?"
_ZONE = r"(?:(Z)|([+-])(\d{2})(?:(?::(\d{2})(?::(\d{2}))?|(\d{2})(\d{2})?)?)(?:[.,](\d+))?)?"
_GENERAL = rf"(?s)\A{_DATE}(?:.{_CLOCK}{_ZONE})?\z"
# The pieces of a match in one order for all spellings: calendar year, month, day; week year, week, weekday;
# hour, minute, second, fraction; zone sign, hour, minute, second, fraction.
_PIECES = "$1$4|$2$5|$3$6|$7$10|$8$11|$9$12|$13|$14$16|$15$17|$18|$20|$21|$22$24|$23$25|$26"


def as_of_literal(as_of: str | datetime) -> Column:
    """Timestamp literal; a naive value is UTC."""
    if isinstance(as_of, datetime):
        moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        as_of = moment.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp")


def as_of_micros(as_of: str | datetime) -> Column:
    return F.unix_micros(as_of_literal(as_of))


def shift(moment: Column, seconds: float) -> Column:
    """``moment`` moved by a fixed number of seconds, exact to the microsecond."""
    return F.timestamp_micros(F.unix_micros(moment) + F.lit(round(seconds * MICROS)))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS))


def time_slice(moment: Column, slice_seconds: int) -> Column:
    """Number of the fixed-width slice that holds ``moment``."""
    return F.floor(F.unix_micros(moment) / F.lit(slice_seconds * MICROS)).cast("bigint")


def iso_text(moment: Column) -> Column:
    """ISO text with an explicit UTC offset, fraction only when present."""
    fraction = F.when(F.unix_micros(moment) % MICROS != 0, F.date_format(moment, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def parse_iso_utc(text: Column) -> Column:
    """V3: ISO-8601 text to a UTC timestamp; NULL when the text is not a valid event time.

    A text without zone is UTC. Fractions beyond six digits are cut. The general path covers basic
    forms, week dates, and offsets with seconds; it runs only for rows the common shape does not match.
    """
    common = F.when(text.rlike(_COMMON_SHAPE), text.try_cast("timestamp"))
    return F.coalesce(common, _parse_general(text))


def _parse_general(text: Column) -> Column:
    matched = F.when(text.rlike(_GENERAL), F.split(F.regexp_replace(text, _GENERAL, _PIECES), r"\|"))
    # A lambda over one element names the pieces, so that the match runs once per row.
    return F.element_at(F.transform(F.array(matched), _assemble), 1)


def _assemble(pieces: Column) -> Column:
    (year, month, day, week_year, week, weekday, hour, minute, second, fraction, sign, *zone) = [
        F.nullif(pieces[position], F.lit("")) for position in range(15)
    ]
    zero = F.lit(0)

    def number(piece: Column, absent: Column = zero) -> Column:
        return F.coalesce(piece.cast("int"), absent)

    def micros(piece: Column) -> Column:
        return F.coalesce(F.rpad(F.substring(piece, 1, 6), 6, "0").cast("bigint"), F.lit(0).cast("bigint"))

    def date_of(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, month, day).try_cast("date")

    first_monday = date_of(week_year, F.lit("01"), F.lit("04"))
    first_monday = F.date_sub(first_monday, F.weekday(first_monday))
    monday = F.date_add(first_monday, (number(week) - 1) * 7)
    weekday_number = number(weekday, F.lit(1))
    week_day = F.when(
        weekday_number.between(1, 7) & (F.weekofyear(monday) == number(week)) & (F.year(F.date_add(monday, 3)) == week_year.cast("int")),
        F.date_add(monday, weekday_number - 1),
    )
    date = F.when(year.isNotNull(), date_of(year, month, day)).otherwise(week_day)
    clock = ((number(hour) * 60 + number(minute)) * 60 + number(second)).cast("bigint") * MICROS + micros(fraction)
    zone_hour, zone_minute, zone_second, zone_fraction = zone
    zone_seconds = number(zone_hour) * 3600 + number(zone_minute) * 60 + number(zone_second)
    offset = zone_seconds.cast("bigint") * MICROS + micros(zone_fraction)
    valid = (
        (F.coalesce(year, week_year) != "0000")
        & (number(hour) <= 23)
        & (number(minute) <= 59)
        & (number(second) <= 59)
        & (offset < F.lit(86_400 * MICROS))
    )
    signed = F.when(sign == "-", -offset).otherwise(offset)
    return F.when(valid, F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + clock - signed))
