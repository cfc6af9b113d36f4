"""Texts that name a trailing window: ``Nm``, ``Nh``, or a bare number of seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Optional sign and digits with single underscores, spaces allowed around the number and at the ends.
_WINDOW = r"^\s*([+-]?\d+(?:_\d+)*)\s*$|^\s*([+-]?\d+(?:_\d+)*)\s*([mh])\s*$"


def window_seconds(text: Column) -> Column:
    """Whole seconds of a window text; NULL when the text is invalid or not positive."""
    number = F.coalesce(*[F.nullif(F.regexp_extract(text, _WINDOW, group), F.lit("")) for group in (1, 2)])
    unit = F.regexp_extract(text, _WINDOW, 3)
    scale = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    seconds = F.try_multiply(F.regexp_replace(number, "_", "").try_cast("bigint"), scale.cast("bigint"))
    return F.when(seconds > 0, seconds)
