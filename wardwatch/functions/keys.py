"""Keys derived from events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dedup_key(device_id: Column, room_id: Column, ts: Column) -> Column:
    """``dedup:`` + SHA-256 of ``device:room:second``.

    The key is the hash of the joined text, so ``a:b`` + ``c`` and ``a`` + ``b:c`` share a key.
    """
    second = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.concat(F.lit("dedup:"), F.sha2(F.concat_ws(":", device_id, room_id, second), 256))
