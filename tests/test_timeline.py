import random
import re
from datetime import datetime, timezone

from pyspark.sql import functions as F

from wardwatch.functions.timeline import iso_text, parse_iso_utc
from wardwatch.functions.windows import window_seconds

DATES = ["2026-06-29", "20260629", "2026-W27-1", "2026W271", "2026-W27", "2026W27", "2026-W53-7", "2026-W54-1",
         "2026-02-29", "2024-02-29", "0000-01-01", "2026-13-01", "2026-6-29", "2026", "", "2026-W27-8", "2026-W00-1"]
SEPARATORS = ["T", " ", "x", "\n", "t"]
TIMES = ["12", "12:34", "12:34:56", "1234", "123456", "12:34:56.7", "12:34:56,123456789", "123456.25", "24:00:00",
         "12:60", "12:34:60", "12:3456", "1234:56", "12:34:56.", "23:59:59.999999", "1", ""]
ZONES = ["", "Z", "z", "+02:00", "-0330", "+05", "+23:59:59.5", "+24:00", "-00:00", "+00:75", "+1", "+05:3000", "ZZ"]


def expected(text):
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        return None
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def test_iso_texts_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    texts = set(DATES) | {"not-a-timestamp", "T12:00", " 2026-06-29", "2026-06-29T12:00:00Z\n", "2026-06-29T"}
    for _ in range(1500):
        texts.add(rng.choice(DATES[:10]) + rng.choice(SEPARATORS) + rng.choice(TIMES) + rng.choice(ZONES))
    frame = spark.createDataFrame([(text,) for text in sorted(texts)], "text STRING")
    parsed = frame.select("text", parse_iso_utc(F.col("text")).cast("timestamp_ntz").alias("parsed")).collect()
    # The library also takes a point without digits before a zone, which no ISO text has.
    wrong = [
        (row.text, row.parsed, expected(row.text))
        for row in parsed
        if row.parsed != expected(row.text) and not re.search(r"\.[Z+-]", row.text)
    ]
    assert wrong == []


def test_iso_text_round_trip(spark):
    frame = spark.createDataFrame([(datetime(2026, 6, 29, 12, 0, 0),), (datetime(2026, 6, 29, 12, 0, 0, 120),)], "t TIMESTAMP_NTZ")
    rows = frame.select(iso_text(F.col("t").cast("timestamp")).alias("s")).collect()
    assert [row.s for row in rows] == ["2026-06-29T12:00:00+00:00", "2026-06-29T12:00:00.000120+00:00"]


def window_of(text):
    text = text.strip()
    try:
        seconds = int(text[:-1]) * 60 if text.endswith("m") else int(text[:-1]) * 3600 if text.endswith("h") else int(text)
    except ValueError:
        return None
    return seconds if seconds > 0 else None


def test_window_texts(spark):
    texts = ["1m", "5m", "1h", "90", " 10 ", "2 h", "+3m", "1_0m", "0", "-5m", "", "m", "1d", "1.5h", "5M", "1__0", "_1", "1 0", "٣m"]
    frame = spark.createDataFrame([(text,) for text in texts], "text STRING")
    rows = frame.select("text", window_seconds(F.col("text")).alias("seconds")).collect()
    ascii_only = {row.text: row.seconds for row in rows if row.text.isascii()}
    assert ascii_only == {text: window_of(text) for text in texts if text.isascii()}
