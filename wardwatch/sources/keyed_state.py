"""Keyed state in buckets: versions that name the files of each bucket, so a batch reads and writes only the buckets of its keys.

The rows of a table go to ``files/<update>/<table>/bucket=<n>``, and a version is a small table of (table, bucket, place). A new version takes
the places of the one before; those of the touched buckets are replaced or, for rows that only ever add, joined by a new one. Files are never written
over. The version is written last and names its writer, so an update without one is not seen and a repeated batch can be told.
Only the list of places comes to the driver: one entry per table and bucket, whatever the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.session import shared_files

BUCKETS = 64
#: Places of a bucket from which an addition puts them into one.
MOST_PLACES = 8
_DDL = "version BIGINT, writer STRING, stamp STRING, table STRING, bucket BIGINT, place STRING"


@dataclass(frozen=True)
class Version:
    number: int
    writer: str
    #: Any text of the writer, such as a time.
    stamp: str
    places: dict[tuple[str, int], tuple[str, ...]] = field(repr=False)

    def read(self, spark: SparkSession, table: str, ddl: str, only: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets."""
        chosen = None if only is None else set(only)
        places = sorted(p for (t, b), ps in self.places.items() if t == table and (chosen is None or b in chosen) for p in ps)
        return spark.read.schema(ddl).parquet(*places) if places else spark.createDataFrame([], ddl)


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def touched(frame: DataFrame) -> list[int]:
    """The buckets that occur in the column ``bucket``."""
    return sorted(r["bucket"] for r in frame.select("bucket").distinct().collect())


def latest(spark: SparkSession, folder: str) -> Version | None:
    """The newest version; of equal numbers the one finished last. Reads that version's file alone."""
    done = shared_files(spark, f"{folder}/versions/*/_SUCCESS")
    if not done:
        return None
    path = max(done, key=lambda f: (f.path.rsplit("/", 2)[1].split("-")[0], f.modified)).path.removesuffix("/_SUCCESS")
    rows = spark.read.schema(_DDL).parquet(path).collect()
    places: dict[tuple[str, int], list[str]] = {}
    for row in rows:
        if row["table"]:
            places.setdefault((row["table"], row["bucket"]), []).append(row["place"])
    return Version(rows[0]["version"], rows[0]["writer"], rows[0]["stamp"], {k: tuple(v) for k, v in places.items()})


def written(spark: SparkSession, folder: str, table: str, frame: DataFrame) -> dict[int, str]:
    """Write rows with a column ``bucket``; the place of each bucket that has rows."""
    base = f"{folder}/files/{uuid.uuid4().hex}/{table}"
    frame.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(base)
    return {int(f.path.rsplit("=", 1)[1]): f.path for f in shared_files(spark, f"{base}/bucket=*")}


def replaced(previous: Version | None, table: str, buckets: Iterable[int], places: dict[int, str]) -> dict[tuple[str, int], tuple[str, ...]]:
    """Places of a table with those of ``buckets`` replaced."""
    gone = set(buckets)
    out = {k: v for k, v in (previous.places if previous else {}).items() if k[0] == table and k[1] not in gone}
    return out | {(table, b): (p,) for b, p in places.items()}


def added(previous: Version | None, table: str, places: dict[int, str]) -> dict[tuple[str, int], tuple[str, ...]]:
    """Places of a table with one more in each bucket of ``places``."""
    out = {k: v for k, v in (previous.places if previous else {}).items() if k[0] == table}
    for b, p in places.items():
        out[table, b] = (*out.get((table, b), ()), p)
    return out


def crowded(places: dict[tuple[str, int], tuple[str, ...]]) -> list[int]:
    return sorted(b for (_, b), ps in places.items() if len(ps) >= MOST_PLACES)


def commit(
    spark: SparkSession, folder: str, previous: Version | None, writer: str, stamp: str, places: dict[tuple[str, int], tuple[str, ...]]
) -> Version:
    """The next version, with the given places and no others."""
    number = previous.number + 1 if previous else 0
    rows = [(number, writer, stamp, t, b, p) for (t, b), ps in sorted(places.items()) for p in ps] or [(number, writer, stamp, "", -1, "")]
    spark.createDataFrame(rows, _DDL).coalesce(1).write.parquet(f"{folder}/versions/{number:012d}-{uuid.uuid4().hex}")
    return Version(number, writer, stamp, places)


def remove_versions(spark: SparkSession, folder: str, before: int) -> int:
    """Delete versions older than ``before`` with the files that no later one names; the newest stays. Returns how many went.

    Call it when no reader uses them and no job writes.
    """
    newest = latest(spark, folder)
    if newest is None:
        return 0
    every = [f.path.removesuffix("/_SUCCESS") for f in shared_files(spark, f"{folder}/versions/*/_SUCCESS")]
    old = [p for p in every if int(p.rsplit("/", 1)[1].split("-")[0]) < min(before, newest.number)]
    if not old:
        return 0
    named = lambda paths: {r["place"] for r in spark.read.schema(_DDL).parquet(*paths).select("place").distinct().collect()}
    unused = named(old) - named([p for p in every if p not in old])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for place in [*old, *(p for p in unused if p)]:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)
    return len(old)
