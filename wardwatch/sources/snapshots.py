"""State snapshots (S6, O5): numbered versions that are never written over.

The tables of a version go to a folder of their own and its commit row is written last, so a version without a
commit is not seen and a version that is being read stays. ``remove_versions`` is the only thing that deletes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwatch.functions.timeline import as_of_literal
from wardwatch.operators.recovery import STATE_TABLES, State

STATE_DDL = {
    "device_last": "device_id STRING, last_heartbeat_ts TIMESTAMP, handled_at TIMESTAMP",
    "device_beats": "device_id STRING, ts TIMESTAMP",
    "room_presence": "room_id STRING, ts TIMESTAMP, in_room BOOLEAN, received_at TIMESTAMP, seq BIGINT",
    "room_transitions": "room_id STRING, ts TIMESTAMP, in_room BOOLEAN, handled_at TIMESTAMP",
}
_COMMIT_DDL = "version BIGINT, place STRING, tables STRING, snapshot_ts TIMESTAMP, writer STRING"


@dataclass(frozen=True)
class Snapshot:
    version: int
    snapshot_ts: datetime
    writer: str
    state: State


def _commit(spark: SparkSession, folder: str, version: int, place: str, names: list[str], snapshot_ts, writer: str) -> None:
    row = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"),
        F.lit(place).alias("place"),
        F.lit(",".join(names)).alias("tables"),
        as_of_literal(snapshot_ts).alias("snapshot_ts"),
        F.lit(writer).alias("writer"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMIT_DDL).parquet(f"{folder}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT_DDL)


def write_snapshot(state: State, folder: str, version: int, snapshot_ts, writer: str = "") -> None:
    """Write one version of the tables in ``state``; of equal numbers the last one committed holds."""
    names = [name for name in STATE_TABLES if name in state]
    spark = state[names[0]].sparkSession
    place = f"v{version:012d}-{uuid.uuid4().hex}"
    for name in names:
        state[name].write.parquet(f"{folder}/{place}/{name}")
    _commit(spark, folder, version, place, names, snapshot_ts, writer)


def read_latest(spark: SparkSession, folder: str, before: int | None = None) -> Snapshot | None:
    """The newest committed version, optionally older than ``before``; None when there is none."""
    commits = _commits(spark, folder)
    if before is not None:
        commits = commits.where(F.col("version") < before)
    stamp = F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp")
    row = commits.agg(F.max(F.struct("version", stamp, "writer", "place", "tables"))).first()[0]
    if row is None:
        return None
    state = {name: spark.read.schema(STATE_DDL[name]).parquet(f"{folder}/{row['place']}/{name}") for name in row["tables"].split(",")}
    return Snapshot(row["version"], datetime.strptime(row["stamp"], "%Y-%m-%d %H:%M:%S.%f"), row["writer"], state)


def remove_versions(spark: SparkSession, folder: str, before: int) -> int:
    """Delete the tables and commits of versions older than ``before``; the newest version always stays.

    Call it when no reader uses them. Returns how many versions went.
    """
    latest = read_latest(spark, folder)
    if latest is None:
        return 0
    old = _commits(spark, folder).where(F.col("version") < min(before, latest.version))
    # One row per version that goes.
    gone = old.select("place", F.col("_metadata.file_path").alias("file")).collect()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in gone:
        for place in (row["file"], f"{folder}/{row['place']}"):
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(conf).delete(path, True)
    return len(gone)
