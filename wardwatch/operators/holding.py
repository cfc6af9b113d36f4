"""Windows that open with an arrival: the first arrival opens one, and the next opens when the hold of the last is over.

Which arrivals open a window depends on all before, but the way from one opening to the next does not: it leads to
the first arrival at least ``hold`` later, which lies in the next time bucket of that length or is the first of the one after. So each arrival has one link,
found inside (key, bucket), and an arrival that follows a gap of ``hold`` opens a window whatever came before. The openings
are what is reachable from those over the links, composed by doubling: after k rounds a link skips 2**k openings.
Rows of a key are spread over its buckets, and nothing gathers a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from wardwatch.schema import MICROS
from wardwatch.session import new_table_path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again."""
    path = new_table_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _steps(arrivals: DataFrame, keys: Sequence[str], hold: int) -> DataFrame:
    """(keys, t, n): with ``n`` null an arrival that opens a window whatever came before, else the link from ``t`` to ``n``.

    One exchange by (key, bucket) answers both. Links to an arrival that opens a window anyway are left out.
    """
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    data = arrivals.where(known).select(*keys, "t", F.floor(F.col("t") / hold).alias("c"))
    own, end, behind = F.lit(0), F.lit(1), F.lit(2)
    places = F.array(
        F.struct(F.col("t"), F.col("c"), own.alias("kind")),
        F.struct((F.col("t") + hold).alias("t"), (F.col("c") + 1).alias("c"), end.alias("kind")),
    )
    rows = data.select(*keys, F.explode(places).alias("p")).select(*keys, "p.*")
    # The first arrival of the next bucket stands behind all of this one.
    first = data.groupBy(*keys, "c").agg(F.min("t").alias("t"))
    rows = rows.unionByName(first.select(*keys, "t", (F.col("c") - 1).alias("c"), behind.alias("kind")))
    bucket = Window.partitionBy(*keys, "c")
    later = bucket.orderBy(F.col("t").desc(), (F.col("kind") == end).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t, n = F.col("t"), F.col("n")
    rows = rows.select(
        *keys,
        "t",
        "kind",
        F.min(F.when(F.col("kind") != end, t)).over(later).alias("n"),
        F.min(F.when(F.col("kind") == own, t)).over(bucket).alias("first"),
        F.max(F.when(F.col("kind") == own, t)).over(bucket).alias("last"),
        F.max(F.when(F.col("kind") == end, t)).over(bucket).alias("until"),
        F.max(F.when(F.col("kind") == behind, t)).over(bucket).alias("next"),
    )
    # After a gap: nothing earlier in the bucket, and no window that began in the bucket before reaches beyond it.
    gap = F.col("until").isNull() | (F.col("until") <= F.col("first"))
    free = (F.col("kind") == own) & t.eqNullSafe(F.col("first")) & F.coalesce(gap, F.lit(True))
    to_free = (n.eqNullSafe(F.col("first")) & gap) | (n.eqNullSafe(F.col("next")) & (F.col("last").isNull() | (F.col("last") + hold <= n)))
    link = (F.col("kind") == end) & n.isNotNull() & ~to_free
    return rows.where(free | link).select(*keys, F.when(link, t - hold).otherwise(t).alias("t"), F.when(link, n).alias("n"))


def openings(arrivals: DataFrame, keys: Sequence[str], hold: int) -> DataFrame:
    """(keys, t) of the arrivals that open a window. ``arrivals`` has distinct rows (keys, t), t in whole units of ``hold``.

    A window covers t to t + hold; an arrival exactly at its end opens the next. Keys are compared as joins do, so null keys are left out.
    Links and each round are written to the shared folder, so that no round plans the ones before again.
    """
    keys = list(keys)
    steps = stored(_steps(arrivals, keys, hold), "steps")
    found = steps.where("n is null").select(*keys, "t")
    links = steps.where("n is not null")
    # Each opening follows one other at most, so a round finds no opening twice.
    while not links.isEmpty():
        further = stored(found.join(links, [*keys, "t"]).select(*keys, F.col("n").alias("t")), "openings")
        if further.isEmpty():
            break
        found = found.unionByName(further)
        above = links.select(*keys, F.col("t").alias("n"), F.col("n").alias("m"))
        links = stored(links.join(above, [*keys, "n"]).select(*keys, "t", F.col("m").alias("n")), "links")
    return found.distinct()


def released(rows: DataFrame, keys: Sequence[str], hold_seconds: float, time: str = "received_at") -> DataFrame:
    """Rows with ``released_at``: the end of the window, of the key's arrivals, that holds the row.

    A row waits at most ``hold_seconds``; sorted by ``released_at`` and then by any order, rows that arrive out of order within a window come
    out in order. Rows whose key or time is null are released when they arrive.
    """
    keys, hold = list(keys), round(hold_seconds * MICROS)
    rows = rows.withColumn("_t", F.unix_micros(time))
    opened = openings(rows.select(*keys, F.col("_t").alias("t")).distinct(), keys, hold)
    # A window lies in the bucket where it opens and the next one, and each bucket has two windows at most.
    c = F.floor(F.col("t") / hold)
    opened = opened.select(*keys, F.col("t").alias("_open"), F.explode(F.array(c, c + 1)).alias("_c"))
    sliced = rows.withColumn("_c", F.floor(F.col("_t") / hold))
    same = [sliced[k] == opened[k] for k in (*keys, "_c")]
    inside = (opened["_open"] <= sliced["_t"]) & (sliced["_t"] < opened["_open"] + hold)
    end = F.when(opened["_open"].isNotNull(), F.timestamp_micros(opened["_open"] + hold)).otherwise(sliced[time])
    on = reduce(lambda x, y: x & y, [*same, inside])
    return sliced.join(opened, on, "left").select(*[sliced[n] for n in rows.columns if n != "_t"], end.alias("released_at"))
