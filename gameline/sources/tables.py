"""Pruned table reads and calendars."""

from __future__ import annotations

import calendar
import datetime as dt
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.operators.filters import in_dates


def read_range(df: DataFrame, start: str, end: str, columns: list[str]) -> DataFrame:
    """Columns of the rows of a date range; both reach the scan."""
    return in_dates(df, start, end).select("game_id", "game_date", *[c for c in columns if c not in ("game_id", "game_date")])


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a run's table under spark.checkpoint.dir, which all executors share. Where that is unset, a local
    session uses a temporary folder, and on a cluster it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/gameline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once under spark.checkpoint.dir and read again: what follows neither computes it anew nor depends on
    the executors that made it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession, paths: list[str], megabytes: int = 4) -> int | None:
    """Lets the session's shuffles begin with a partition for every few megabytes of the inputs, so that a task's share does
    not grow with them; adaptive execution joins those that turn out small. Where spark.sql.shuffle.partitions is as large
    already, that holds. Returns the number that was set."""
    hadoop, name = spark._jvm.org.apache.hadoop.fs, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    size = 0
    for p in map(hadoop.Path, paths):
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        size += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    n = math.ceil(size / (megabytes << 20))
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.unset(name)
        return None
    spark.conf.set(name, str(n))
    return n


def month_ranges(season: int, first: int = 3, last: int = 11, season_end: str | None = None) -> list[tuple[str, str]]:
    """First and last day of each month from March to November, cut at the season's end."""
    end = min(dt.date(season, last, calendar.monthrange(season, last)[1]), dt.date(season, 11, 30),
        dt.date.fromisoformat(season_end) if season_end else dt.date.max)
    out = []
    for m in range(max(first, 3), last + 1):
        a, b = dt.date(season, m, 1), dt.date(season, m, calendar.monthrange(season, m)[1])
        if a <= end:
            out.append((a.isoformat(), min(b, end).isoformat()))
    return out
