"""Tables in storage: merges that touch few partitions, first-wins inserts, clustered appends, ordered files, buckets.

A table is a folder of Parquet files, partitioned by one column. A merge reads and writes only the partitions that its
updates fall into; Spark replaces these when all files of the job are written, and the files of the others stay as they
are. Two jobs must not change the same partitions at once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from gameline.operators.sinks import first_rows, update, upsert
from gameline.sources.tables import scratch, stored


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table with the columns of schema; files written before a column was added give nulls."""
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str, partition: str, *order: str) -> None:
    """Adds rows; nothing that is there changes. Rows meet by partition before the write, so that a partition gets one
    file of each append, and one more for each further advisory size of its rows (adaptive execution splits large
    ones); files are sorted by order."""
    df.hint("rebalance", F.col(partition)).sortWithinPartitions(partition, *order).write.mode("append").partitionBy(partition).parquet(path)


def partitions_of(df: DataFrame, partition: str) -> list:
    """The distinct partition values of a batch: as many as the partitions that it touches."""
    return sorted(r[0] for r in df.select(partition).where(F.col(partition).isNotNull()).distinct().collect())


def _within(df: DataFrame, partition: str, values: list) -> DataFrame:
    return df.where(F.col(partition).isin(values))  # literals, so that the scan lists no other partition


def _replace(df: DataFrame, path: str, partition: str, values: list) -> None:
    """Writes the partitions that df has rows of, in place of what they held."""
    df.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _replace_and_empty(df: DataFrame, path: str, partition: str, values: list) -> None:
    """The same; partitions of values that are left without rows are deleted, which a dynamic overwrite does not do."""
    spark = df.sparkSession
    done = stored(df, "merged")
    _replace(done, path, partition, values)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in set(values) - set(partitions_of(done, partition)):
        fs.delete(hadoop.Path(f"{path.rstrip('/')}/{partition}={v}"), True)


def merge(spark: SparkSession, path: str, schema: StructType, updates: DataFrame, keys: list[str], partition: str, columns: list[str] | None = None,
    insert: bool = True, moves: bool = False) -> StructType:
    """Merges updates (unique keys) into the table: rows of known keys get the listed columns (all of the updates by
    default), nulls too; with insert, other keys are added; without, they are ignored and columns that the table lacks
    are added to it. Returns the table's schema from now on. A null partition value is an error.

    A key has to keep its partition, unless moves is set: then the keys' partitions are looked up first (a scan of
    those columns), and a row whose partition changes leaves its old one."""
    updates = stored(updates, "updates")
    if not updates.where(F.col(partition).isNull()).isEmpty():
        raise ValueError(f"updates without {partition}")
    target = read(spark, path, schema)
    values = partitions_of(updates, partition)
    if moves:
        old = target.select(*keys, partition).join(updates.select(*keys), keys, "left_semi")
        values = sorted({*values, *partitions_of(old, partition)})
    if not values:
        return schema
    held = _within(target, partition, values)
    changed = [c for c in (columns or updates.columns) if c not in keys and c != partition] + [partition] * (moves and partition not in keys)
    out = upsert(held, updates, keys, changed) if insert else update(held, updates.select(*keys, *changed), keys)
    (_replace_and_empty if moves else _replace)(out, path, partition, values)
    return StructType([f for f in out.schema.fields if f.name != partition] + [out.schema[partition]])


def insert_first(spark: SparkSession, path: str, schema: StructType, batch: DataFrame, key: str, order: list[str], partition: str) -> None:
    """Appends the first row of each key that the table lacks. Only the batch's partitions of the table are compared, as
    a key has its partition in it. Columns that only order the batch are not stored."""
    rows = first_rows(batch, key, order)
    held = _within(read(spark, path, schema).select(key, partition), partition, partitions_of(batch, partition))
    append(rows.join(held.select(key), key, "left_anti").select(*[f.name for f in schema.fields]), path, partition, key)


def latest_version(table: DataFrame, keys: list[str], version: str, within: Column | None = None) -> DataFrame:
    """Each key's row of the latest version; within, a filter on the partition column, prunes the read."""
    t = table if within is None else table.where(within)
    rest = [c for c in t.columns if c not in keys]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row")).select(*keys, "row.*").select(*t.columns)


def write_in_order(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """Files that follow one another in order: ranges of it, cut at sampled quantiles, are written by a task each, and
    each file is sorted. Without nulls in order, no two files overlap."""
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int = 16) -> DataFrame:
    """df as a table in buckets of key, sorted by it: joins and groupings by key read it without a shuffle. One file a
    bucket, as rows are dealt by key before the write. The files are in spark.checkpoint.dir, like other tables that a
    run makes; the catalog knows the table by a name of its own."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
    writer.option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)


def landed(events: DataFrame) -> DataFrame:
    """(raw_key, raw): each distinct document once; rows made from it carry its key. Combined before the shuffle."""
    return events.groupBy("raw_key").agg(F.min("raw").alias("raw"))


def add_days(spark: SparkSession, path: str, daily: DataFrame, entity: str) -> None:
    """Adds an entity's daily sums to a table partitioned by month. Days that it has already are replaced, so that a
    load can be repeated; other months are neither read nor written. A batch has to hold its days whole."""
    rows = daily.withColumn("month", F.trunc("game_date", "month"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        merge(spark, path, rows.schema, rows, [entity, "game_date"], "month")
    else:
        append(rows, path, "month", entity, "game_date")


def days_for(spark: SparkSession, path: str, schema: StructType, start: str, end: str, days: int = 365) -> DataFrame:
    """The daily sums that rollups of [start, end] need: those days and the days - 1 before them, with months pruned by
    the partition filter."""
    low, high = F.date_sub(F.lit(start).cast("date"), days - 1), F.lit(end).cast("date")
    kept = read(spark, path, StructType([*schema.fields, StructField("month", DateType())]))
    return kept.where(F.col("month").between(F.trunc(low, "month"), F.trunc(high, "month")) & F.col("game_date").between(low, high)).drop("month")
