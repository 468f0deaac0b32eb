"""Upserts, updates, inserts and appends of keyed tables, as DataFrames that replace the target."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(target: DataFrame, updates: DataFrame, keys: list[str], how: str) -> DataFrame:
    u = updates.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in updates.columns if c not in keys],
        F.lit(True).alias("__hit"))
    t = target.withColumn("__own", F.lit(True))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    return t.join(u, on, how)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """target with updates merged in by unique keys: new keys are added, of known ones only the listed columns (all of
    updates by default) are overwritten, by nulls too."""
    columns = [c for c in (columns or updates.columns) if c not in keys]
    given = set(updates.columns)
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(c, f"__{c}").alias(c))
        elif c in columns:
            out.append(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        elif c in given:  # set on insert only
            out.append(F.when(F.col("__own"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
        else:
            out.append(F.col(c))
    return _joined(target, updates, keys, "full_outer").select(*out)


def update(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of known keys overwritten; new columns are null elsewhere. Never adds rows."""
    new = [c for c in updates.columns if c not in target.columns]
    out = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in updates.columns and c not in keys else F.col(c) for c in target.columns]
    return _joined(target, updates, keys, "left").select(*out, *[F.col(f"__{c}").alias(c) for c in new])


def first_rows(batch: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The first row of each key in the batch's order, which has to be unique within a key; without one, the least row.
    The same whatever task holds which row, and combined before the shuffle."""
    rest = F.struct(*[c for c in batch.columns if c != key])
    first = F.min_by(rest, F.struct(*order)) if order else F.min(rest)
    return batch.groupBy(key).agg(first.alias("row")).select(key, "row.*").select(*batch.columns)


def insert_absent(target: DataFrame, rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """target and the first row of each new key."""
    new = rows.join(target.select(key), key, "left_anti")
    return target.unionByName(first_rows(new, key, order).select(*target.columns))


def stamped(df: DataFrame, as_of: str) -> DataFrame:
    """Rows of one run, for an append keyed by (as_of_ts, game_id)."""
    return df.select(F.lit(as_of).cast("timestamp").alias("as_of_ts"), *df.columns)


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report as one file."""
    getattr(df.coalesce(1).write.mode("overwrite"), kind)(path)


def read_features(text: str) -> list[str]:
    """A feature list kept as a JSON array, a JSON object with features, or lines."""
    try:
        data = json.loads(text)
    except ValueError:
        return [x.strip() for x in text.splitlines() if x.strip()]
    return data["features"] if isinstance(data, dict) else data
