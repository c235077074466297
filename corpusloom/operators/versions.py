"""Histories: the latest version, a version by name, conflicts, merged listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def history(versions: DataFrame, limit: int = 20) -> DataFrame:
    """The newest versions of each path (1 to 100)."""
    n = max(1, min(limit, 100))
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("id"))
    return versions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each path; an aggregate with partial results, so a hot path is no burden."""
    m = versions.groupBy("path").agg(F.max_by(F.struct("id", "ts", "content"), F.struct("ts", "id")).alias("v"))
    return m.select("path", "v.id", "v.ts", "v.content")


def version_at(versions: DataFrame, path, sha: str) -> DataFrame:
    return versions.where((F.col("path") == path) & (F.substring(F.sha1(F.col("content").cast("binary")), 1, len(sha)) == sha))


def conflicts(writes: DataFrame) -> DataFrame:
    """Writes whose path changed after the version they were read from: (id, path, base_id, last_id)."""
    w = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("last_id", F.max("id").over(w)).where("last_id > base_id").select("id", "path", "base_id", "last_id")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Listings (path, size): of a path in both the second counts."""
    return base.join(over.select("path"), "path", "left_anti").unionByName(over)
