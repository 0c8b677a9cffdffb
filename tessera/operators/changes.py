"""Change detection between two snapshots of files, and what is counted about a state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, DELETED = "ACTIVE", "DELETED"


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order`` (columns; later wins), with combining before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("_order"), *[F.col(c) for c in rest])).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def snapshot_diff(current: DataFrame, previous: DataFrame, path: str = "path", digest: str = "sha256", compat: bool = False) -> DataFrame:
    """(path, status, current and previous digest): NEW, CHANGED, UNCHANGED or DELETED for every path of either side.

    ``previous`` has a ``status``; a path that was deleted and is there again counts as NEW. ``compat`` makes it
    UNCHANGED or CHANGED by its digest instead. Paths that stay deleted do not come out.
    """
    now = current.select(path, F.col(digest).alias("digest"))
    before = previous.select(path, F.col(digest).alias("old_digest"), (F.upper("status") == DELETED).alias("was_deleted"))
    both = now.join(before, path, "full_outer")
    gone = F.coalesce("was_deleted", F.lit(False))
    known = F.col("old_digest").isNotNull() if compat else F.col("old_digest").isNotNull() & ~gone
    status = (
        F.when(F.col("digest").isNull() & ~gone, DELETED)
        .when(F.col("digest").isNull(), None)
        .when(~known, "NEW")
        .when(F.col("digest") == F.col("old_digest"), "UNCHANGED")
        .otherwise("CHANGED")
    )
    return both.withColumn("status", status).where("status is not null").select(path, "status", "digest", "old_digest")


def changed_files(diff: DataFrame) -> DataFrame:
    return diff.where("status in ('NEW', 'CHANGED')")


def deleted_paths(current: DataFrame, previous: DataFrame, path: str = "path") -> DataFrame:
    return previous.where(F.upper("status") != DELETED).select(path).distinct().join(current.select(path), path, "left_anti")


def next_state(diff: DataFrame, current: DataFrame, previous: DataFrame, now: int, path: str = "path") -> DataFrame:
    """The state after a diff: seen paths ACTIVE (indexed_at new if they changed), missing ones DELETED."""
    seen = current.join(diff.where("status <> 'DELETED'").select(path, F.col("status").alias("_change")), path)
    old = previous.select(path, F.col("indexed_at").alias("_before"))
    kept = F.when(F.col("_change") == "UNCHANGED", F.coalesce("_before", F.lit(now))).otherwise(F.lit(now))
    seen = seen.join(old, path, "left").select(path, "sha256", "last_modified", "file_type", kept.cast("long").alias("indexed_at"), F.lit(ACTIVE).alias("status"))
    gone = previous.join(current.select(path), path, "left_anti").select(path, "sha256", "last_modified", "file_type", "indexed_at", F.lit(DELETED).alias("status"))
    return seen.unionByName(gone)


def status_counts(state: DataFrame) -> DataFrame:
    """One row: all, active and deleted; the last two are null on an empty table."""
    is_ = lambda s: F.sum(F.when(F.upper(F.trim("status")) == s, 1).otherwise(0))
    return state.agg(F.count(F.lit(1)).alias("total"), is_(ACTIVE).alias("active"), is_(DELETED).alias("deleted"))


def content_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(sha256, n, first_key) of contents that occur more than once."""
    hashed = df.where(F.col(text).isNotNull()).select(F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("sha256"), F.col(key).alias("key"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key")).where("n > 1")


def last_by_sequence(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """``latest`` for rows whose columns are not all comparable (maps): a window instead of a maximum."""
    order = Window.partitionBy(*keys).orderBy(F.col(sequence).desc())
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
