"""Orphan references: keys that point at records which are missing, deleted or arrive later.

Parents are range-partitioned and kept, per range, as one sorted array with aligned attribute
arrays; the distinct references are probed against it in Arrow batches by binary search; misses
are then aggregated per table end and period.

References are reduced to one row per distinct key *before* they meet the parents, so a key that
holds a third of all references is probed once and no range is hot on the reference side. Only keys
that are missing, deleted or possibly late go back to the references.

Defined results: a null or blank key is no reference; keys compare byte for byte; a parent without
a path is always sound; a reference without time is never late and counts under ``unknown``;
duplicate rows give one result row; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import small_enough, stage

#: Parents per range: with its key and two numbers each, a range stays near 32 MB.
RANGE_ROWS = 250_000
#: Border keys are taken from this many parents per range (at most BORDER_LIMIT), the smallest by hash.
BORDER_SAMPLE, BORDER_LIMIT = 200, 100_000
#: Suspect keys up to this number (some 20 MB) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000
NEVER = -(10**12)


def path_states(file_state: DataFrame) -> DataFrame:
    """(file_path, gone, first_seen): whether a path's latest record is DELETED, and its earliest time.

    One pass with map-side combining. Where a path has several records of the latest time, it is
    deleted if any of them says so.
    """
    gone = F.coalesce((F.upper(F.trim("status")) == "DELETED").cast("int"), F.lit(0))
    return (
        file_state.where("file_path is not null")
        .groupBy("file_path")
        .agg(F.max(F.struct(F.coalesce("indexed_at", F.lit(NEVER)).alias("at"), gone.alias("gone"))).alias("last"), F.min("indexed_at").alias("first_seen"))
        .select("file_path", F.col("last.gone").alias("gone"), "first_seen")
    )


def parent_states(doc_meta: DataFrame, file_state: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, gone, first_seen) of every known object; times are epoch seconds.

    One sound origin (no path, no record of the path, or a catalogued concept) makes an object sound;
    an object with several paths is deleted only if all of them are.
    """
    objects = doc_meta.where("object_id is not null").select("object_id", "file_path").distinct()
    found = objects.join(path_states(file_state), "file_path", "left").select(
        F.col("object_id").alias("key"), F.coalesce("gone", F.lit(0)).alias("gone"), F.coalesce("first_seen", F.lit(NEVER)).alias("first_seen")
    )
    concepts = catalog.where("object_id is not null").select(F.col("object_id").alias("key"), F.lit(0).alias("gone"), F.lit(NEVER).alias("first_seen"))
    return found.unionByName(concepts).groupBy("key").agg(F.min("gone").alias("gone"), F.min("first_seen").alias("first_seen"))


def _probe_range(parents: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
    """Binary search of one range's distinct reference keys in the range's sorted parent array."""
    keys = parents["key"].to_numpy(dtype=object)
    order = np.argsort(keys, kind="stable")
    keys, gone, first = keys[order], parents["gone"].to_numpy()[order], parents["first_seen"].to_numpy()[order]
    wanted = refs["key"].to_numpy(dtype=object)
    if not len(keys) or not len(wanted):
        state, seen = np.zeros(len(wanted), "int32"), np.zeros(len(wanted), "int64")
    else:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        hit = keys[at] == wanted
        state, seen = np.where(hit, 1 + gone[at], 0).astype("int32"), np.where(hit, first[at], 0).astype("int64")
    return pd.DataFrame({"key": wanted, "earliest": refs["earliest"].to_numpy(), "state": state, "first_seen": seen})


def probe_parents(refs: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, earliest, state, first_seen) of each row of ``refs(key, earliest)``, keys distinct.

    ``state`` is 0 for a key without parent, 1 for a present and 2 for a deleted parent. Both sides
    take a range number from the same border keys and meet in one co-grouped task per range.
    """
    parents = stage(parents, "parents")
    if ranges is None:
        ranges = parents.count() // RANGE_ROWS + int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r[0] for r in parents.select("key").orderBy(F.xxhash64("key")).limit(min(BORDER_SAMPLE * ranges, BORDER_LIMIT)).collect())
    borders = np.array(sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else [], dtype=object)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, keys.to_numpy(dtype=object), side="right").astype("int32"))

    left = parents.withColumn("range", range_of("key")).groupBy("range")
    right = refs.withColumn("range", range_of("key")).groupBy("range")
    return left.cogroup(right).applyInPandas(_probe_range, "key string, earliest long, state int, first_seen long")


def orphan_references(edges: DataFrame, parents: DataFrame, ends: tuple[str, ...] = ("source_id", "target_id")) -> DataFrame:
    """(end_name, edge_month, reason, source_id, target_id, predicate), distinct, for every unsound end."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', recorded_at)")
    rows = edges.select("source_id", "target_id", "predicate", micros.alias("micros"), F.coalesce(F.date_format("recorded_at", "yyyy-MM"), F.lit("unknown")).alias("edge_month"))
    rows = rows.select("*", F.explode(F.array(*[F.struct(F.lit(e).alias("end_name"), F.col(e).alias("key")) for e in ends])).alias("end")).select("*", "end.end_name", "end.key").drop("end")
    rows = rows.where(F.col("key").rlike(r"[^\s\x{00a0}]"))
    refs = rows.groupBy("key").agg(F.min("micros").alias("earliest"))
    late = (F.col("state") == 1) & F.coalesce(F.col("first_seen") * 1_000_000 > F.col("earliest"), F.lit(False)) & (F.col("first_seen") != NEVER)
    suspects = stage(probe_parents(refs, parents).where((F.col("state") != 1) | late).drop("earliest"), "suspects")
    if small_enough(suspects, BROADCAST_KEYS):
        suspects = F.broadcast(suspects)
    reason = F.when(F.col("state") == 0, "missing").when(F.col("state") == 2, "deleted").when(F.col("first_seen") * 1_000_000 > F.col("micros"), "late")
    return rows.join(suspects, "key").withColumn("reason", reason).where("reason is not null").select("end_name", "edge_month", "reason", "source_id", "target_id", "predicate").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per end, month and reason, with the number of distinct unsound keys."""
    key = F.when(F.col("end_name") == "source_id", F.col("source_id")).otherwise(F.col("target_id"))
    return orphans.groupBy("end_name", "edge_month", "reason").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct(key).alias("n_keys"))
