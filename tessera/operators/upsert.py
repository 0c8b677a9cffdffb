"""Upserts and deletes on tables without a lakehouse format: the new snapshot of a table as a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.changes import last_by_sequence
from tessera.operators.graph import node_label
from tessera.staging import small_enough

EDGE = ["source_id", "target_id", "predicate"]


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of the same key; of several new rows the one with the highest ``sequence`` stays."""
    if sequence:
        new = last_by_sequence(new, keys, sequence)
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_edges(existing: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """All edges of ``sources(source_id)`` are replaced by ``new``; a source without new edges loses its old ones."""
    return delete_keys(existing, sources, ["source_id"]).unionByName(new.dropDuplicates(EDGE))


def purge_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those that begin or end at ``nodes(id)``."""
    out = edges.join(nodes.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti")
    return out.join(nodes.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_anti").select(*edges.columns)


def delete_by_file(nodes: DataFrame, edges: DataFrame, paths: DataFrame, column: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``paths``, and edges without those that touch them."""
    gone = nodes.join(paths.select(column).distinct(), column, "left_semi").select("id")
    return delete_keys(nodes, gone, ["id"]), purge_nodes(edges, gone)


def with_placeholders(nodes: DataFrame, edges: DataFrame, label: str = "Concept") -> DataFrame:
    """Nodes and, for every edge target without node, an empty node."""
    missing = edges.select(F.col("target_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(missing.withColumn("label", F.lit(label)), allowMissingColumns=True)


def linkable(edges: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Edges with a known predicate (as ``rel_type``) whose two ends are nodes, each once."""
    ends = lambda c: nodes.select(F.col("id").alias(c)).distinct()
    if small_enough(predicates, 10_000):
        predicates = F.broadcast(predicates)
    return edges.join(predicates, "predicate").join(ends("source_id"), "source_id", "left_semi").join(ends("target_id"), "target_id", "left_semi").select("source_id", "target_id", "rel_type").distinct()


def graph_node_rows(objects: DataFrame) -> DataFrame:
    """(id, label and the properties of a node) of each object of the compiler."""
    return objects.select("id", node_label(F.col("type")).alias("label"), "name", "type", "domain", "source_file", "level_1", "level_2", "level_3", "ontology_class", "ontology_depth")


def sync_objects(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, links: DataFrame, predicates: DataFrame, keep_inbound: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the objects ``new_nodes`` with their ``links`` have replaced what was there of them.

    Their old outgoing edges go, with ``keep_inbound=False`` also those that others have to them. Targets that are no
    nodes get placeholders, so every link with a known predicate is kept. ``edges`` has (source_id, target_id, rel_type).
    """
    ids = new_nodes.select("id").distinct()
    left = delete_keys(edges, ids.withColumnRenamed("id", "source_id"), ["source_id"]) if keep_inbound else purge_nodes(edges, ids)
    wanted = links.join(predicates, "predicate", "left_semi")
    after = with_placeholders(upsert(nodes, new_nodes, ["id"]), wanted)
    return after, left.unionByName(linkable(links, after, predicates)).distinct()


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, with their counts: the check of a unique constraint."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
