"""The edge graph: hubs, export, degrees, neighbourhoods."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage

# Relation types of the predicates; the viewer's threshold and sizes.
RELATION_TYPES = {"is_a": "IS_A", "part_of": "PART_OF", "depends_on": "DEPENDS_ON", "example_of": "EXAMPLE_OF", "extends": "EXTENDS", "uses": "USES", "optimized_by": "OPTIMIZED_BY"}
NODE_LABELS = {"concept": "Concept", "implementation": "File", "reference": "Concept"}
HUB_INBOUND, MIN_RADIUS, RADIUS_STEP, MAX_RADIUS = 3, 4, 2, 20


def node_label(object_type):
    label = F.lit("Concept")
    for name, value in NODE_LABELS.items():
        label = F.when(object_type == name, F.lit(value)).otherwise(label)
    return label


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each triple once; edges without an end are none."""
    return edges.where("source_id is not null and target_id is not null").select("source_id", "target_id", "predicate").distinct()


def one_per_object(doc_meta: DataFrame) -> DataFrame:
    """(object_id, name, file_path, domain), the smallest row of each id."""
    row = F.struct("name", "file_path", "domain")
    return doc_meta.where("object_id is not null").groupBy("object_id").agg(F.min(row).alias("m")).select("object_id", "m.name", "m.file_path", "m.domain")


def hubs(edges: DataFrame, doc_meta: DataFrame, limit: int = 20) -> DataFrame:
    """(id, name, file_path, domain, inbound) of the most referenced objects, dangling ones included; ties by id.

    Counted and cut first, so only ``limit`` rows meet the objects.
    """
    inbound = distinct_edges(edges).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("inbound"))
    top = inbound.orderBy(F.desc("inbound"), "id").limit(limit)
    meta = one_per_object(doc_meta.join(F.broadcast(top.select(F.col("id").alias("object_id"))), "object_id", "left_semi"))
    joined = top.join(meta.withColumnRenamed("object_id", "id"), "id", "left")
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("id"))
    return joined.select("id", name.alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("domain", F.lit("")).alias("domain"), "inbound").orderBy(F.desc("inbound"), "id")


def graph_nodes(edges: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """(id, name, file_path, domain): all objects and a placeholder for every other end of an edge."""
    known = one_per_object(doc_meta).withColumnRenamed("object_id", "id")
    ends = distinct_edges(edges).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    missing = ends.join(known.select("id"), "id", "left_anti").select("id", F.col("id").alias("name"), F.lit("").alias("file_path"), F.lit("").alias("domain"))
    return known.unionByName(missing)


def closed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are ``nodes(id)``."""
    ids = nodes.select("id").distinct()
    return distinct_edges(edges).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "predicate")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, inbound, outbound, is_hub, radius) of every node with an edge."""
    ends = distinct_edges(edges).select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counted = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("inbound"), F.sum("e.o").alias("outbound"))
    return counted.withColumns({"is_hub": F.col("inbound") >= HUB_INBOUND, "radius": F.least(MIN_RADIUS + RADIUS_STEP * F.col("inbound"), F.lit(MAX_RADIUS))})


def neighbourhood(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """(source, path_nodes, path_rels) of every path of one to ``hops`` (1 to 5) edges from ``start``, in either direction.

    An edge occurs once in a path, a node may return. A start without edges gives one row with null paths.
    Each step joins the paths with the edges at their end; only edges that a path can reach are read again.
    """
    hops = max(1, min(int(hops), 5))
    rel = F.lit(None).cast("string")
    for predicate, name in RELATION_TYPES.items():
        rel = F.when(F.col("predicate") == predicate, F.lit(name)).otherwise(rel)
    # staged, as every hop joins with all of them
    links = stage(distinct_edges(edges).withColumn("rel", rel).where("rel is not null").select("source_id", "target_id", "rel").distinct(), "links")
    links = links.withColumn("edge", F.struct("source_id", "rel", "target_id"))
    out = links.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "rel", "edge")
    back = links.where("source_id <> target_id").select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "rel", "edge")
    steps = out.unionByName(back)
    frontier = steps.where(F.col("here") == start).select(F.array("here", "there").alias("path_nodes"), F.array("rel").alias("path_rels"), F.array("edge").alias("used"), F.col("there").alias("last"))
    # a start without a first step has no path at all: the paths themselves are never broadcast
    one = edges.sparkSession.createDataFrame([(start,)], "source string")
    alone = one.join(F.broadcast(frontier.select("last").limit(1)), F.lit(True), "left_anti")
    found = frontier
    for _ in range(hops - 1):
        joined = frontier.join(steps, frontier["last"] == steps["here"]).where(~F.array_contains("used", F.col("edge")))
        frontier = joined.select(F.array_append("path_nodes", F.col("there")).alias("path_nodes"), F.array_append("path_rels", F.col("rel")).alias("path_rels"), F.array_append("used", F.col("edge")).alias("used"), F.col("there").alias("last"))
        found = found.unionByName(frontier)
    paths = found.select(F.lit(start).alias("source"), "path_nodes", "path_rels")
    return paths.unionByName(alone, allowMissingColumns=True)


def export_json(edges: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """(kind, json) lines of the graph: nodes, then edges."""
    nodes = graph_nodes(edges, doc_meta).select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "name", "file_path", "domain")).alias("json"))
    links = distinct_edges(edges).select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "predicate")).alias("json"))
    return nodes.unionByName(links)


PAGE = """<!doctype html><meta charset="utf-8"><title>Graph</title><style>body{font:14px sans-serif}li b{font-weight:600}</style>
<h1>Graph</h1><p id="n"></p><ol id="hubs"></ol><script>const graph=__GRAPH__;
document.getElementById("n").textContent=graph.nodes.length+" nodes, "+graph.edges.length+" edges";
const inbound={};for(const e of graph.edges)inbound[e.target]=(inbound[e.target]||0)+1;
const names=Object.fromEntries(graph.nodes.map(n=>[n.id,n.name||n.id]));
for(const [id,k] of Object.entries(inbound).sort((a,b)=>b[1]-a[1]).slice(0,10)){const li=document.createElement("li");li.textContent=names[id]+" ("+k+")";document.getElementById("hubs").append(li)}
</script>"""


def export_html(edges: DataFrame, doc_meta: DataFrame, path: str, limit: int = 50_000) -> None:
    """One page with the graph, for graphs of at most ``limit`` nodes and edges (a page is made for eyes and stays on the driver)."""
    rows = export_json(edges, doc_meta).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the graph has more than {limit} nodes and edges; write export_json() to a folder")
    graph = {kind + "s": [json.loads(r["json"]) for r in rows if r["kind"] == kind] for kind in ("node", "edge")}
    Path(path).write_text(PAGE.replace("__GRAPH__", json.dumps(graph).replace("</", "<\\/")), encoding="utf-8")
