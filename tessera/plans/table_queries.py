"""Queries of change detection, upserts, the graph, the ontology, vectors and keyword search, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes, compile, graph, ontology, search, upsert, vectors
from tessera.plans.text_queries import STRIP, TERMS
from tessera.staging import delete_on_exit, shared_folder, table

#: The previous snapshot of the change queries is what was recorded up to this second.
CUTOFF = 1_700_000_000
QUERY = "packet routing for the certificate 5 packet"
NEAR = [0.1 * ((i * 7) % 11 - 5) for i in range(64)]


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "file_state").where("file_path is not null").select("file_path", "sha256_hash", "indexed_at", "status")
    order = [F.col("indexed_at"), F.upper("status"), F.col("sha256_hash")]
    now = changes.latest(rows, ["file_path"], order).where("upper(status) <> 'DELETED'")
    return now, changes.latest(rows.where(F.col("indexed_at") <= CUTOFF), ["file_path"], order)


def snapshot_diff(spark, folder):
    now, before = _snapshots(spark, folder)
    return changes.snapshot_diff(now, before, "file_path", "sha256_hash").select("file_path", F.col("status").alias("change"))


def deleted_paths(spark, folder):
    now, before = _snapshots(spark, folder)
    return changes.deleted_paths(now, before, "file_path")


def status_counts(spark, folder):
    return changes.status_counts(table(spark, folder, "file_state"))


def content_duplicates(spark, folder):
    return changes.content_duplicates(table(spark, folder, "documents"), "doc_id", "text")


def upsert_last_wins(spark, folder):
    """Events of the first half of the ids, then the others: the last event of each user stays."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    old = changes.last_by_sequence(events.where("event_id % 2 = 0"), ["user_id"], "event_id")
    return upsert.upsert(old, events.where("event_id % 2 = 1"), ["user_id"], "event_id")


def edge_upsert(spark, folder):
    """Edges recorded after the middle of 2024 replace all older edges of their sources."""
    edges = table(spark, folder, "edges").where("source_id is not null")
    new = edges.where("recorded_at >= timestamp_ntz'2024-07-01 00:00:00'").select(*upsert.EDGE)
    old = graph.distinct_edges(edges.where("recorded_at < timestamp_ntz'2024-07-01 00:00:00'"))
    return upsert.replace_edges(old, new.where("target_id is not null"), new.select("source_id"))


def duplicate_objects(spark, folder):
    return upsert.duplicate_keys(table(spark, folder, "doc_meta").where("object_id is not null"), ["object_id"])


def object_lookup(spark, folder):
    from tessera.sources.files import lookup_many

    wanted = [r["id"] for r in hubs(spark, folder).collect()]  # twenty ids
    objects = table(spark, folder, "knowledge_store").select("object_id", "name", "level_1", "level_3")
    return lookup_many(objects.distinct(), wanted)


def linkable_edges(spark, folder):
    nodes = table(spark, folder, "doc_meta").select(F.col("object_id").alias("id")).unionByName(table(spark, folder, "concept_catalog").select(F.col("object_id").alias("id")))
    known = spark.createDataFrame(list(graph.RELATION_TYPES.items()), "predicate string, rel_type string")
    return upsert.linkable(table(spark, folder, "edges"), nodes, known)


def hubs(spark, folder):
    return graph.hubs(table(spark, folder, "edges"), table(spark, folder, "doc_meta"))


def graph_nodes(spark, folder):
    return graph.graph_nodes(table(spark, folder, "edges"), table(spark, folder, "doc_meta"))


def closed_edges(spark, folder):
    return graph.closed_edges(table(spark, folder, "edges"), table(spark, folder, "doc_meta").select(F.col("object_id").alias("id")))


def degrees(spark, folder):
    return graph.degrees(table(spark, folder, "edges")).select("id", F.col("inbound").cast("long").alias("inbound"), F.col("outbound").cast("long").alias("outbound"), "is_hub", F.col("radius").cast("long").alias("radius"))


def neighbourhood(spark, folder):
    """Paths of up to two edges with any ontology predicate around the object that most edges of any kind point to."""
    edges = table(spark, folder, "edges")
    top = graph.hubs(edges, table(spark, folder, "doc_meta"), 1).first()
    paths = graph.neighbourhood(edges, top["id"] if top else "", 2)
    return paths.select("source", F.array_join("path_nodes", " > ").alias("path_nodes"), F.array_join("path_rels", " > ").alias("path_rels"))


def graph_export(spark, folder):
    return graph.export_json(table(spark, folder, "edges"), table(spark, folder, "doc_meta"))


def _links(spark, folder):
    edges = table(spark, folder, "edges").select("source_id", "target_id", "predicate").where("source_id is not null").distinct()
    return edges.withColumn("batch", F.lit("all"))


def _objects(spark, folder):
    meta = table(spark, folder, "doc_meta").where("object_id is not null").select(F.col("object_id").alias("id"), F.coalesce("doc_type", F.lit("")).alias("type")).groupBy("id").agg(F.min("type").alias("type"))
    meta = meta.withColumn("ontology_class", F.when(F.col("type") == "implementation", "Implementation").otherwise("Concept"))
    catalog = table(spark, folder, "concept_catalog").select(F.col("object_id").alias("id"), F.lit("concept").alias("type"), "ontology_class")
    both = meta.unionByName(catalog)
    levels = table(spark, folder, "knowledge_store").groupBy(F.col("object_id").alias("id")).agg(F.max(F.coalesce("level_0", F.lit(""))).alias("level_0"), F.max(F.coalesce("level_2", F.lit(""))).alias("level_2"))
    return both.join(levels, "id", "left").withColumn("batch", F.lit("all"))


def class_check(spark, folder):
    """Classes of the catalog as they are and, to have some to find, the domains of objects taken for classes."""
    catalog = table(spark, folder, "concept_catalog").select(F.col("object_id").alias("id"), "ontology_class", F.lit("all").alias("batch"))
    meta = table(spark, folder, "doc_meta").where("object_id is not null").select(F.col("object_id").alias("id"), F.col("domain").alias("ontology_class"), F.lit("all").alias("batch")).distinct()
    return ontology.invalid_classes(catalog.unionByName(meta)).select("object_id", "rule", "message")


def predicate_check(spark, folder):
    return ontology.invalid_predicates(_links(spark, folder)).select("object_id", "rule", "message")


def type_check(spark, folder):
    return ontology.type_mismatches(_links(spark, folder), _objects(spark, folder)).select("object_id", "rule", "message")


def _catalog_links(spark, folder):
    catalog = table(spark, folder, "concept_catalog").where("parent_id is not null")
    return catalog.select(F.col("object_id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("part_of").alias("predicate"), F.lit("all").alias("batch"))


def cycle_check(spark, folder):
    """Circles in the catalog's hierarchy and the recorded edges together, with each catalogued domain, to have some circles, also below one of its concepts."""
    down = _catalog_links(spark, folder)
    up = down.groupBy(F.col("target_id").alias("source_id")).agg(F.min("source_id").alias("target_id")).select("source_id", "target_id", F.lit("part_of").alias("predicate"), F.lit("all").alias("batch"))
    return ontology.cycles(_links(spark, folder).unionByName(down).unionByName(up)).select("object_id", "rule")


def hierarchy_cycles(spark, folder):
    """Circles in the catalog's hierarchy and the recorded edges together, as they are."""
    return ontology.cycles(_links(spark, folder).unionByName(_catalog_links(spark, folder))).select("object_id", "rule")


def orphan_check(spark, folder):
    return ontology.orphans(_objects(spark, folder), _links(spark, folder)).select("object_id", "rule")


def class_bases(spark, folder):
    return ontology.class_table(spark).select("class", F.col("depth").cast("long").alias("depth"), "parent", "base")


def cosine_top(spark, folder):
    return vectors.cosine_top(table(spark, folder, "embeddings").select("vec_id", "label", "embedding"), "vec_id", "embedding", NEAR).select("vec_id", "label", F.round("score", 6).alias("score"))


def cosine_filtered(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    return vectors.cosine_top(rows, "vec_id", "embedding", NEAR, 5, {"label": 1}).select("vec_id", "label", F.round("score", 6).alias("score"))


def _summaries_and_cache(spark, folder):
    """Summaries of notes, and the vectors of the cache, in which every tenth summary is held as well so that there is something to reuse."""
    texts = table(spark, folder, "knowledge_store").where("object_id is not null").select("object_id", "level_2").distinct()
    cache = table(spark, folder, "embedding_cache").select("content_hash", F.from_json("vector", "array<double>").alias("vector")).where("vector is not null and content_hash is not null")
    held = texts.where("level_2 is not null and length(level_2) % 10 = 3").select(vectors.content_hash(F.col("level_2")).alias("content_hash"), F.array(F.length("level_2").cast("double"), F.lit(0.5)).alias("vector"))
    return texts, cache.unionByName(held).groupBy("content_hash").agg(F.max("vector").alias("vector"))


def embed_misses(spark, folder):
    """The vectors that are added to the cache: one for each distinct summary whose hash it does not hold."""
    texts, cache = _summaries_and_cache(spark, folder)
    return vectors.embed(texts, "object_id", "level_2", cache)[1].select("content_hash", "vector")


def embed_reuse(spark, folder):
    """The vector of every summary, from the cache where it holds one: its length and its first and last value."""
    texts, cache = _summaries_and_cache(spark, folder)
    return vectors.embed(texts, "object_id", "level_2", cache)[0].select(F.col("key").alias("object_id"), F.size("vector").cast("long").alias("n"), F.get("vector", F.lit(0)).alias("first"), F.element_at("vector", -1).alias("last"))


def object_json(spark, folder):
    """The JSON form of the recorded objects, with their edges as relationships."""
    levels = table(spark, folder, "knowledge_store").where("object_id is not null").groupBy("object_id").agg(F.min(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "level_0", "level_1", "level_2", "level_3")])).alias("k"))
    meta = table(spark, folder, "doc_meta").where("object_id is not null").groupBy("object_id").agg(F.min(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("domain", "doc_type", "file_path")])).alias("m"))
    link = F.struct(F.col("target_id").alias("target"), F.coalesce("predicate", F.lit("")).alias("predicate"))
    links = graph.distinct_edges(table(spark, folder, "edges")).groupBy(F.col("source_id").alias("object_id")).agg(F.sort_array(F.collect_list(link)).alias("relationships"))
    rows = levels.join(meta, "object_id").join(links, "object_id", "left")
    none = F.array().cast("array<struct<target:string,predicate:string>>")
    objects = rows.select(
        F.col("object_id").alias("id"), F.col("m.doc_type").alias("type"), "k.name", "m.domain", F.col("m.file_path").alias("source_file"), "k.level_0", "k.level_1", "k.level_2", "k.level_3",
        F.lit("Concept").alias("ontology_class"), F.lit(3).alias("ontology_depth"), F.coalesce("relationships", none).alias("relationships"), F.filter(F.split("k.level_3", "; "), lambda t: t != "").alias("tags"),
    )
    return compile.object_json(objects)


def graph_sync(spark, folder):
    """Nodes of the graph after the objects of the newest edges have been synchronised with it: known ones and placeholders."""
    edges = graph.distinct_edges(table(spark, folder, "edges"))
    meta = table(spark, folder, "doc_meta").where("object_id is not null").groupBy(F.col("object_id").alias("id")).agg(F.min(F.coalesce("doc_type", F.lit(""))).alias("type"))
    known = spark.createDataFrame(list(graph.RELATION_TYPES.items()), "predicate string, rel_type string")
    nodes = meta.select("id", graph.node_label(F.col("type")).alias("label"))
    new = nodes.join(edges.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    after, linked = upsert.sync_objects(nodes, edges.limit(0).select("source_id", "target_id", F.lit("").alias("rel_type")), new, edges.join(new.select(F.col("id").alias("source_id")), "source_id", "left_semi"), known)
    degree = linked.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_inbound"))
    return after.join(degree, "id", "left").select("id", "label", F.coalesce("n_inbound", F.lit(0)).alias("n_inbound"))


def bm25_single(spark, folder):
    return search.search_documents(table(spark, folder, "documents"), "doc_id", "certificate", 10).select("doc_id", F.round("score", 6).alias("score"))


def bm25_multi(spark, folder):
    return search.search_documents(table(spark, folder, "documents"), "doc_id", QUERY, 25).select("doc_id", F.round("score", 6).alias("score"))


def index_bm25(spark, folder):
    """The same query against a stored index of all documents, which is built here."""
    path = f"{shared_folder(spark)}/tessera-index-{uuid.uuid4().hex}"
    search.build_index(table(spark, folder, "documents"), "doc_id", path)
    delete_on_exit(spark, path)
    return search.search_index(spark, path, QUERY, 25).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def pointers(spark, folder):
    hits = search.search_documents(table(spark, folder, "documents"), "doc_id", QUERY, 25)
    found = search.pointers(hits, "doc_id", QUERY)
    return found.select(F.col("rank").cast("long").alias("rank"), "file", "name", "why", F.array_join("sections", "; ").alias("sections"), "score", "domain")


def postings(spark, folder):
    return search.postings(table(spark, folder, "documents").select("doc_id", *search.WEIGHTS), "doc_id").select("term", F.col("key").alias("doc_id"), "weight")


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_diff, deleted_paths, status_counts, content_duplicates, upsert_last_wins, edge_upsert, duplicate_objects, object_lookup, linkable_edges, hubs, graph_nodes, closed_edges, degrees,
        neighbourhood, graph_export, graph_sync, object_json, class_check, predicate_check, type_check, cycle_check, hierarchy_cycles, orphan_check, class_bases, cosine_top, cosine_filtered, embed_misses, embed_reuse, bm25_single, bm25_multi, index_bm25,
        pointers, postings,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------

SNAPSHOTS = f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC, upper(status) DESC, sha256_hash DESC) AS r FROM file_state WHERE file_path IS NOT NULL),
now AS (SELECT file_path, sha256_hash FROM s WHERE r = 1 AND upper(status) <> 'DELETED'),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC, upper(status) DESC, sha256_hash DESC) AS r FROM file_state WHERE file_path IS NOT NULL AND indexed_at <= {CUTOFF}),
old AS (SELECT file_path, sha256_hash, upper(status) = 'DELETED' AS gone FROM o WHERE r = 1)
"""
EDGES = "e AS (SELECT DISTINCT source_id, target_id, predicate FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
META = "m AS (SELECT object_id, x.name AS name, x.file_path AS file_path, x.domain AS domain FROM (SELECT object_id, min(struct_pack(name := coalesce(name, ''), file_path := coalesce(file_path, ''), domain := coalesce(domain, ''))) AS x FROM doc_meta WHERE object_id IS NOT NULL GROUP BY 1))"
LINKS = "l AS (SELECT DISTINCT source_id, target_id, predicate FROM edges WHERE source_id IS NOT NULL)"
PREDICATES = "(" + ", ".join(f"'{p}'" for p in ontology.PREDICATES) + ")"
CLASSES = "(" + ", ".join(f"'{c}'" for c, _, _ in ontology.CLASSES) + ")"
OBJECTS = """b AS (SELECT id, type, CASE WHEN type = 'implementation' THEN 'Implementation' ELSE 'Concept' END AS cls FROM (SELECT object_id AS id, min(coalesce(doc_type, '')) AS type FROM doc_meta WHERE object_id IS NOT NULL GROUP BY 1)
      UNION ALL SELECT object_id, 'concept', ontology_class FROM concept_catalog)"""
RULES = "r(p, s, t) AS (VALUES " + ", ".join(f"('{p}', '{s}', '{t}')" for p, (a, b) in ontology.PREDICATES.items() for s in a for t in b) + ")"
BASE = "CASE WHEN {0} IN ('Algorithm', 'DataStructure', 'ArchitecturePattern', 'MathematicalTheory', 'Domain', 'SubDomain') THEN 'Concept' ELSE {0} END"
CYCLE = """SELECT DISTINCT a AS object_id, 'cycle_detected' AS rule FROM reach WHERE a = b"""
COSINE = "list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(repr(x) for x in NEAR) + "]::DOUBLE[])"


def bm25_sql(query: str, limit: int) -> str:
    from tessera.functions.text import query_terms

    terms = query_terms(query)
    columns = list(search.WEIGHTS)
    arrays = ", ".join(f"{TERMS.format(c)} AS t_{c}" for c in columns)
    weight = lambda t: " + ".join(f"{search.WEIGHTS[c]} * len(list_filter(t_{c}, lambda x: x = '{t}'))" for c in columns)
    hits = lambda t: " + ".join(f"len(list_filter(t_{c}, lambda x: x = '{t}'))" for c in columns)
    rows = " UNION ALL ".join(f"SELECT doc_id, n, {terms.count(t)} AS times, '{t}' AS term, {weight(t)} AS w, {hits(t)} AS h FROM a" for t in dict.fromkeys(terms))
    return f"""
    a AS (SELECT doc_id, {" + ".join(f"len(t_{c})" for c in columns)} AS n, * EXCLUDE (doc_id) FROM (SELECT doc_id, {arrays} FROM documents)),
    stat AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM a), rows AS ({rows}),
    dfs AS (SELECT term, count(*) FILTER (WHERE h > 0) AS df FROM rows GROUP BY 1),
    scored AS (SELECT doc_id, sum(times * CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
      * CASE WHEN w > 0 THEN w * 2.2 / (w + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END) AS score FROM rows JOIN dfs USING (term), stat WHERE h > 0 GROUP BY 1),
    top AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT {limit})"""


def _json(**fields: str) -> str:
    """A JSON object of expressions, in which nulls do not appear."""
    parts = " || ".join(f"""CASE WHEN {value} IS NULL THEN '' ELSE ',"{name}":' || to_json({value}) END""" for name, value in fields.items())
    return f"'{{' || substr({parts}, 2) || '}}'"


#: Summaries t(object_id, level_2, h), the cache c(h, v) in which every tenth of them is held, and the vector of a text without an entry.
SUMMARIES = """t AS (SELECT DISTINCT object_id, level_2, sha256(level_2) AS h FROM knowledge_store WHERE object_id IS NOT NULL),
      a AS (SELECT content_hash AS h, TRY_CAST(vector AS DOUBLE[]) AS v FROM embedding_cache WHERE content_hash IS NOT NULL UNION ALL SELECT h, [length(level_2)::DOUBLE, 0.5] FROM t WHERE level_2 IS NOT NULL AND length(level_2) % 10 = 3),
      c AS (SELECT h, max(v) AS v FROM a WHERE v IS NOT NULL GROUP BY 1)"""
HASHED = r"""list_transform(range(1024), lambda i: CASE WHEN regexp_matches(level_2, '[^\s\p{Z}]') THEN ((('0x' || substr(h, 2 * (i % 32)::INTEGER + 1, 2))::INTEGER) - 128) / 128.0::DOUBLE ELSE 0::DOUBLE END)"""
ASKED = "[" + ", ".join(f"'{w}'" for w in sorted(set(QUERY.split()))) + "]"
WORDS_OF = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"

ORACLES = {
    "snapshot_diff": SNAPSHOTS
    + """SELECT file_path, change FROM (SELECT coalesce(now.file_path, old.file_path) AS file_path, CASE WHEN now.file_path IS NULL AND NOT old.gone THEN 'DELETED' WHEN now.file_path IS NULL THEN NULL
      WHEN old.file_path IS NULL OR old.gone THEN 'NEW' WHEN now.sha256_hash = old.sha256_hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM now FULL JOIN old ON now.file_path = old.file_path) WHERE change IS NOT NULL""",
    "deleted_paths": SNAPSHOTS + "SELECT file_path FROM old WHERE NOT gone AND file_path NOT IN (SELECT file_path FROM now)",
    "status_counts": "SELECT count(*) AS total, sum(CASE WHEN upper(trim(status)) = 'ACTIVE' THEN 1 ELSE 0 END)::BIGINT AS active, sum(CASE WHEN upper(trim(status)) = 'DELETED' THEN 1 ELSE 0 END)::BIGINT AS deleted FROM file_state",
    "content_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "upsert_last_wins": """WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE n = 1""",
    "edge_upsert": """WITH new AS (SELECT DISTINCT source_id, target_id, predicate FROM edges WHERE source_id IS NOT NULL AND recorded_at >= TIMESTAMP '2024-07-01')
      SELECT DISTINCT source_id, target_id, predicate FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND recorded_at < TIMESTAMP '2024-07-01' AND source_id NOT IN (SELECT source_id FROM new)
      UNION ALL SELECT * FROM new WHERE target_id IS NOT NULL""",
    "duplicate_objects": "SELECT object_id, count(*) AS n FROM doc_meta WHERE object_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "object_lookup": f"WITH {EDGES}, c AS (SELECT target_id AS id, count(*) AS inbound FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT object_id, name, coalesce(level_1, '') AS level_1, coalesce(level_3, '') AS level_3 FROM (SELECT DISTINCT object_id, name, level_1, level_3 FROM knowledge_store) WHERE object_id IN (SELECT id FROM c)",
    "linkable_edges": f"WITH {EDGES}, n AS (SELECT object_id FROM doc_meta UNION SELECT object_id FROM concept_catalog) SELECT source_id, target_id, upper(predicate) AS rel_type FROM e WHERE predicate IN {PREDICATES} AND source_id IN (SELECT object_id FROM n) AND target_id IN (SELECT object_id FROM n)",
    "hubs": f"WITH {EDGES}, {META}, c AS (SELECT target_id AS id, count(*) AS inbound FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT id, coalesce(nullif(name, ''), id) AS name, coalesce(file_path, '') AS file_path, coalesce(domain, '') AS domain, inbound FROM c LEFT JOIN m ON m.object_id = c.id",
    "graph_nodes": f"WITH {EDGES}, k AS (SELECT DISTINCT object_id AS id, name, file_path, domain FROM doc_meta WHERE object_id IS NOT NULL), x AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e) SELECT * FROM k UNION ALL SELECT id, id, '', '' FROM x WHERE id NOT IN (SELECT id FROM k)",
    "class_bases": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"{v}::BIGINT" if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in ((n, d, p, "Concept" if p == "Concept" else n if n in ontology.BASES else None) for n, d, p in ontology.CLASSES)) + ") t(class, depth, parent, base)",
    "closed_edges": f"WITH {EDGES} SELECT * FROM e WHERE source_id IN (SELECT object_id FROM doc_meta) AND target_id IN (SELECT object_id FROM doc_meta)",
    "degrees": f"WITH {EDGES}, x AS (SELECT target_id AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT source_id, 0, 1 FROM e) SELECT id, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, sum(i) >= 3 AS is_hub, least(4 + 2 * sum(i), 20)::BIGINT AS radius FROM x GROUP BY 1",
    "neighbourhood": f"""WITH {EDGES}, s AS (SELECT target_id AS start FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
      o AS (SELECT source_id, target_id, upper(predicate) AS rel, source_id || '|' || predicate || '|' || target_id AS edge FROM e WHERE predicate IN {PREDICATES}),
      k AS (SELECT source_id AS h, target_id AS t, rel, edge FROM o UNION ALL SELECT target_id, source_id, rel, edge FROM o WHERE source_id <> target_id),
      one AS (SELECT h || ' > ' || t AS path_nodes, rel AS path_rels, edge, t FROM k, s WHERE h = start),
      two AS (SELECT path_nodes || ' > ' || k.t AS path_nodes, path_rels || ' > ' || k.rel AS path_rels FROM one JOIN k ON k.h = one.t WHERE k.edge <> one.edge)
      SELECT start AS source, path_nodes, path_rels FROM s LEFT JOIN (SELECT path_nodes, path_rels FROM one UNION ALL SELECT * FROM two) ON true""",
    "class_check": f"""WITH o AS (SELECT object_id, ontology_class AS c FROM concept_catalog UNION ALL SELECT * FROM (SELECT DISTINCT object_id, domain FROM doc_meta WHERE object_id IS NOT NULL))
      SELECT object_id, 'invalid_class' AS rule, 'Class ''' || c || ''' is not in the ontology taxonomy' AS message FROM o WHERE coalesce(c, '') <> '' AND c NOT IN {CLASSES}""",
    "predicate_check": f"WITH {LINKS} SELECT source_id AS object_id, 'invalid_predicate' AS rule, 'Predicate ''' || coalesce(predicate, '') || ''' is not allowed' AS message FROM l WHERE predicate IS NULL OR predicate NOT IN {PREDICATES}",
    "type_check": f"""WITH {LINKS}, {OBJECTS}, {RULES} SELECT l.source_id AS object_id, 'type_mismatch' AS rule, 'Predicate ''' || predicate || ''' invalid between ''' || x.cls || ''' and ''' || y.cls || '''' AS message
      FROM l JOIN b x ON x.id = l.source_id JOIN b y ON y.id = l.target_id WHERE predicate IN {PREDICATES} AND NOT EXISTS (SELECT 1 FROM r WHERE r.p = predicate AND r.s = {BASE.format('x.cls')} AND r.t = {BASE.format('y.cls')})""",
    "cycle_check": f"""WITH RECURSIVE h AS (SELECT source_id AS a, target_id AS b FROM edges WHERE predicate IN ('is_a', 'part_of') AND source_id IS NOT NULL AND target_id IS NOT NULL UNION SELECT object_id, parent_id FROM concept_catalog WHERE parent_id IS NOT NULL
        UNION SELECT parent_id, min(object_id) FROM concept_catalog WHERE parent_id IS NOT NULL GROUP BY 1),
      reach AS (SELECT a, b FROM h UNION SELECT r.a, h.b FROM reach r JOIN h ON h.a = r.b) {CYCLE}""",
    "hierarchy_cycles": f"""WITH RECURSIVE h AS (SELECT source_id AS a, target_id AS b FROM edges WHERE predicate IN ('is_a', 'part_of') AND source_id IS NOT NULL AND target_id IS NOT NULL UNION SELECT object_id, parent_id FROM concept_catalog WHERE parent_id IS NOT NULL),
      reach AS (SELECT a, b FROM h UNION SELECT r.a, h.b FROM reach r JOIN h ON h.a = r.b) {CYCLE}""",
    "orphan_check": f"""WITH {LINKS}, {OBJECTS}, k AS (SELECT object_id AS id, max(coalesce(level_0, '')) AS l0, max(coalesce(level_2, '')) AS l2 FROM knowledge_store GROUP BY 1)
      SELECT b.id AS object_id, 'orphan_implementation' AS rule FROM b LEFT JOIN k ON k.id = b.id WHERE b.type = 'implementation' AND coalesce(l0, '') = '' AND coalesce(l2, '') = ''
      AND NOT EXISTS (SELECT 1 FROM l JOIN b c ON c.id = l.target_id AND c.type = 'concept' WHERE l.source_id = b.id AND l.predicate IN ('example_of', 'is_a', 'part_of'))""",
    "cosine_top": f"SELECT vec_id, label, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10",
    "cosine_filtered": f"SELECT vec_id, label, round({COSINE}, 6) AS score FROM embeddings WHERE label = 1 ORDER BY {COSINE} DESC, vec_id LIMIT 5",
    "embed_misses": f"""WITH {SUMMARIES} SELECT h AS content_hash, {HASHED} AS vector FROM (SELECT DISTINCT h, level_2 FROM t WHERE level_2 IS NOT NULL) WHERE h NOT IN (SELECT h FROM c)""",
    "embed_reuse": f"""WITH {SUMMARIES}, v AS (SELECT object_id, coalesce(c.v, {HASHED.replace('substr(h', 'substr(t.h')}) AS v FROM t LEFT JOIN c ON c.h = t.h WHERE level_2 IS NOT NULL)
      SELECT object_id, len(v)::BIGINT AS n, v[1] AS first, v[-1] AS last FROM v""",
    "graph_export": f"""WITH {EDGES}, k AS (SELECT DISTINCT object_id AS id, name, file_path, domain FROM doc_meta WHERE object_id IS NOT NULL), x AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e),
      n AS (SELECT * FROM k UNION ALL SELECT id, id, '', '' FROM x WHERE id NOT IN (SELECT id FROM k))
      SELECT 'node' AS kind, {_json(id='id', name='name', file_path='file_path', domain='domain')} AS json FROM n UNION ALL SELECT 'edge', {_json(source='source_id', target='target_id', predicate='predicate')} FROM e""",
    "graph_sync": f"""WITH {EDGES}, m AS (SELECT object_id AS id, CASE min(coalesce(doc_type, '')) WHEN 'implementation' THEN 'File' ELSE 'Concept' END AS label FROM doc_meta WHERE object_id IS NOT NULL GROUP BY 1),
      l AS (SELECT DISTINCT source_id, target_id, upper(predicate) AS rel FROM e WHERE predicate IN {PREDICATES} AND source_id IN (SELECT id FROM m)),
      n AS (SELECT * FROM m UNION ALL SELECT DISTINCT target_id, 'Concept' FROM l WHERE target_id NOT IN (SELECT id FROM m)), d AS (SELECT target_id, count(*) AS k FROM l GROUP BY 1)
      SELECT id, label, coalesce(k, 0)::BIGINT AS n_inbound FROM n LEFT JOIN d ON d.target_id = n.id""",
    "object_json": f"""WITH {EDGES}, k AS (SELECT object_id, min(struct_pack(name := coalesce(name, ''), l0 := coalesce(level_0, ''), l1 := coalesce(level_1, ''), l2 := coalesce(level_2, ''), l3 := coalesce(level_3, ''))) AS k FROM knowledge_store WHERE object_id IS NOT NULL GROUP BY 1),
      m AS (SELECT object_id, min(struct_pack(domain := coalesce(domain, ''), kind := coalesce(doc_type, ''), path := coalesce(file_path, ''))) AS m FROM doc_meta WHERE object_id IS NOT NULL GROUP BY 1),
      r AS (SELECT source_id, '[' || string_agg({_json(target='target_id', predicate="coalesce(predicate, '')")}, ',' ORDER BY target_id, coalesce(predicate, '')) || ']' AS r FROM e GROUP BY 1)
      SELECT k.object_id AS id, '{{"id":' || to_json(k.object_id) || ',"type":' || to_json(m.m.kind) || ',"name":' || to_json(k.k.name) || ',"domain":' || to_json(m.m.domain) || ',"source_file":' || to_json(m.m.path) || ',"abstractions":'
        || {_json(level_0='k.k.l0', level_1='k.k.l1', level_2='k.k.l2', level_3='k.k.l3')} || ',"ontology":{{"class":"Concept","depth":3}},"relationships":' || coalesce(r, '[]') || ',"tags":[' || array_to_string(list_transform(list_filter(string_split(k.k.l3, '; '), lambda t: t <> ''), lambda t: to_json(t)), ',') || ']}}' AS json
      FROM k JOIN m USING (object_id) LEFT JOIN r ON r.source_id = k.object_id""",
    "index_bm25": f"WITH {bm25_sql(QUERY, 25)} SELECT doc_id, round(score, 6) AS score FROM top",
    "bm25_single": f"WITH {bm25_sql('certificate', 10)} SELECT doc_id, round(score, 6) AS score FROM top",
    "bm25_multi": f"WITH {bm25_sql(QUERY, 25)} SELECT doc_id, round(score, 6) AS score FROM top",
    "pointers": f"""WITH {bm25_sql(QUERY, 25)}, j AS (SELECT d.*, score FROM top JOIN documents d USING (doc_id) WHERE coalesce(file_path, '') <> ''),
      f AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, doc_id) AS nth FROM j),
      q AS (SELECT *, list_filter(list_transform(string_split(coalesce(keywords, ''), ';'), lambda p: {STRIP.format('p')}), lambda p: p <> '' AND list_has_any({WORDS_OF.format('p')}, {ASKED})) AS phrases,
        list_filter({ASKED}, lambda w: list_contains(list_concat({WORDS_OF.format('name')}, {WORDS_OF.format('sections')}), w)) AS surface FROM f WHERE nth = 1),
      t AS (SELECT *, list_concat(phrases, surface) AS al FROM q), u AS (SELECT *, list_filter(al, lambda x, i: list_position(al, x) = i)[1:8] AS best FROM t)
      SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, file_path AS file, name, CASE WHEN len(best) > 0 THEN array_to_string(best, ', ') ELSE '(matched in body text only)' END AS why,
        array_to_string(list_filter(list_transform(string_split(coalesce(sections, ''), ';')[1:5], lambda s: {STRIP.format('s')}), lambda s: s <> ''), '; ') AS sections, round(score, 3) AS score, coalesce(domain, '') AS domain FROM u""",
    "postings": "SELECT term, doc_id, sum(w) AS weight FROM (" + " UNION ALL ".join(f"SELECT doc_id, unnest({TERMS.format(c)}) AS term, {w}::DOUBLE AS w FROM documents" for c, w in search.WEIGHTS.items()) + ") GROUP BY 1, 2",
}
