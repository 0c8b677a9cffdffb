"""The engine over one home folder: rebuild and update workspaces, query, hubs, graph, status."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import settings
from tessera.functions.text import embedding_text
from tessera.operators import changes, graph, ontology, search, vectors
from tessera.operators.compile import OBJECT, compile_files, links_of_objects
from tessera.operators.upsert import delete_keys, graph_node_rows, replace_edges, sync_objects, upsert
from tessera.sources.files import ignore_patterns, lookup, lookup_many, scan
from tessera.sources.store import Files, Store
from tessera.staging import scope, stage

STATE = "path string, sha256 string, last_modified long, file_type string, indexed_at long, status string, workspace string"
DOCUMENTS = "object_id string, name string, content string, tags string, file_path string, domain string, sections string, keywords string, doc_type string, seq long, workspace string"
EDGES = "source_id string, target_id string, predicate string, workspace string"
VECTORS = "knowledge_id string, vector array<double>, type string, name string, domain string, tags array<string>, file_path string, workspace string"
CACHE = "content_hash string, vector array<double>, created_at long"
#: A query is cut to this many characters.
MAX_QUERY = 10_000
#: Changed files up to this number are read by name; for more the workspace is read again. Segments of the index before they become one.
NAMED_FILES, SEGMENTS = 2_000, 8


class Engine:
    """Tables and index of a home folder on any Hadoop file system.

    An update writes new versions of the tables that change and a segment of the index, and then one manifest that makes
    all of them count. ``keep_deleted`` leaves objects of deleted files searchable, and lets a returned file stay
    deleted, as early versions of such indexes did.
    """

    def __init__(self, spark: SparkSession, home: str, ignore_file: str | None = None, keep_deleted: bool = False) -> None:
        self.spark, self.home, self.ignore_file, self.keep_deleted = spark, home, ignore_file, keep_deleted
        schemas = {"file_state": STATE, "objects": OBJECT + ", workspace string", "documents": DOCUMENTS, "edges": EDGES, "vectors": VECTORS, "embedding_cache": CACHE}
        self.store = Store(spark, home, schemas)

    # ---- workspaces

    def workspaces(self) -> list[str]:
        return self.store.manifest().get("workspaces", [])

    def register(self, workspace: str) -> None:
        if workspace not in (known := self.workspaces()):
            self.store.commit({}, workspaces=[*known, workspace])

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _of(self, name: str, workspace: str) -> DataFrame:
        return self.table(name).where(F.col("workspace") == workspace)

    # ---- change detection

    def files(self, workspace: str, only: list[str] | None = None) -> DataFrame:
        chosen = settings(self.home, workspace)
        return scan(self.spark, workspace, [*ignore_patterns(self.ignore_file), *chosen.ignore], chosen.max_file_bytes, only)

    def scan(self, workspace: str) -> DataFrame:
        """(path, status, digest, old_digest): what an update would find. Changes nothing."""
        return changes.snapshot_diff(self.files(workspace), self._of("file_state", workspace), compat=self.keep_deleted)

    # ---- indexing

    def rebuild(self, workspace: str) -> dict:
        """Index a workspace anew; other workspaces stay as they are."""
        return self._index(workspace, anew=True)

    def update(self, workspace: str) -> dict:
        """Index what is new, changed or deleted; without changes nothing is written."""
        return self._index(workspace, anew=False)

    def update_all(self) -> dict[str, dict]:
        return {w: self.update(w) for w in self.workspaces() if Files(self.spark, w).exists("")}

    def _index(self, workspace: str, anew: bool) -> dict:
        began = time.time()
        stats = {"files_scanned": 0, "files_deleted": 0, "objects_compiled": 0, "objects_indexed": 0, "objects_rejected": 0}
        seen = self.store.manifest().get("fingerprints", {}).get(workspace)
        if anew or seen is None or seen != self._fingerprint(self.files(workspace)):
            with scope():
                stats |= self._replace(workspace, anew)
        self.register(workspace)
        return stats | {"elapsed_seconds": round(time.time() - began, 2)}

    @staticmethod
    def _fingerprint(files: DataFrame) -> list[int]:
        """Number of the files and two sums over hashes of their paths and contents: the same for the same files, and else different but for chance of 2^-120 or so."""
        one, two = F.xxhash64("path", "sha256"), F.xxhash64("sha256", "path", F.lit(7))
        row = files.select(one.alias("one"), two.alias("two")).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("one"), F.lit(0)), F.coalesce(F.bit_xor("two"), F.lit(0))).first()
        return list(row)

    def _replace(self, workspace: str, anew: bool) -> dict:
        before = self._of("file_state", workspace)
        if anew:
            before = before.limit(0)
        files = self.files(workspace)
        listed = stage(files.drop("content"), "listing")
        diff = stage(changes.snapshot_diff(listed, before, compat=self.keep_deleted), "diff")
        delta = changes.changed_files(diff).select("path")
        rows = diff.join(listed.select("path", "file_type"), "path", "left").groupBy("status", "file_type").count().collect()
        changed, deleted = (sum(r["count"] for r in rows if r["status"] in statuses) for statuses in (("NEW", "CHANGED"), ("DELETED",)))
        kinds = [r["file_type"] for r in rows if r["status"] in ("NEW", "CHANGED")]
        if not anew and changed <= NAMED_FILES:
            files = self.files(workspace, [r["path"] for r in delta.collect()])
        else:
            files = files.join(delta, "path", "left_semi")
        # of objects of one id the one that was indexed last stays, and of those the one with the last path
        objects = stage(compile_files(files.withColumn("seq", F.lit(time.time_ns())), kinds), "objects")
        batch = objects.select(F.col("source_file").alias("batch"), "id", "type", "ontology_class", "level_0", "level_2")
        errors = ontology.validate(batch, links_of_objects(objects)).select(F.col("batch").alias("source_file"), F.col("object_id").alias("id")).distinct()
        checked = objects.join(errors.withColumn("_bad", F.lit(True)), ["source_file", "id"], "left")
        checked = stage(checked.withColumn("workspace", F.lit(workspace)), "checked")
        valid = stage(changes.last_by_sequence(checked.where("_bad is null").drop("_bad"), ["id"], "source_file"), "valid")
        self._write(workspace, listed, before, valid, diff, anew)
        rejected = checked.where("_bad").count()
        return {"files_scanned": changed, "files_deleted": deleted, "objects_compiled": objects.count(), "objects_indexed": valid.count(), "objects_rejected": rejected}

    def _write(self, workspace: str, listed: DataFrame, before: DataFrame, valid: DataFrame, diff: DataFrame, anew: bool) -> None:
        """New versions of all tables and of the index, side by side, and then the manifest."""
        manifest = self.store.manifest()
        old = {name: self.store.read(name, manifest) for name in self.store.schemas}
        gone = diff.where("status = 'DELETED'").select("path")
        if self.keep_deleted:
            gone = gone.limit(0)

        def kept(name: str, path: str) -> DataFrame:
            rows = old[name].where(F.col("workspace") != workspace) if anew else old[name]
            return rows.join(gone.select(F.col("path").alias(path)), path, "left_anti").select(*old[name].columns)

        documents = valid.select(
            F.col("id").alias("object_id"), "name", embedding_text(F.col("name"), F.col("level_2"), F.col("level_3")).alias("content"), F.array_join("tags", " ").alias("tags"), F.col("source_file").alias("file_path"),
            "domain", F.col("level_1").alias("sections"), F.col("level_3").alias("keywords"), F.col("type").alias("doc_type"), "seq", "workspace",
        )
        lost = old["objects"].join(gone.select(F.col("path").alias("source_file")), "source_file", "left_semi").select("id")
        if anew:
            lost = lost.unionByName(old["objects"].where(F.col("workspace") == workspace).select("id"))
        replaced = stage(valid.select("id").unionByName(lost).distinct(), "replaced")
        new_edges = links_of_objects(valid).drop("batch").withColumn("workspace", F.lit(workspace))
        vector_rows, fresh = vectors.embed(documents, "object_id", "content", old["embedding_cache"], now=int(time.time()))
        points = vector_rows.withColumnRenamed("key", "knowledge_id").join(valid.select(F.col("id").alias("knowledge_id"), "type", "name", "domain", "tags", F.col("source_file").alias("file_path"), "workspace"), "knowledge_id")
        state = changes.next_state(diff, listed, before, int(time.time())).withColumn("workspace", F.lit(workspace))
        new = {
            "edges": replace_edges(old["edges"], new_edges, replaced.withColumnRenamed("id", "source_id")),
            "documents": upsert(kept("documents", "file_path"), documents, ["object_id"]),
            "objects": upsert(kept("objects", "source_file"), valid, ["id"]),
            "vectors": upsert(kept("vectors", "file_path"), points, ["knowledge_id"]),
            "embedding_cache": old["embedding_cache"].unionByName(fresh),
            "file_state": old["file_state"].where(F.col("workspace") != workspace).unionByName(state),
        }
        with ThreadPoolExecutor(len(new) + 1) as pool:
            index = pool.submit(self._segment, manifest.get("index", {"segments": []})["segments"], documents, replaced.withColumnRenamed("id", "key"), new["documents"])
            written = {name: pool.submit(self.store.write, name, rows) for name, rows in new.items()}
            tables = {name: job.result() for name, job in written.items()}
        fingerprints = manifest.get("fingerprints", {}) | {workspace: self._fingerprint(listed)}
        self.store.commit(tables, index=index.result(), fingerprints=fingerprints)

    def _segment(self, segments: list[str], documents: DataFrame, replaced: DataFrame, all_documents: DataFrame) -> dict:
        """The index with a new segment: of the new documents, or of all where the segments would be too many."""
        folder = self.store.new_folder("index")
        if 0 < len(segments) < SEGMENTS:
            search.write_segment(documents, "object_id", self.store.path(folder))
            search.write_deletions(replaced, self.store.path(folder))
            segments = [*segments, folder]
        else:
            search.write_segment(all_documents, "object_id", self.store.path(folder))
            segments = [folder]
        return {"segments": segments} | search.index_totals(self.spark, [self.store.path(s) for s in segments])

    # ---- reading

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The best documents with their score, from the stored index."""
        if not query:
            raise ValueError("a query is required")
        manifest = self.store.manifest()
        documents, index = self.store.read("documents", manifest), manifest.get("index", {"segments": [], "n_docs": 0})
        # at most ``limit`` rows; their ids reach the scan of the documents as a filter
        found = search.search_segments(self.spark, [self.store.path(s) for s in index["segments"]], index, query[:MAX_QUERY], limit).collect()
        scores = {r["key"]: r["score"] for r in found}
        if not scores:
            return documents.withColumn("score", F.lit(0.0)).limit(0)
        score = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])[F.col("object_id")]
        return documents.where(F.col("object_id").isin(list(scores))).withColumn("score", score).orderBy(F.desc("score"), "object_id")

    def pointers(self, query: str, limit: int | None = None) -> DataFrame:
        limit = limit or settings(self.home).limit
        return search.pointers(self.search(query, limit), "object_id", query[:MAX_QUERY])

    def query(self, query: str, limit: int | None = None, output: str = "markdown", fresh: bool = False) -> str:
        """The pointers as markdown or JSON; ``fresh`` updates all workspaces first."""
        if fresh:
            self.update_all()
        found = self.pointers(query, limit)
        if output == "json":
            return json.dumps([json.loads(r) for r in found.orderBy("rank").toJSON().collect()], ensure_ascii=False)
        return search.pointer_report(found, query)

    def similar(self, vector: list[float], limit: int = 10, domain: str | None = None, type: str | None = None) -> DataFrame:
        return vectors.cosine_top(self.table("vectors"), "knowledge_id", "vector", vector, limit, {"domain": domain, "type": type})

    def vector_points(self) -> DataFrame:
        """The vectors with the ids under which an outside vector store would keep them."""
        return self.table("vectors").withColumn("point_id", vectors.point_id(F.col("knowledge_id")))

    def graph_tables(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) as an outside graph store would keep them: labelled, with placeholders for targets that are no objects."""
        nodes, edges = graph_node_rows(self.table("objects")), self.table("edges").select("source_id", "target_id", "predicate")
        known = self.spark.createDataFrame(list(graph.RELATION_TYPES.items()), "predicate string, rel_type string")
        return sync_objects(nodes.limit(0), edges.limit(0).select("source_id", "target_id", F.col("predicate").alias("rel_type")), nodes, edges, known)

    def hubs(self, limit: int = 20) -> DataFrame:
        return graph.hubs(self.table("edges"), self.table("documents"), limit)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.graph_nodes(self.table("edges"), self.table("documents")), graph.distinct_edges(self.table("edges"))

    def context(self, concept: str, hops: int = 2) -> DataFrame:
        return graph.neighbourhood(self.table("edges"), concept, hops)

    def status(self, workspace: str | None = None) -> DataFrame:
        return changes.status_counts(self.table("file_state") if workspace is None else self._of("file_state", workspace))

    def count(self) -> int:
        return self.table("documents").count()

    def object(self, key: str) -> DataFrame:
        return lookup(self.table("objects").withColumnRenamed("id", "object_id"), key)

    def objects(self, keys: list[str]) -> DataFrame:
        return lookup_many(self.table("objects").withColumnRenamed("id", "object_id"), keys)

    def delete_files(self, paths: list[str]) -> None:
        """Take the objects of these files, with their edges and vectors, out of the index."""
        with scope():
            gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
            lost = stage(self.table("objects").join(gone.withColumnRenamed("path", "source_file"), "source_file", "left_semi").select(F.col("id").alias("source_id")).distinct(), "lost")
            left = {name: delete_keys(self.table(name), gone.withColumnRenamed("path", path), [path]) for name, path in (("documents", "file_path"), ("objects", "source_file"), ("vectors", "file_path"))}
            left["edges"] = delete_keys(self.table("edges"), lost, ["source_id"])
            segments = self.store.manifest().get("index", {"segments": []})["segments"]
            index = self._segment(segments, left["documents"].limit(0), lost.withColumnRenamed("source_id", "key"), left["documents"])
            self.store.commit({name: self.store.write(name, rows) for name, rows in left.items()}, index=index)

    def wipe(self) -> None:
        """Empty tables and an empty index; registered workspaces stay registered."""
        self.store.commit(dict.fromkeys(self.store.schemas), index={"segments": [], "n_docs": 0, "n_terms": 0}, fingerprints={})
