import math

import pytest
from pyspark.sql import functions as F

from tessera.sources.store import VersionedTable
from tessera.operators import changes, graph, ontology, upsert, vectors

STATE = "path string, sha256 string, last_modified long, file_type string, indexed_at long, status string"


def test_snapshot_diff(spark, rows):
    before = spark.createDataFrame([("same", "1", 0, "text", 5, "ACTIVE"), ("new content", "1", 0, "text", 5, "ACTIVE"), ("gone", "1", 0, "text", 5, "ACTIVE"), ("back", "1", 0, "text", 5, "DELETED"), ("stays away", "1", 0, "text", 5, "deleted")], STATE)
    now = spark.createDataFrame([("same", "1", 0, "text"), ("new content", "2", 0, "text"), ("back", "1", 0, "text"), ("fresh", "1", 0, "text")], "path string, sha256 string, last_modified long, file_type string")
    diff = changes.snapshot_diff(now, before)
    assert {r["path"]: r["status"] for r in diff.collect()} == {"same": "UNCHANGED", "new content": "CHANGED", "gone": "DELETED", "back": "NEW", "fresh": "NEW"}
    assert {r["path"]: r["status"] for r in changes.snapshot_diff(now, before, compat=True).collect()}["back"] == "UNCHANGED"
    assert rows(changes.deleted_paths(now, before)) == [("gone",)]
    state = changes.next_state(diff, now, before, 9)
    assert {r["path"]: (r["status"], r["indexed_at"]) for r in state.collect()} == {"same": ("ACTIVE", 5), "new content": ("ACTIVE", 9), "gone": ("DELETED", 5), "back": ("ACTIVE", 9), "fresh": ("ACTIVE", 9), "stays away": ("DELETED", 5)}
    assert changes.changed_files(changes.snapshot_diff(now, state)).count() == 0
    assert changes.snapshot_diff(now.limit(0), before.limit(0)).count() == 0


def test_status_counts(spark):
    empty = spark.createDataFrame([], STATE)
    assert tuple(changes.status_counts(empty).first()) == (0, None, None)


def test_upsert_last_wins(spark, rows):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "id string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "id string, v int, seq int")
    assert rows(upsert.upsert(old, new, ["id"], "seq")) == [("a", 1, 0), ("b", 3, 2), ("c", 4, 1)]


def test_edges_are_replaced(spark, rows):
    old = spark.createDataFrame([("a", "x", "uses"), ("b", "x", "uses")], "source_id string, target_id string, predicate string")
    new = spark.createDataFrame([("a", "y", "uses"), ("a", "y", "uses")], old.schema)
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert rows(upsert.replace_edges(old, new, sources)) == [("a", "y", "uses")]  # b lost its links
    assert rows(upsert.purge_nodes(old, spark.createDataFrame([("x",)], "id string"))) == []


def test_graph_sync(spark, rows):
    nodes = spark.createDataFrame([("a", "Concept", "/1"), ("b", "File", "/2"), ("c", "Concept", "/3")], "id string, label string, source_file string")
    edges = spark.createDataFrame([("a", "b", "USES"), ("b", "a", "USES"), ("c", "a", "IS_A")], "source_id string, target_id string, rel_type string")
    new = spark.createDataFrame([("a", "Concept", "/1")], nodes.schema)
    links_ = spark.createDataFrame([("a", "x", "uses"), ("a", "c", "is_a"), ("a", "y", "likes")], "source_id string, target_id string, predicate string")
    known = spark.createDataFrame([("uses", "USES"), ("is_a", "IS_A")], "predicate string, rel_type string")
    after, linked = upsert.sync_objects(nodes, edges, new, links_, known)
    assert rows(after) == [("a", "Concept", "/1"), ("b", "File", "/2"), ("c", "Concept", "/3"), ("x", "Concept", None)]
    assert rows(linked) == [("a", "c", "IS_A"), ("a", "x", "USES"), ("b", "a", "USES"), ("c", "a", "IS_A")]
    _, purged = upsert.sync_objects(nodes, edges, new, links_, known, keep_inbound=False)
    assert rows(purged) == [("a", "c", "IS_A"), ("a", "x", "USES")]
    left, still = upsert.delete_by_file(nodes, edges, spark.createDataFrame([("/1",)], "source_file string"))
    assert {r["id"] for r in left.collect()} == {"b", "c"} and still.count() == 0
    objects = spark.createDataFrame([("o", "implementation", "n", "d", "/o", "", "", "", "Implementation", 4)], "id string, type string, name string, domain string, source_file string, level_1 string, level_2 string, level_3 string, ontology_class string, ontology_depth int")
    assert upsert.graph_node_rows(objects).first()["label"] == "File"


def test_versioned_table(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "t"), "id string, v int")
    assert t.read().count() == 0 and t.version is None
    t.write(spark.createDataFrame([("a", 1)], "id string, v int"))
    first = t.read()
    t.write(first.unionByName(spark.createDataFrame([("b", 2)], "id string, v int")))
    assert rows(t.read()) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception):
        t.write(spark.createDataFrame([("x",)], "id string").withColumn("v", F.raise_error(F.lit("no")).cast("int")))
    assert rows(t.read()) == [("a", 1), ("b", 2)]
    t.wipe()
    assert t.read().count() == 0


EDGES = [("a", "b", "uses"), ("b", "c", "uses"), ("d", "b", "uses"), ("c", "a", "depends_on")]


def frame(spark, edges=EDGES):
    return spark.createDataFrame(edges, "source_id string, target_id string, predicate string")


def test_neighbourhood(spark):
    paths = ["".join(r["path_nodes"]) for r in graph.neighbourhood(frame(spark), "a", 2).collect()]
    assert sorted(paths) == ["ab", "abc", "abd", "ac", "acb"]
    alone = graph.neighbourhood(frame(spark), "z", 2).collect()
    assert [tuple(r) for r in alone] == [("z", None, None)]
    loop = graph.neighbourhood(frame(spark, [("a", "a", "uses")]), "a", 9).collect()
    assert [r["path_nodes"] for r in loop] == [["a", "a"]]


def test_hubs_and_export(spark, tmp_path):
    meta = spark.createDataFrame([("b", "", "/b", "d"), ("c", "Cee", None, None), ("c", "Cee", None, None)], "object_id string, name string, file_path string, domain string")
    top = [tuple(r) for r in graph.hubs(frame(spark, [*EDGES, EDGES[0]]), meta, 2).collect()]
    assert top == [("b", "b", "/b", "d", 2), ("a", "a", "", "", 1)]
    assert {r["id"] for r in graph.graph_nodes(frame(spark), meta).collect()} == set("abcd")
    assert graph.closed_edges(frame(spark), meta.select(F.col("object_id").alias("id"))).count() == 1
    degree = {r["id"]: (r["inbound"], r["outbound"]) for r in graph.degrees(frame(spark)).collect()}
    assert degree["b"] == (2, 1) and sum(i for i, _ in degree.values()) == len(EDGES)
    graph.export_html(frame(spark), meta, str(tmp_path / "g.html"))
    assert "Cee" in (tmp_path / "g.html").read_text()
    with pytest.raises(ValueError):
        graph.export_html(frame(spark), meta, str(tmp_path / "h.html"), limit=2)


def links(spark, edges):
    return spark.createDataFrame([("f", *e) for e in edges], "batch string, source_id string, target_id string, predicate string")


@pytest.mark.parametrize(
    ("edges", "found"),
    [
        ([("a", "b", "part_of"), ("b", "a", "part_of")], {"a", "b"}),
        ([("a", "b", "is_a"), ("b", "c", "part_of"), ("c", "a", "is_a"), ("x", "a", "is_a"), ("c", "y", "is_a")], {"a", "b", "c"}),
        ([("a", "a", "is_a")], {"a"}),
        ([("a", "b", "is_a"), ("b", "c", "is_a")], set()),
        ([("a", "b", "uses"), ("b", "a", "uses")], set()),
        ([("a", "b", "is_a"), ("b", "a", "is_a"), ("b", "m", "is_a"), ("m", "c", "is_a"), ("c", "d", "is_a"), ("d", "c", "is_a")], {"a", "b", "c", "d"}),
        # the smallest node lies between two circles and is on none; three circles in a chain
        ([("m", "n", "is_a"), ("n", "m", "is_a"), ("n", "a", "is_a"), ("a", "x", "is_a"), ("x", "y", "is_a"), ("y", "x", "is_a"), ("y", "b", "is_a"), ("b", "c", "is_a"), ("c", "b", "is_a")], {"m", "n", "x", "y", "b", "c"}),
        ([(f"n{i:02}", f"n{(i * 7 + 7) % 40:02}", "is_a") for i in range(40)] + [(f"n{i:02}", f"t{i}", "is_a") for i in range(9)], None),
        ([], set()),
    ],
)
def test_cycles(spark, edges, found):
    if found is None:  # by walking from every node
        after = {}
        for a, b, _ in edges:
            after.setdefault(a, set()).add(b)
        found = set()
        for start in after:
            seen, todo = set(), list(after[start])
            while todo:
                node = todo.pop()
                if node not in seen:
                    seen.add(node)
                    todo += after.get(node, ())
            found |= {start} & seen
        assert found
    assert {r["object_id"] for r in ontology.cycles(links(spark, edges)).collect()} == found


def test_validate(spark):
    objects = spark.createDataFrame(
        [("f", "c", "concept", "Concept", "x", ""), ("f", "i", "implementation", "Implementation", "", ""), ("f", "o", "implementation", "Implementation", None, None), ("f", "w", "concept", "Wrong", "x", ""), ("g", "c2", "concept", "Algorithm", "x", "")],
        "batch string, id string, type string, ontology_class string, level_0 string, level_2 string",
    )
    edges = links(spark, [("i", "c", "example_of"), ("o", "elsewhere", "example_of"), ("c", "i", "is_a"), ("c", "x", "likes"), ("c", "x", None)])
    errors = {(r["object_id"], r["rule"]) for r in ontology.validate(objects, edges).collect()}
    assert errors == {("w", "invalid_class"), ("o", "orphan_implementation"), ("c", "type_mismatch"), ("c", "invalid_predicate")}
    bases = {r["class"]: r["base"] for r in ontology.class_table(spark).collect()}
    assert bases["Algorithm"] == "Concept" and bases["KnowledgeObject"] is None and bases["Reference"] == "Reference"


def test_hash_embedding(spark):
    text = spark.createDataFrame([("abc",), (" ",)], "t string")
    full, blank = [r[0] for r in text.select(vectors.hash_embedding(F.col("t"))).collect()]
    assert full[:3] == [0.453125, -0.0625, -0.828125] and len(full) == 1024 and full[32:64] == full[:32]
    assert blank == [0.0] * 1024


def test_cosine(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 1.0], "x"), (3, [-1.0, 0.0], "y"), (4, [0.0, 0.0], "x"), (5, [2.0, 0.0], "y")], "id int, v array<float>, domain string")
    top = [(r["id"], round(r["score"], 6)) for r in vectors.cosine_top(table, "id", "v", [3.0, 0.0], 3).collect()]
    assert top == [(1, 1.0), (5, 1.0), (2, round(math.sqrt(0.5), 6))]
    assert [r["id"] for r in vectors.cosine_top(table, "id", "v", [1.0, 0.0], 3, {"domain": "y"}).collect()] == [5, 3]


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, t string")
    cache = spark.createDataFrame([], "content_hash string, vector array<double>, created_at long")
    found, fresh = vectors.embed(texts, "id", "t", cache, now=7)
    assert found.count() == 3 and fresh.count() == 2
    again, more = vectors.embed(texts, "id", "t", fresh)
    assert again.count() == 3 and more.count() == 0
    custom, _ = vectors.embed(texts, "id", "t", cache, model=lambda batch: [[float(len(t))] for t in batch])
    assert {tuple(r["vector"]) for r in custom.collect()} == {(1.0,)}
