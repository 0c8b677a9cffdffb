import hashlib

import __spark_entry__ as entry
from tessera.operators import ontology


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def brute_force(edges, start):
    """(path_nodes, path_rels) of the paths of one or two edges, each edge once in a path."""
    edges = {e for e in edges if e[2] in ontology.PREDICATES}
    steps = [(a, b, p.upper(), (a, b, p)) for a, b, p in edges] + [(b, a, p.upper(), (a, b, p)) for a, b, p in edges if a != b]
    one = [([a, b], [rel], edge) for a, b, rel, edge in steps if a == start]
    two = [([*nodes, b], [*rels, rel], edge) for nodes, rels, used in one for a, b, rel, edge in steps if a == nodes[-1] and edge != used]
    return sorted((" > ".join(nodes), " > ".join(rels)) for nodes, rels, _ in one + two)


def test_neighbourhood_of_all_predicates(spark, tmp_path):
    # a hub of all predicates, chains behind it, a circle and a loop; "likes" counts for the start, but joins nothing
    edges = [(f"{p}_{i}", "hub", p) for p in ontology.PREDICATES for i in range(3)] + [(f"far_{p}", f"{p}_0", p) for p in ontology.PREDICATES]
    edges += [("hub", "uses_0", "uses"), ("hub", "hub", "part_of"), ("fan", "hub", "likes"), ("x", "y", "extends"), ("y", "x", "optimized_by"), ("z", "x", "extends")]
    save(spark, tmp_path, "edges", edges + edges[:4] + [(None, "hub", "uses"), ("hub", None, "uses")], "source_id string, target_id string, predicate string")
    save(spark, tmp_path, "doc_meta", [("hub", "Hub", "/h", "d")], "object_id string, name string, file_path string, domain string")
    found = entry.queries()["neighbourhood"](spark, str(tmp_path)).collect()
    assert {r["source"] for r in found} == {"hub"}
    assert sorted((r["path_nodes"], r["path_rels"]) for r in found) == brute_force(edges, "hub")
    assert {rel for r in found for rel in r["path_rels"].split(" > ")} == {p.upper() for p in ontology.PREDICATES}


def test_hash_vectors(spark, tmp_path):
    save(spark, tmp_path, "documents", [(1, "abc"), (2, " \t"), (3, None), (4, "Ünïcode"), (5, "")], "doc_id long, name string")
    found = {r["doc_id"]: r["vector"] for r in entry.queries()["hash_vectors"](spark, str(tmp_path)).collect()}
    whole = lambda text: [(b - 128) / 128 for b in hashlib.sha256(text.encode()).digest()] * 32
    assert found == {1: whole("abc"), 2: [0.0] * 1024, 4: whole("Ünïcode"), 5: [0.0] * 1024}


def test_hierarchy_cycles(spark, tmp_path):
    """A circle that needs a catalog parent and a recorded edge, next to one of edges alone."""
    save(spark, tmp_path, "concept_catalog", [("leaf", "middle"), ("middle", "root"), ("root", None), ("other", "root")], "object_id string, parent_id string")
    save(spark, tmp_path, "edges", [("root", "x", "is_a"), ("x", "leaf", "part_of"), ("a", "b", "is_a"), ("b", "a", "is_a"), ("root", "other", "uses"), (None, "leaf", "is_a"), ("leaf", None, "is_a")], "source_id string, target_id string, predicate string")
    found = {r["object_id"] for r in entry.queries()["hierarchy_cycles"](spark, str(tmp_path)).collect()}
    assert found == {"root", "x", "leaf", "middle", "a", "b"}
