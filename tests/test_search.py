import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import search

ROWS = [
    ("concept_crypto", "Crypto.md", "crypto basics cipher cipher", "a", "/v/crypto.md", "cryptography", "H1: Crypto", "cipher; key"),
    ("concept_net", "Net.md", "network packets cipher", "b", "/v/net.md", "networking", "H1: Net", "packet; routing"),
    ("concept_zed", "Zed", "élan vital foo_bar camelCase data-base", None, "/v/z.txt", "general", None, None),
    ("concept_y", "Y", "other thing", None, "/v/y.txt", "general", None, None),
]
QUERIES = ["cipher", "crypto", "concept", "elan", "foo", "txt", "cipher net", "cipher cipher", "packet key cipher", "general"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "id int, object_id string, name string, content string, tags string, file_path string, domain string, sections string, keywords string")


@pytest.fixture(scope="module")
def fts():
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE d USING fts5(object_id, name, content, tags, file_path, domain, sections, keywords)")
    base.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [[x or "" for x in r] for r in ROWS])
    return base


def truth(fts, query):
    match = " OR ".join(f'"{t}"' for t in query.split())
    return {i - 1: -s for i, s in fts.execute("SELECT rowid, bm25(d, 0.0, 10.0, 1.0, 5.0, 8.0, 5.0, 6.0, 6.0) FROM d WHERE d MATCH ?", (match,))}


@pytest.mark.parametrize("query", QUERIES)
def test_scores_equal_sqlite(documents, fts, query):
    found = {r["id"]: r["score"] for r in search.search_documents(documents, "id", query).collect()}
    expected = truth(fts, query)
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], rel=1e-9, abs=1e-15) for k in expected)


def test_stored_index(spark, documents, fts, tmp_path):
    search.build_index(documents, "id", str(tmp_path))
    for query in QUERIES:
        found = {r["key"]: r["score"] for r in search.search_index(spark, str(tmp_path), query).collect()}
        expected = truth(fts, query)
        assert found.keys() == expected.keys()
        assert all(found[k] == pytest.approx(expected[k], rel=1e-9, abs=1e-15) for k in expected)
    assert search.search_index(spark, str(tmp_path), "the of").count() == 0


def test_no_hits(documents):
    assert search.search_documents(documents, "id", "foobar database").count() == 0
    assert search.search_documents(documents, "id", "").count() == 0
    assert search.search_documents(documents.limit(0), "id", "cipher").count() == 0


def test_pointers(documents):
    hits = search.search_documents(documents.unionByName(documents.where("id = 1").withColumn("id", F.lit(9))), "id", "cipher net")
    found = [r.asDict() for r in search.pointers(hits, "id", "cipher net").orderBy("rank").collect()]
    assert [(p["rank"], p["file"]) for p in found] == [(1, "/v/net.md"), (2, "/v/crypto.md")]
    assert found[0]["why"] == "net" and found[1]["why"] == "cipher" and found[0]["sections"] == ["H1: Net"]
    report = search.pointer_report(search.pointers(hits, "id", "cipher net"), "cipher net")
    assert report.startswith("# Search Results for: cipher net") and "## 1. Net.md" in report and "**Domain:** networking" in report
    body = search.pointers(search.search_documents(documents, "id", "vital"), "id", "vital").first()
    assert body["why"] == "(matched in body text only)"
    assert search.pointer_report(search.pointers(hits.limit(0), "id", "x"), "x").startswith("No relevant")
