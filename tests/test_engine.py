import json
from pathlib import Path
from types import SimpleNamespace

import pytest

from tessera import config, staging
from tessera.plans.engine import Engine
from tessera.sources import files
from tessera.streaming import feed
from tessera.sources.store import VersionedTable


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    folder = tmp_path_factory.mktemp("vault")
    (folder / "crypto.md").write_text("---\ntitle: Crypto Basics\n---\n# Crypto\n\nThe cipher needs a key, and every cipher text depends on that key. See [[Net]] and #security.\n")
    (folder / "net.md").write_text("# Net\n\nPackets travel through routers. A packet has a header, and routers read the header of the packet.\n")
    (folder / "tool.py").write_text('"""Encrypts packets."""\nimport hashlib\n\ndef encrypt(text):\n    return text\n')
    (folder / "notes.txt").write_text("Plain notes about wireless networks and their packets, long enough to have keywords in them.\n")
    (folder / "empty.js").write_text("")
    (folder / "blob.xyz").write_bytes(b"ab\x00cd")
    (folder / "pic.png").write_bytes(b"\x89PNG")
    (folder / "tests").mkdir()
    (folder / "tests" / "skip.md").write_text("# Skip")
    (folder / "x.tmp").write_text("temporary")
    (folder / ".ignore").write_text("# patterns\n*.tmp\n.ignore\n")
    return folder


@pytest.fixture(scope="module")
def engine(spark, workspace, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("home")), str(workspace / ".ignore"))


def test_scan_classifies(spark, workspace):
    found = {r["relative"]: r["file_type"] for r in files.scan(spark, str(workspace), ["*.tmp", ".ignore"]).collect()}
    assert found == {"crypto.md": "markdown", "net.md": "markdown", "tool.py": "code", "notes.txt": "text"}  # the source lists no empty files


@pytest.mark.parametrize(("content", "is_text"), [(b"", False), (b"ok", True), (b"a\x00b", False), (b"\xff\xfe", False), (b"a" * 8191 + "é".encode(), False), (b"a" * 8190 + "é".encode(), True)])
def test_sniff(spark, content, is_text):
    frame = spark.createDataFrame([(bytearray(content),)], "content binary")
    from pyspark.sql import functions as F

    assert frame.select(files.looks_like_text(F.col("content"))).first()[0] is is_text


def test_life_of_a_workspace(engine, workspace, rows):
    assert {r["status"] for r in engine.scan(str(workspace)).collect()} == {"NEW"}
    stats = engine.rebuild(str(workspace))
    assert stats["files_scanned"] == 4 and stats["objects_rejected"] == 0
    ids = {r["id"] for r in engine.table("objects").select("id").collect()}
    assert {"concept_crypto_basics", "concept_net", "concept_tool", "concept_notes", f"{workspace}/crypto.md"} <= ids
    edges = {(r["source_id"], r["target_id"], r["predicate"]) for r in engine.table("edges").collect()}
    assert ("concept_crypto_basics", "concept_net", "uses") in edges and ("concept_tool", "concept_hashlib", "depends_on") in edges
    assert engine.scan(str(workspace)).where("status <> 'UNCHANGED'").count() == 0
    assert engine.update(str(workspace))["files_scanned"] == 0
    report = engine.query("cipher key")
    assert "crypto.md" in report and "**Matched terms:**" in report
    pointers = json.loads(engine.query("packet header", output="json"))
    assert pointers[0]["file"].endswith("net.md") and len({p["file"] for p in pointers}) == len(pointers)
    assert engine.hubs(5).first()["inbound"] >= 1
    assert engine.object("concept_net").count() == 1 and engine.objects(["concept_net", "nobody"]).count() == 1
    assert engine.context("concept_crypto_basics", 1).count() >= 2
    assert engine.similar([1.0] * 1024, 3).count() == 3
    assert tuple(engine.status(str(workspace)).first()) == (4, 4, 0)

    (workspace / "net.md").write_text("# Net\n\nNow it is all about quantum repeaters and how repeaters extend the reach of a link.\n")
    (workspace / "notes.txt").unlink()
    stats = engine.update(str(workspace))
    assert (stats["files_scanned"], stats["files_deleted"]) == (1, 1)
    assert "net.md" in engine.query("repeaters") and "notes.txt" not in engine.query("wireless")
    assert "concept_notes" not in {r["id"] for r in engine.table("objects").select("id").collect()}
    assert tuple(engine.status().first()) == (4, 3, 1)
    (workspace / "notes.txt").write_text("Plain notes about wireless networks and their packets, long enough to have keywords in them.\n")
    assert engine.update(str(workspace))["files_scanned"] == 1 and "notes.txt" in engine.query("wireless")


def test_two_workspaces(engine, workspace, tmp_path):
    (tmp_path / "other.md").write_text("# Other\n\nGardens need water and light, and every garden has its weeds and its bees.\n")
    engine.rebuild(str(tmp_path))
    assert engine.workspaces() == [str(workspace), str(tmp_path)]
    engine.rebuild(str(workspace))
    assert "other.md" in engine.query("garden bees")  # a rebuild leaves other workspaces alone
    assert set(engine.update_all()) == {str(workspace), str(tmp_path)}
    engine.delete_files([str(tmp_path / "other.md")])
    assert "other.md" not in engine.query("garden bees")


NOTE = "# {0}\n\nA note about {0} and whatever else there is to say about {0} in a vault of notes.\n"


def test_index_of_segments(spark, tmp_path):
    """Updates add segments whose answers are those of an index built at once; a wiped engine is empty and searchable."""
    vault = tmp_path / "vault"
    vault.mkdir()
    words = ["ships", "trains", "bridges", "rivers", "towers"]
    for w in words:
        (vault / f"{w}.md").write_text(NOTE.format(w))
    engine, fresh = Engine(spark, str(tmp_path / "home")), Engine(spark, str(tmp_path / "fresh"))
    engine.rebuild(str(vault))
    (vault / "ships.md").write_text(NOTE.format("boats"))
    (vault / "trains.md").unlink()
    engine.update(str(vault))
    (vault / "lakes.md").write_text(NOTE.format("rivers lakes"))
    engine.update(str(vault))
    index = engine.store.manifest()["index"]
    assert len(index["segments"]) == 3
    fresh.rebuild(str(vault))
    found = lambda e, q: [(r["object_id"], round(r["score"], 9)) for r in e.search(q).collect()]
    for query in ("rivers", "boats note", "ships", "trains", "lakes vault"):
        assert found(engine, query) == found(fresh, query)
    assert {k: index[k] for k in ("n_docs", "n_terms")} == {k: fresh.store.manifest()["index"][k] for k in ("n_docs", "n_terms")}
    nodes, edges = engine.graph_tables()
    assert nodes.where("label = 'File'").count() == 5 and edges.count() == 5
    assert engine.vector_points().select("point_id").distinct().count() == engine.count()
    engine.wipe()
    assert engine.search("rivers").count() == 0 and engine.count() == 0 and engine.query("rivers")
    engine.update(str(vault))
    assert found(engine, "rivers") == found(fresh, "rivers")


def test_a_crash_changes_nothing(spark, tmp_path, monkeypatch):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.md").write_text(NOTE.format("ships"))
    engine = Engine(spark, str(tmp_path / "home"))
    engine.rebuild(str(vault))
    (vault / "a.md").write_text(NOTE.format("trains"))
    for name in ("write", "commit"):  # before the first table is there, and after the last
        with monkeypatch.context() as patch:
            patch.setattr(engine.store, name, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                engine.update(str(vault))
        assert "a.md" in engine.query("ships") and "a.md" not in engine.query("trains")
        assert engine.scan(str(vault)).where("status = 'CHANGED'").count() == 1
    engine.update(str(vault))
    assert "a.md" in engine.query("trains")


def test_ignored_folders_are_not_listed(spark, tmp_path):
    for name in ("a/b/n.md", "a/node_modules/x/m.md", "a/c.md", "d/e.md", "build/z.md", "d/[f]/g.md", ".git/h.md", "top.md", "t.tmp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# x")
    assert files.kept_roots(spark, str(tmp_path), ["*.tmp"]) == ["top.md", "a/c.md", "a/b", "d"]
    assert {r["relative"] for r in files.scan(spark, str(tmp_path), ["*.tmp"]).collect()} == {"a/b/n.md", "a/c.md", "d/e.md", "d/[f]/g.md", "top.md"}
    assert [r["relative"] for r in files.scan(spark, str(tmp_path), only=[f"{tmp_path}/d/[f]/g.md"]).collect()] == ["d/[f]/g.md"]


def test_settings(spark, tmp_path):
    home, vault = tmp_path / "home", tmp_path / "vault"
    home.mkdir()
    vault.mkdir()
    assert config.settings(str(home), str(vault)) == config.Settings()
    (home / "config.yaml").write_text("ignore: ['*.tmp']\nlimit: 3\n")
    (vault / ".tessera.yaml").write_text("ignore: [draft*]\nmax_file_bytes: 20\n")
    assert config.settings(str(home), str(vault)) == config.Settings(("*.tmp", "draft*"), 20, 3)
    for name, text in (("a.md", "# a"), ("draft.md", "# b"), ("big.md", "# c" * 20)):
        (vault / name).write_text(text)
    assert [r["relative"] for r in Engine(spark, str(home)).files(str(vault)).collect()] == ["a.md"]
    (home / "config.yaml").write_text("colour: red\n")
    with pytest.raises(ValueError):
        config.settings(str(home))


def test_staging_needs_a_shared_folder_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        staging.shared_folder(session)
    session.conf = SimpleNamespace(get=lambda *a: "hdfs:///shared/")
    assert staging.shared_folder(session) == "hdfs:///shared"


def test_scope_deletes_what_was_staged(spark):
    with staging.scope():
        kept = staging.stage(spark.range(3).toDF("id"), "scoped")
        place = kept.inputFiles()[0]
        assert kept.count() == 3
    assert not Path(place.removeprefix("file://")).exists()


def test_watch(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.md").write_text("# A\n\nA note about lighthouses and the keepers of lighthouses on the northern coast.\n")
    engine = Engine(spark, str(tmp_path / "home"))
    query = feed.watch_workspace(engine, str(vault), str(tmp_path / "check"))
    query.awaitTermination()
    assert "a.md" in engine.query("lighthouses")


def test_upsert_stream(spark, tmp_path, rows):
    source, target = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"), "id string, v int, seq int")
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "id string, v int, seq int").write.parquet(source)
    stream = lambda: spark.readStream.schema("id string, v int, seq int").parquet(source)
    feed.upsert_stream(stream(), target, ["id"], "seq", str(tmp_path / "c")).awaitTermination()
    assert rows(target.read()) == [("a", 2, 2), ("b", 1, 1)]
    spark.createDataFrame([("b", 5, 3)], "id string, v int, seq int").write.mode("append").parquet(source)
    feed.upsert_stream(stream(), target, ["id"], "seq", str(tmp_path / "c")).awaitTermination()
    assert rows(target.read()) == [("a", 2, 2), ("b", 5, 3)]


def test_windows_over_an_edge_stream(spark, tmp_path):
    import datetime as dt

    data = [("a", "uses", dt.datetime(2024, 1, 1, 5)), ("b", "uses", dt.datetime(2024, 1, 1, 7)), ("c", "is_a", dt.datetime(2024, 1, 2)), ("d", "is_a", None)]
    spark.createDataFrame(data, "source_id string, predicate string, recorded_at timestamp_ntz").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("source_id string, predicate string, recorded_at timestamp_ntz").parquet(str(tmp_path / "e"))
    found = feed.run_to_table(spark, feed.edges_per_window(stream), "edge_windows")
    assert sorted((r["predicate"], r["n"]) for r in found.collect()) == [("is_a", 1), ("uses", 2)]
