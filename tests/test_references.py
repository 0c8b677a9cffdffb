import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import references as ref

T = dt.datetime(2024, 3, 5, 12)
SECONDS = 1709640000  # T in UTC


def tables(spark, edges, meta=(), state=(), catalog=()):
    return (
        spark.createDataFrame(list(edges), "source_id string, target_id string, predicate string, recorded_at timestamp_ntz"),
        ref.parent_states(
            spark.createDataFrame(list(meta), "object_id string, file_path string"),
            spark.createDataFrame(list(state), "file_path string, indexed_at long, status string"),
            spark.createDataFrame(list(catalog), "object_id string"),
        ),
    )


META = [("ok", "/ok"), ("ok", "/ok"), ("gone", "/gone"), ("late", "/late"), ("nopath", None), ("norecord", "/none"), (None, "/x"), ("tie", "/tie")]
STATE = [("/ok", 1, "ACTIVE"), ("/gone", 1, "ACTIVE"), ("/gone", 2, "deleted"), ("/late", SECONDS + 1, "ACTIVE"), ("/back", 1, "DELETED"), ("/tie", 2, "ACTIVE"), ("/tie", 2, " DELETED ")]


def test_reasons(spark, rows):
    ends = ["ok", "gone", "late", "nopath", "norecord", "concept", "nobody", "", "  ", None, "OK", "tie"]
    edges, parents = tables(spark, [("ok", e, "uses", T) for e in ends] + [("ok", "late", "uses", None), ("ok", "nobody", None, None), ("ok", "nobody", "uses", T)], META, STATE, [("concept",)])
    found = {(e, m, r, t, p) for e, m, r, _, t, p in rows(ref.orphan_references(edges, parents))}
    assert found == {
        ("target_id", "2024-03", "deleted", "gone", "uses"), ("target_id", "2024-03", "late", "late", "uses"), ("target_id", "2024-03", "missing", "nobody", "uses"),
        ("target_id", "unknown", "missing", "nobody", None), ("target_id", "2024-03", "missing", "OK", "uses"), ("target_id", "2024-03", "deleted", "tie", "uses"),
    }


def test_empty_tables(spark):
    edges, parents = tables(spark, [], META, STATE)
    assert ref.orphan_references(edges, parents).count() == 0
    edges, parents = tables(spark, [("a", "b", "uses", T)])
    assert {r["reason"] for r in ref.orphan_references(edges, parents).collect()} == {"missing"}


def test_hot_key_many_ranges(spark):
    edges = spark.range(3000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("target_id"), F.lit("uses").alias("predicate"), F.lit(T).alias("recorded_at"))
    parents = spark.range(0, 3000, 2).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("key"), F.lit(0).alias("gone"), F.lit(ref.NEVER).alias("first_seen"))
    refs = edges.select(F.explode(F.array("source_id", "target_id")).alias("key")).groupBy("key").agg(F.lit(1).cast("long").alias("earliest"))
    states = {r["key"]: r["state"] for r in ref.probe_parents(refs, parents, ranges=13).collect()}
    assert len(states) == refs.count() and sum(states.values()) == 1500 and states["hot"] == 0 and states["s2"] == 1
    report = ref.orphan_report(ref.orphan_references(edges, parents)).where("end_name = 'target_id'").first()
    assert (report["n_references"], report["n_keys"]) == (3000, 2001)


def test_extra_columns(spark):
    edges, parents = tables(spark, [("a", "b", "uses", T)], [("a", None)])
    edges = edges.withColumns({"key": F.lit(1), "state": F.lit(2), "reason": F.lit("x"), "micros": F.lit(0)})
    assert [r["target_id"] for r in ref.orphan_references(edges, parents).collect()] == ["b"]
