import pytest
from pyspark.sql import functions as F

from tessera.llm import mixture as mx

TARGETS = "source string, target_share double, max_repeats int"


def records(spark, sizes):
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, (count, n) in sizes.items() for _ in range(count))]
    return spark.createDataFrame(rows, "key long, source string, n_tokens long")


def test_shares_are_reached(spark):
    data = records(spark, {"a": (2000, 100), "b": (1000, 50), "c": (300, 10)})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], TARGETS)
    mixture = mx.mix(data, targets, total_tokens=200_000, block_tokens=500)
    report = {r["source"]: r for r in mx.reached_shares(mixture, data, targets).collect()}
    # c has three times all it has; the others share what it leaves, 5 to 3
    assert report["c"]["n_tokens"] == 9_000 and report["c"]["max_copies"] == 3 and report["c"]["n_uses"] == 900
    assert report["b"]["n_tokens"] == 71_625 and report["a"]["n_tokens"] == 119_375
    uses = mixture.where("first_token = 0").groupBy("source", "key").count().groupBy("source").agg(F.min("count").alias("least"), F.max("count").alias("most")).collect()
    assert all(r["most"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] and r["most"] - r["least"] <= 1 for r in uses)
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)


def test_budgets():
    totals = [{"source": s, "weight": w, "max_repeats": r, "n_tokens": n} for s, w, r, n in [("a", 0.5, 1, 100), ("b", 0.3, 2, 1000), ("c", 0.2, 4, 10), ("d", 0.0, 1, 50), ("e", 0.1, 1, 0)]]
    assert mx.budgets_of(totals, 1000) == {"a": 100, "c": 40, "b": 860}
    assert mx.budgets_of(totals, 100_000) == {"a": 100, "b": 2000, "c": 40} and mx.budgets_of([], 10) == {} and mx.budgets_of(totals, 0) == {}


def test_every_stretch_is_mixed(spark, monkeypatch):
    monkeypatch.setattr(mx, "RANGE_SLOTS", 97)
    slots = mx.slot_schedule(spark, {"a": 750, "b": 247, "c": 3})
    rows = sorted(tuple(r) for r in slots.collect())
    assert [r[0] for r in rows] == list(range(1000))  # no slot is empty
    for source, n in (("a", 750), ("b", 247), ("c", 3)):
        assert [block for _, s, block in rows if s == source] == list(range(n))
    for at in range(0, 1000, 100):
        assert abs(sum(s == "a" for _, s, _ in rows[at : at + 100]) - 75) <= 3


@pytest.mark.parametrize("buckets", [1, 7])
def test_blocks_are_equal(spark, buckets):
    """Also where records are longer than a block, and over the end of the stream."""
    data = records(spark, {"a": (997, 7), "b": (10, 1000), "e": (3, 0)})
    sizes = spark.createDataFrame([("a", 10_000, 6979), ("b", 10_000, 10_000)], "source string, budget long, all_tokens long")
    uses = mx.uses_of(mx.offsets_of(data, buckets), sizes, 300).collect()
    blocks, pieces = {}, {}
    for u in uses:
        blocks[u["source"], u["block"]] = blocks.get((u["source"], u["block"]), 0) + u["n_tokens"]
        pieces.setdefault((u["source"], u["copy"], u["key"]), []).append((u["first_token"], u["n_tokens"]))
    assert blocks == {(s, k): 300 if k < 33 else 100 for s in "ab" for k in range(34)}
    for (source, copy, _), parts in pieces.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == {"a": 7, "b": 1000}[source] or (source, copy) == ("a", 1)


def test_one_record_of_a_third_of_all_tokens(spark):
    data = records(spark, {"a": (1, 100_000), "b": (2000, 100)})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS)
    mixture = mx.mix(data, targets, block_tokens=1000)
    assert {r["n"] for r in mixture.groupBy("slot").agg(F.sum("n_tokens").alias("n")).collect()} == {1000}
    assert {r["source"]: r["n_tokens"] for r in mx.reached_shares(mixture, data, targets).collect()} == {"a": 150_000, "b": 150_000}


def test_tokens(spark):
    frame = spark.createDataFrame([(1, "A", "hello world"), (2, "a ", ""), (3, "A-b", "x"), (4, None, "x"), (5, "a", None), (6, "zzz", "x"), (7, "a", "word " * 200_000)], "id long, src string, body string").withColumn("n_tokens", F.lit(99))
    targets = spark.createDataFrame([("a", 0.5, 1), ("a_b", 0.5, 1), ("none", 0.0, 1)], TARGETS)
    sized = {r["key"]: (r["source"], r["n_tokens"]) for r in mx.sized_records(frame, targets, "id", "src", "body").collect()}
    assert sized == {1: ("a", 2), 2: ("a", 0), 3: ("a_b", 1), 7: ("a", 200_001)}


def test_empty(spark):
    data = records(spark, {"a": (1, 1)}).limit(0)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mx.mix(data, targets).count() == 0
    assert [tuple(r) for r in mx.reached_shares(mx.mix(data, targets), data, targets).collect()] == [("a", 1.0, 0.0, 0, 0, 0, 0)]
