import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import signature_tree as st


def shingles(text, k):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def brute(items, k, t):
    found = set()
    for (a, x), (b, y) in combinations(items, 2):
        x, y = shingles(x, k), shingles(y, k)
        if a != b and x and y and len(x & y) / len(x | y) >= t:
            found.add((min(a, b), max(a, b)))
    return found


def collection(seed, n=60, size=(5, 60), vocabulary=40):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts)[1].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = [f"w{rng.randrange(vocabulary)}"] * rng.randint(0, 2)
        else:
            words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(*size))]
        texts.append((f"k{i:03}", " ".join(words) or "w1"))
    return texts


def found(spark, items, k, t, **how):
    frame = spark.createDataFrame(items, "key string, text string")
    return {tuple(r) for r in st.similar_records(frame, "key", "text", k, t, **how).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_texts_against_brute_force(spark, seed):
    items = collection(seed)
    assert found(spark, items, 3, 0.7) == brute(items, 3, 0.7)


@pytest.mark.parametrize("seed", range(3))
def test_small_sets_against_brute_force(spark, seed):
    items = collection(seed + 10, size=(1, 14), vocabulary=25)
    assert found(spark, items, 1, 0.8, combo=3) == brute(items, 1, 0.8)


def test_sets_around_the_size_of_combinations(spark):
    items = collection(5, n=30, size=(40, 62), vocabulary=400)
    assert found(spark, items, 1, 0.8, combo=3) == brute(items, 1, 0.8)


def test_cut_cells(spark):
    """Cells larger than a block are searched block by block and give the same pairs."""
    items = collection(7, n=80)
    frame = spark.createDataFrame(items, "key string, text string")
    texts, _ = st.distinct_texts(frame, "key", "text", 3)
    whole = {tuple(r) for r in st.similar_texts(texts, 3, 0.7).select("a", "b").collect()}
    assert whole and whole == {tuple(r) for r in st.similar_texts(texts, 3, 0.7, block=2, parts=3).select("a", "b").collect()}


def test_cut_cells_of_combinations(spark):
    """Paths that share all their rare words are searched by several tasks and give the same pairs."""
    rng = random.Random(3)
    items = [(f"k{i:03}", " ".join([f"w{k}" for k in range(9)] + [f"x{rng.randrange(6)}" for _ in range(rng.randint(0, 3))])) for i in range(60)]
    texts, _ = st.distinct_texts(spark.createDataFrame(items, "key string, text string"), "key", "text", 1)
    texts = texts.persist()
    whole = {tuple(r) for r in st.similar_texts(texts, 1, 0.8, combo=3).select("a", "b").collect()}
    assert whole and whole == {tuple(r) for r in st.similar_texts(texts, 1, 0.8, combo=3, block=5, parts=4).select("a", "b").collect()}
    size = 1 << 16
    cells = st._cells(spark.sparkContext.broadcast(st.token_counts(texts, 1, size)), 1, 0.8, 3)
    assert st.cut_plan(texts, cells, 10_000, size) is None
    cuts = {r["id"]: dict(zip(r["cut"], r["blocks"], strict=True)) for r in st.cut_plan(texts, cells, 5, size).collect()}
    assert len(cuts) == texts.count() and max(n for c in cuts.values() for n in c.values()) == -(-texts.count() // 5)


def test_counters():
    assert [st.counter_size(n) for n in (0, 10**6, 10**8, 10**15)] == [1 << 16, 1 << 16, 1 << 23, 1 << 24]


@pytest.mark.parametrize("fanout", [2, 6])
def test_traversal_prunes_nothing_that_counts(fanout):
    rng = np.random.default_rng(1)
    bases = [rng.permutation(60)[: rng.integers(8, 40)] for _ in range(12)]
    sets = [np.unique(np.append(rng.permutation(bases[rng.integers(12)])[2:], rng.integers(0, 60, 3))).astype(np.uint64) << np.uint64(40) for _ in range(70)]
    sig = np.stack([np.packbits(np.isin(np.arange(64), (s >> np.uint64(40)).astype(int) % 64)) for s in sets])
    n = np.array([len(s) for s in sets])
    order = np.argsort(n)
    sig, n, sets = sig[order], n[order], [sets[i] for i in order]
    levels = st.grow(np.ascontiguousarray(sig), n, np.array([0, 31]), fanout)
    got = {(min(x, y), max(x, y)) for a, b in st.traverse(levels, np.array([[0, 0], [1, 1], [0, 1]]), 0.5, lambda a, b: np.ones(len(a), bool), chunk=50) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, j in combinations(range(70), 2) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.5}
    assert want and want <= got and len(got) < 70 * 69 / 2


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    items = [("a", None), ("b", ""), ("c", "one two"), ("d", "one two"), (None, long), ("e", long), ("f", long + " y"), ("e", long), ("g", "One, two; THREE"), ("h", "one two three"), ("g", "other words here now")]
    assert found(spark, items, 3, 0.7) == {("e", "f"), ("g", "h")}
    assert found(spark, items[:4], 1, 0.8, combo=3) == {("c", "d")}
    assert found(spark, [("a", None)], 3, 0.7) == set()
    with pytest.raises(ValueError):
        found(spark, items, 1, 0.7, combo=3)


def test_classes(spark):
    items = [("a", "a b c d e f g h i j k l"), ("b", "a b c d e f g h i j k l"), ("c", "a b c d e f g h i j k l m"), ("d", "x y z x y z u v w")]
    frame = spark.createDataFrame(items, "key string, text string").withColumn("id", F.lit(3))
    rows = {r["key"]: (r["class"], r["n_links"]) for r in st.similar_classes(frame, "key", "text").collect()}
    assert rows["a"] == rows["b"] and rows["a"][1] == 1 and rows["c"][1] == 1 and rows["d"][1] == 0 and len({c for c, _ in rows.values()}) == 3


def test_classes_of_short_texts(spark):
    items = [("a", "one two"), ("b", "One, two!"), ("c", "one"), ("d", "***"), ("e", "***"), ("f", "- - - - - -"), ("g", " \t"), ("h", ""), ("i", None), ("j", "a b c d e"), ("k", "a b c d e"), (None, "one")]
    rows = {r["key"]: (r["class"], r["n_links"]) for r in st.similar_classes(spark.createDataFrame(items, "key string, text string"), "key", "text").collect()}
    classes = {}
    for key, (name, _) in sorted(rows.items()):
        classes.setdefault(name, []).append(key)
    assert sorted(classes.values()) == [["a", "b"], ["c"], ["d", "e"], ["f"], ["j", "k"]]
    assert {n for _, n in rows.values()} == {0}
