import random

import numpy as np
import pytest

from tessera.llm import winnow as wn


def brute(docs, items, span=13):
    found = set()
    for d, text in docs:
        words = wn.words_of(text) if text else []
        runs = {tuple(words[i : i + span]) for i in range(len(words) - span + 1)}
        for i, passage in items:
            w = wn.words_of(passage) if passage else []
            if any(tuple(w[k : k + span]) in runs for k in range(len(w) - span + 1)):
                found.add((d, i))
    return found


def leaks(spark, docs, items):
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    return {(r["doc"], r["item"]): r["n_words"] for r in wn.leaked_passages(a, b, "doc_id", "text", "item_id", "passage").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(30)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 40)))) for i in range(30)]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.randint(0, 60))]
        passage = rng.choice(items)[1].split()
        at, n = rng.randrange(len(passage)), rng.randint(8, 20)
        text[len(text) // 2 : len(text) // 2] = passage[at : at + n]
        docs.append((d, " ".join(text)))
    found = leaks(spark, docs, items)
    assert set(found) == brute(docs, items) and found


def test_every_span_shares_a_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(200):
        span = rng.integers(0, 5, 13).astype(np.uint64)
        left = np.concatenate([rng.integers(0, 5, 9).astype(np.uint64), span, rng.integers(0, 5, 5).astype(np.uint64)])
        right = np.concatenate([rng.integers(0, 5, 3).astype(np.uint64), span, rng.integers(0, 5, 30).astype(np.uint64)])
        assert set(wn.winnow(left)[1].tolist()) & set(wn.winnow(right)[1].tolist())


def test_looks_and_lengths(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen"
    look = passage.replace("o", "о").replace("three", "thr​ee").replace("nine", "ｎｉｎｅ").replace(" ", " ")
    docs = [(1, "x " + passage.upper() + "!"), (2, look), (3, passage.replace("seven", "sevem")), (4, None), (5, ""), (6, passage.rsplit(" ", 1)[0]), (7, ("filler words " * 30_000) + passage), (8, passage), (8, passage)]
    found = leaks(spark, docs, [(1, passage), (2, passage), (3, None), (4, "short")])
    assert found == {(d, i): 13 for d in (1, 2, 7, 8) for i in (1, 2)}
    assert leaks(spark, [(1, None)], [(1, passage)]) == {}


def test_longest_span():
    left, right = np.array(list("abcdefgh") + list("xyz"), object), np.array(list("__bcdefg_") + list("xyz"), object)
    assert wn.longest_span(left, right, [-1]) == (6, 1, 2) and wn.longest_span(left, right, [0, -1, 5]) == (6, 1, 2) and wn.longest_span(left, right, []) == (0, 0, 0)


def test_one_word_repeated(spark):
    """Every gram is kept, but a pair has no more diagonals than words."""
    assert leaks(spark, [(1, "one " * 3000), (2, "one " * 12)], [(1, "one " * 40), (2, "one " * 13)]) == {(1, 1): 40, (1, 2): 13}
