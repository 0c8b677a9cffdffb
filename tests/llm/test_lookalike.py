import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.llm import lookalike as lk


def canonical(spark, items):
    frame = spark.createDataFrame(items, "doc_id long, text string")
    return {r["key"]: r["canonical"] for r in lk.canonical_texts(frame, "doc_id", "text").collect()}


def pairs(spark, items):
    frame = spark.createDataFrame(items, "doc_id long, text string")
    return {tuple(r) for r in lk.lookalike_pairs(lk.canonical_texts(frame, "doc_id", "text")).collect()}


SAME = [
    "The café shows efficient flags, one-way",
    "The café shows efficient flags, one-way",
    "Ｔｈｅ café ｓｈｏｗｓ efﬁcient ﬂags， one‑way",
    "The café shows  efficient\tflags, one-way  ",
    "Тhе cаfé shоws effісіеnt flаgs, оne-way",
    "T​he c­afé sh⁠ows ﻿efficient flags, one-way",
]
OTHER = ["The cafe shows efficient flags, one-way", "the café shows efficient flags, one-way", "The café shows efficient flags, oneway", "The café shows efficient flags one-way", "The café\nshows efficient flags, one-way"]


def test_pairs(spark):
    items = list(enumerate(SAME + OTHER))
    n = len(SAME)
    assert pairs(spark, items) == {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert set(canonical(spark, items[:n]).values()) == {SAME[0]}


def test_canonical_spelling_is_the_collections(spark):
    words = "после обеда каталог пуст"
    done = canonical(spark, [(1, words), (2, words), (3, words.replace("о", "o")), (4, "soo aсе"), (5, "ace")])
    assert done[1] == done[2] == done[3] == words and done[4] == "soo ace"


def test_words_with_all_look_alikes_replaced(spark):
    """Such a word is its own folded form, but not the spelling that stands for its class."""
    clean, folded = "после обеда", lk.fold("после обеда")
    assert lk.fold(folded) == folded != clean
    assert pairs(spark, [(1, clean), (2, folded), (3, clean.replace("о", "o"))]) == {(1, 2), (1, 3), (2, 3)}


def test_copies_are_no_pairs(spark):
    assert pairs(spark, [(1, "a b"), (2, "a b"), (3, "a b"), (4, "a b")]) == {(1, 3), (1, 4), (2, 3), (2, 4)}


def test_edges(spark):
    long = "réseau " * 50_000
    items = [(1, None), (2, ""), (3, " \n"), (4, "​"), (5, long), (6, unicodedata.normalize("NFD", long)), (7, "a\r\nb"), (8, "a\nb")]
    done = canonical(spark, items)
    assert 1 not in done and done[2] == done[3] == done[4] == ""
    assert pairs(spark, items) == {(2, 3), (2, 4), (3, 4), (5, 6), (7, 8)}
    assert pairs(spark, [(1, None)]) == set()


@pytest.mark.parametrize(("token", "word"), [("cаt", "cat"), ("ｃat", "cat"), ("c​at", "cat"), ("Cat", None), ("cät", None), ("cart", None)])
def test_trie(token, word):
    trie = lk.SpellingTrie()
    for w in ("cat", "car", "cast"):
        trie.add(w, 1)
    assert [w for _, w, _ in trie.accept(token)] == ([word] if word else [])


def test_trie_with_budget():
    trie = lk.SpellingTrie()
    for w in ("cat", "cart", "dog"):
        trie.add(w, 1)
    assert {(w, c) for c, w, _ in trie.accept("cаrd", 2)} == {("cart", 1), ("cat", 2)}


def test_well_formed():
    assert lk.well_formed("каталог") and lk.well_formed("naïve") and not lk.well_formed("кaталог") and not lk.well_formed("naı̈ve​") and not lk.well_formed("ｘ")


def test_without_tries_letters_keep_their_script(spark, monkeypatch):
    """The table alone resolves characters, but it is the traversal that finds the spelling of a look-alike letter."""
    items = [(1, "a plain gateway"), (2, "a plain gаtеway"), (3, "a plain ｇateway"), (4, "a ріаіn gateway"), (5, "a рlаin gateway"), (6, "a рlain gаteway")]
    every = {(i, j) for i in (1, 2, 3, 5, 6) for j in (2, 3, 5, 6) if i < j}
    assert pairs(spark, items) == every
    table = F.udf(lk.table_form)
    monkeypatch.setattr(lk, "spelling_map", lambda docs, changed: changed.select("token").distinct().withColumn("spelling", table("token")))
    assert pairs(spark, items) == {(1, 3)}


@pytest.mark.parametrize("few", [0, 500_000])
def test_spellings_that_no_plain_word_stands_for(spark, monkeypatch, few):
    """Mixed words meet in their most frequent spelling, whether skeletons are sent to the readers or joined; tries may be many."""
    monkeypatch.setattr(lk, "BROADCAST_SKELETONS", few)
    items = [(i, "кaтalог") for i in range(3)] + [(3, "kатaлoг"), (4, "katалог"), (5, "каталог aсe ace")]
    docs = spark.createDataFrame(items, "key long, text string")
    changed = docs.select(F.explode(F.split("text", " ")).alias("token")).withColumn("folded", lk.folded("token")).where("token <> 'ace'")
    spelled = {r["token"]: r["spelling"] for r in lk.spelling_map(docs, changed, trie_words=1).collect()}
    assert spelled["aсe"] == "ace" and spelled["каталог"] == "каталог"
    assert {t for t in spelled if lk.fold(t) == lk.fold("каталог")} == {t for t, s in spelled.items() if s == "каталог"}
