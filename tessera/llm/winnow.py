"""Evaluation passages in training text, by winnowing.

Words of the text in its common form are hashed, every run of ``gram`` words is a k-gram, and of
each ``window`` consecutive k-grams the rightmost smallest hash is kept. Two texts that share
``gram + window - 1`` consecutive words share at least one kept hash, so no sufficiently long span
is missed. Fingerprints are joined on their hash; hits are extended to the longest common span of
words on their diagonal (the distance of the two positions), which alone decides. A document and an
item have as many diagonals as words at most, however often a word is repeated in both.

Corpus fingerprints (about two for every ``window + 1`` words) carry only a hash, a key and a
position; they meet the test fingerprints in an equi-join in which the optimiser broadcasts the test
side while its measured size allows, and shuffles by hash beyond. Only documents with a hit are read
a second time.

Defined results: null texts and texts shorter than the span have no hits; a document is reported once
per item; repeated passages are reported under each of their ids; texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lookalike import fold
from tessera.staging import stage

GRAM, WINDOW = 7, 7
WORD = regex.compile(r"[\p{L}\p{N}]+")
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str) -> list[str]:
    return WORD.findall(fold(text).lower())


class WordHashes:
    """64-bit hashes of words, kept for the words seen last."""

    def __init__(self, keep: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.keep = keep

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(words) - known.keys():
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` word hashes."""
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = out * BASE + hashes[k : k + n]
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def winnow(hashes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept: the rightmost smallest k-gram of every window."""
    g = grams(hashes, gram)
    if len(g) < window:
        return np.empty(0, np.int64), g[:0]
    views = np.lib.stride_tricks.sliding_window_view(g[::-1], window)
    at = np.unique(len(g) - 1 - (np.arange(len(views)) + views.argmin(axis=1)))
    return at, g[at]


def fingerprint_batches(gram: int, window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHashes()
        for batch in batches:
            keys, positions, prints = [], [], []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                at, kept = winnow(hashed(text.split() if text.isascii() else words_of(text)), gram, window)
                if len(at):
                    keys.append(key)
                    positions.append(at.astype(np.int32))
                    prints.append(kept.view(np.int64))
            yield pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in (("key", keys), ("pos", positions), ("print", prints))})

    return run


def plain_words(text: Column) -> Column:
    """Plain text as its words with blanks between them, other text as it is."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), text).otherwise(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def fingerprints(df: DataFrame, key: str, text: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, print, pos), one row per kept k-gram."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), plain_words(F.col(text)).alias("text"))
    kept = rows.mapInPandas(fingerprint_batches(gram, window), f"key {dict(rows.dtypes)['key']}, pos array<int>, print array<long>")
    return kept.select("key", F.explode(F.arrays_zip("print", "pos")).alias("x")).select("key", "x.print", "x.pos")


def longest_span(left: np.ndarray, right: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """(length, start left, start right) of the longest common run of words on any of the diagonals (position left minus position right)."""
    best = (0, 0, 0)
    for d in sorted(diagonals):
        a, b = max(d, 0), max(-d, 0)
        n = min(len(left) - a, len(right) - b)
        same = np.concatenate([[False], left[a : a + n] == right[b : b + n], [False]])
        borders = np.flatnonzero(same[1:] != same[:-1])
        if len(borders):
            starts, lengths = borders[::2], borders[1::2] - borders[::2]
            k = int(lengths.argmax())
            best = max(best, (int(lengths[k]), -(a + int(starts[k])), -(b + int(starts[k]))))
    return best[0], -best[1], -best[2]


def leaked_passages(corpus: DataFrame, tests: DataFrame, corpus_key: str, corpus_text: str, test_key: str, test_text: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc, item, n_words, doc_word, item_word) of every document and test item with a span of ``gram + window - 1`` words or more."""
    span = gram + window - 1
    items = stage(fingerprints(tests, test_key, test_text, gram, window).select(F.col("key").alias("item"), "print", F.col("pos").alias("item_pos")), "test-prints")
    hits = fingerprints(corpus, corpus_key, corpus_text, gram, window).join(items, "print")
    hits = hits.groupBy(F.col("key").alias("doc"), "item").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))
    hits = stage(hits, "hits")
    texts = corpus.select(F.col(corpus_key).alias("doc"), F.col(corpus_text).alias("text"))
    passages = tests.select(F.col(test_key).alias("item"), F.col(test_text).alias("passage")).where("passage is not null")
    joined = texts.join(hits, "doc").join(passages, "item")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, last, words = [], None, np.empty(0, object)
            for doc, item, text, passage, diagonals in zip(batch["doc"], batch["item"], batch["text"], batch["passage"], batch["diagonals"], strict=True):
                if last != (doc, text):
                    last, words = (doc, text), np.array(words_of(text), object)
                n, a, b = longest_span(words, np.array(words_of(passage), object), list(diagonals))
                if n >= span:
                    rows.append((doc, item, n, a, b))
            yield pd.DataFrame(rows, columns=["doc", "item", "n_words", "doc_word", "item_word"])

    kinds = dict(joined.dtypes)
    return joined.mapInPandas(extend, f"doc {kinds['doc']}, item {kinds['item']}, n_words int, doc_word int, item_word int").distinct()
