"""Near-duplicate records by signature trees.

Every record is a set of hashed shingles. Trees hold, per node, the OR of the token bitmaps below
it, the range of set sizes, and the most tokens that one record loses to shared bits. Two trees are
traversed together; a pair of nodes is left when the largest overlap that any pair of records below
it could have is too small for the threshold:

    overlap(x, y) <= bits in both OR bitmaps + min(tokens lost to shared bits)

A collection is cut into a forest of such trees by *cells*: a record stands in the cell of each of
its rarest tokens (as many as a similar record could lack, plus one), or, for small sets, of each
combination of ``combo`` of them. Any two records over the threshold share a cell, so the forest
finds what one tree over all records would. Rarity comes from hashed counts, one counter for some
tokens, which decide only how large cells get, never what is found.

Exact copies are collapsed before anything else. A cell of any kind that holds more than ``block``
records is cut into blocks, and each pair of blocks is a tree pair of its own. Which cells these are
is counted: hashed counts are never too small, so only cells over the limit there are counted one by
one. A bitmap travels once per record and partition. Candidates that survive the bound are compared
exactly, as strings.

Defined results: null texts and texts with fewer words than a shingle have no pairs; repeated rows
give one pair; a key with several texts takes part with each of them; ties need no rule, as every
pair counts by its own similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.winnow import WordHashes, grams
from tessera.staging import small_enough, stage

#: Tokens for each counter of the rarity table, its least and greatest size as powers of two (four bytes a counter, on the driver
#: and in each worker: 64 MB at most; beyond, counters hold more tokens and cells of common tokens are cut), and its slices.
COUNTER_TOKENS, LEAST_BITS, MOST_BITS, SLICES, SLOT_SHIFT = 16, 16, 24, 32, np.uint64(20)
#: Characters of a word, about.
WORD_CHARS = 6
#: Bits of a record's signature, children of a node, pairs handled at once, records of a block.
BITS, FANOUT, CHUNK, BLOCK = 512, 6, 200_000, 20_000
#: Texts for each partition of the forest.
PART_TEXTS = 25_000
#: Candidate ids up to this number (some 10 MB) are broadcast.
BROADCAST_IDS = 500_000
#: Sets larger than this are never routed by combinations.
COMBO_SIZE = 48
EPS = 1e-9


def normal_words(column: Column) -> Column:
    """Words (maximal runs of letters and digits, lower case) with one space between them."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def token_stream(texts: list[str], shingle: int, hashed: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, text): the hashed shingles of all texts in a row, with repeats, and the number of the text of each."""
    words = [t.split(" ") for t in texts]
    text = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    tokens = grams(hashed(list(chain.from_iterable(words))), shingle)
    if not len(tokens):
        return tokens, text[:0]
    inside = text[: len(tokens)] == text[shingle - 1 :]
    return tokens[inside], text[: len(tokens)][inside]


def needed(threshold: float, a, b):
    """The least overlap of two sets of these sizes that reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - EPS)


# ---- rarity -------------------------------------------------------------------------------------


def _slot(tokens: np.ndarray, size: int) -> np.ndarray:
    """The counter of a token (or of a key made from it) among ``size``, a power of two."""
    return ((tokens >> SLOT_SHIFT) & np.uint64(size - 1)).astype(np.int64)


def _counters(keys_of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> Callable:
    """Compressed slices of the counts of what ``keys_of`` finds in each batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(_slot(keys_of(batch), size), minlength=size)
        blobs = [(i, zlib.compress(part.astype(np.uint32).tobytes(), 1)) for i, part in enumerate(np.split(counts, SLICES)) if part.any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([i for i, _ in blobs], pa.int32()), "counts": pa.array([b for _, b in blobs], pa.binary())})

    return run


def _add_counts(part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64) for blob in part["counts"])
    return pd.DataFrame({"slice": [part["slice"].iloc[0]], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})


def hashed_counts(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Counts of hashed keys over all rows, in ``size`` counters."""
    schema = "slice int, counts binary"
    slices = rows.mapInArrow(_counters(keys_of, size), schema).groupBy("slice").applyInPandas(_add_counts, schema).collect()
    counts = np.zeros((SLICES, size // SLICES), np.uint32)
    for row in slices:
        counts[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return counts.reshape(-1)


def counter_size(tokens: int) -> int:
    return 1 << min(MOST_BITS, max(LEAST_BITS, (max(1, tokens) // COUNTER_TOKENS).bit_length()))


def token_counts(texts: DataFrame, shingle: int, size: int) -> np.ndarray:
    """Counts of hashed tokens over all texts."""
    hashed = WordHashes()
    return hashed_counts(texts.select("words"), lambda batch: token_stream(batch.column("words").to_pylist(), shingle, hashed)[0], size)


# ---- cells --------------------------------------------------------------------------------------


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def ordered_sets(tokens: np.ndarray, text: np.ndarray, n_texts: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): each text's distinct tokens, the rarest first; a key is 16 bits of rarity (the logarithm of the count) and 48 of the token."""
    rarity = np.minimum(np.log2(1.0 + counts[_slot(tokens, len(counts))]) * 2048, 65535).astype(np.uint64)
    keys = (rarity << np.uint64(48)) | (tokens >> np.uint64(16))
    starts = np.searchsorted(text, np.arange(n_texts + 1))
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        keys[lo:hi].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], np.concatenate([[0], np.cumsum(new)])[starts]


def cells_of(keys: np.ndarray, starts: np.ndarray, threshold: float, combo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, rank, key) of every cell that a set stands in; ``rank``: tokens that come before the cell's last one and are not in it."""
    n = np.diff(starts)
    prefix = n - np.ceil(threshold * n - EPS).astype(np.int64) + 1
    texts, cells, ranks, firsts = [], [], [], []
    single = (n > 0) if combo == 1 else (n > 0) & (n >= threshold * COMBO_SIZE)
    if single.any():
        take = np.where(single, prefix, 0)
        text = np.repeat(np.arange(len(n)), take)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(take) - take, take)
        key = keys[starts[text] + rank]
        texts.append(text), cells.append(_mix(key)), ranks.append(rank), firsts.append(key)
    if combo > 1:
        small = (n > 0) & (n <= COMBO_SIZE)
        width = np.where(n <= combo, n, np.minimum(n, prefix + combo - 1))
        for m in np.unique(width[small]):
            which = np.flatnonzero(small & (width == m))
            table = keys[starts[which][:, None] + np.arange(m)]
            chosen = np.array(list(combinations(range(m), min(m, combo))))
            key = np.full((len(which), len(chosen)), np.uint64(m if m < combo else 0))
            for k in range(chosen.shape[1]):
                key = _mix(key * np.uint64(31) + table[:, chosen[:, k]])
            texts.append(np.repeat(which, len(chosen))), cells.append(key.reshape(-1))
            ranks.append(np.tile(chosen[:, -1] - chosen.shape[1] + 1, len(which))), firsts.append(np.zeros(key.size, np.uint64))
    return np.concatenate(texts), np.concatenate(cells), np.concatenate(ranks), np.concatenate(firsts)


def signatures(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of packed bits for each set."""
    bits = np.zeros((len(starts) - 1, BITS), bool)
    bits[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), ((keys >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def cut_cells(ids: np.ndarray, text, cell, rank, blocks) -> tuple:
    """Cells of more than one block: one derived cell for each pair of the record's block with another; side 0, 1, or -1 for whole trees."""
    cut = np.flatnonzero(blocks > 1)
    kept = np.flatnonzero(blocks <= 1)
    b = blocks[cut]
    row = np.repeat(cut, b)
    other = (np.arange(len(row)) - np.repeat(np.cumsum(b) - b, b)).astype(np.uint64)
    own = _mix(ids[text[row]].astype(np.uint64)) % np.repeat(b, b).astype(np.uint64)
    low, high = np.minimum(own, other), np.maximum(own, other)
    derived = _mix(cell[row] ^ _mix(low * np.uint64(1 << 20) + high + np.uint64(1)))
    side = np.concatenate([np.full(len(kept), -1, np.int8), np.where(own == other, -1, own > other).astype(np.int8)])
    return np.concatenate([text[kept], text[row]]), np.concatenate([cell[kept], derived]), np.concatenate([rank[kept], rank[row]]), side


def _blobs(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """``values`` cut at ``borders``, as binary values, without a copy per value."""
    offsets = (borders * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _cells(counts, shingle: int, threshold: float, combo: int) -> Callable:
    """ids, (keys, starts) and (text, cell, rank) of the records of a batch."""
    hashed = WordHashes()

    def of(batch: pa.RecordBatch) -> tuple:
        ids = batch.column("id").to_numpy()
        tokens, text = token_stream(batch.column("words").to_pylist(), shingle, hashed)
        keys, starts = ordered_sets(tokens, text, len(ids), counts.value)
        text, cell, rank, _ = cells_of(keys, starts, threshold, combo)
        return ids, keys, starts, text, cell, rank

    return of


def cut_plan(texts: DataFrame, cells: Callable, block: int, size: int) -> DataFrame | None:
    """(id, cut, blocks): of each record the cells with more than ``block`` records, and into how many blocks they are cut. None if there are none."""
    upper = hashed_counts(texts, lambda batch: cells(batch)[4], size)
    if upper.max(initial=0) <= block:
        return None
    full = texts.sparkSession.sparkContext.broadcast(upper > block)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, _, text, cell, _ = cells(batch)
            kept = full.value[_slot(cell, size)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[text[kept]]), pa.array(cell[kept].view(np.int64))], names=["id", "cell"])

    rows = stage(texts.mapInArrow(suspects, "id long, cell long"), "suspects")
    large = stage(rows.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        return None
    if small_enough(large, BROADCAST_IDS):
        large = F.broadcast(large)
    return rows.join(large, "cell").groupBy("id").agg(F.collect_list("cell").alias("cut"), F.collect_list("blocks").alias("blocks"))


def _blocks(cell: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Into how many blocks each of the cells is cut."""
    names, at = np.unique(batch.column("cut").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_index=True)
    if not len(names):
        return np.ones(len(cell), np.int64)
    counts = batch.column("blocks").flatten().to_numpy(zero_copy_only=False).astype(np.int64)[at]
    found = np.minimum(np.searchsorted(names, cell), len(names) - 1)
    return np.where(names[found] == cell, counts[found], 1)


def _emit(cells: Callable, parts: int) -> Callable:
    """Rows (part, id, n, sig, cells, ranks, sides): what of a record belongs to a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4_000):
                part = batch.slice(lo, 4_000)
                ids, keys, starts, text, cell, rank = cells(part)
                side = np.full(len(cell), -1, np.int8)
                if "cut" in part.schema.names:
                    blocks = _blocks(cell, part)
                    if (blocks > 1).any():
                        text, cell, rank, side = cut_cells(ids, text, cell, rank, blocks)
                where = (_mix(cell) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(text * parts + where, kind="stable")
                text, cell, rank, side, where = text[order], cell[order], rank[order], side[order], where[order]
                first = np.flatnonzero(np.insert((text[1:] != text[:-1]) | (where[1:] != where[:-1]), 0, True)) if len(text) else np.zeros(0, np.int64)
                borders, of = np.append(first, len(text)), text[first]
                sig = signatures(keys, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where[first].astype(np.int32)),
                        pa.array(ids[of]),
                        pa.array(np.diff(starts)[of].astype(np.int32)),
                        _blobs(sig[of].reshape(-1), np.arange(len(of) + 1) * sig.shape[1]),
                        _blobs(cell, borders),
                        _blobs(np.minimum(rank, 65535).astype(np.uint16), borders),
                        _blobs(side, borders),
                    ],
                    names=["part", "id", "n", "sig", "cells", "ranks", "sides"],
                )

    return run


# ---- forest -------------------------------------------------------------------------------------


class Level:
    """The nodes of one height of a forest: OR bitmaps, size ranges, lost tokens, and the children of each."""

    def __init__(self, sig, low, high, lost, first, last) -> None:
        self.sig, self.low, self.high, self.lost, self.first, self.last = sig, low, high, lost, first, last


def grow(sig: np.ndarray, n: np.ndarray, starts: np.ndarray, fanout: int = FANOUT) -> list[Level]:
    """The levels over leaves grouped at ``starts``, until each group has one node; leaves are level 0."""
    lost = n - np.bitwise_count(sig).sum(axis=1)
    levels = [Level(sig, n, n, lost, None, None)]
    while len(starts) < len(levels[-1].low):
        below = levels[-1]
        total = len(below.low)
        group = np.zeros(total, np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        first = np.flatnonzero((np.arange(total) - starts[group]) % fanout == 0)
        last = np.append(first[1:], total)
        levels.append(Level(np.bitwise_or.reduceat(below.sig, first, axis=0), np.minimum.reduceat(below.low, first), np.maximum.reduceat(below.high, first), np.maximum.reduceat(below.lost, first), first, last))
        starts = np.searchsorted(first, starts)
    return levels


def traverse(levels: list[Level], roots: np.ndarray, threshold: float, leaf_filter: Callable, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs whose greatest possible overlap reaches the threshold, from pairs of root nodes down."""
    stack = [(len(levels) - 1, part) for part in np.array_split(roots, len(roots) // chunk + 1) if len(part)]
    while stack:
        height, pairs = stack.pop()
        level, a, b = levels[height], pairs[:, 0], pairs[:, 1]
        keep = (level.high[a] >= threshold * level.low[b] - EPS) & (level.high[b] >= threshold * level.low[a] - EPS)
        if height == 0:
            keep &= leaf_filter(a, b)
        a, b = a[keep], b[keep]
        shared = np.bitwise_count(level.sig[a] & level.sig[b]).sum(axis=1) + np.minimum(level.lost[a], level.lost[b])
        keep = shared >= needed(threshold, level.low[a], level.low[b])
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if height == 0:
            yield a, b
            continue
        width, breadth = level.last[a] - level.first[a], level.last[b] - level.first[b]
        size = width * breadth
        ends = np.cumsum(size)
        for lo, hi in _slices(ends, chunk):
            sizes = size[lo:hi]
            which = np.repeat(np.arange(lo, hi), sizes)
            offset = np.arange(len(which)) - np.repeat(ends[lo:hi] - sizes - (ends[lo] - sizes[0]), sizes)
            left, right = level.first[a[which]] + offset // breadth[which], level.first[b[which]] + offset % breadth[which]
            ordered = (a[which] != b[which]) | (left <= right if height > 1 else left < right)
            stack.append((height - 1, np.stack([left[ordered], right[ordered]], axis=1)))


def _slices(ends: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, side="right")))
        yield lo, hi
        lo = hi


def _values(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a binary column in a row, how many each row has), read from the column's own buffers."""
    whole = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind) if data.flags.aligned and data.ctypes.data % np.dtype(kind).itemsize == 0 else np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _search(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        del kept
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        sig = _values(table.column("sig"), np.uint64)[0].reshape(len(ids), -1)
        cells, width = _values(table.column("cells"), np.uint64)
        ranks, sides = _values(table.column("ranks"), np.uint16)[0], _values(table.column("sides"), np.int8)[0]
        row = np.repeat(np.arange(len(ids), dtype=np.int32), width)
        # cells with one record have no pairs
        order = np.argsort(cells, kind="stable")
        same = cells[order][1:] == cells[order][:-1]
        order = order[np.append(same, False) | np.insert(same, 0, False)] if len(cells) else order
        order = order[np.lexsort((n[row[order]], sides[order], cells[order]))]
        cells, ranks, sides, row = cells[order], ranks[order], sides[order], row[order].astype(np.int64)
        found: list[np.ndarray] = []
        for lo, hi in _cell_ranges(cells, 1_000_000):
            found += list(_search_cells(cells[lo:hi], ranks[lo:hi].astype(np.int64), sides[lo:hi], row[lo:hi], ids, n, sig, threshold))
            if sum(map(len, found)) > 2_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _cell_ranges(cells: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    starts = np.append(np.flatnonzero(np.insert(cells[1:] != cells[:-1], 0, True)) if len(cells) else [], len(cells)).astype(np.int64)
    lo = 0
    while lo < len(cells):
        hi = max(int(starts[np.searchsorted(starts, lo + size, side="right") - 1]), int(starts[np.searchsorted(starts, lo, side="right")]))
        yield lo, hi
        lo = hi


def _search_cells(cells, ranks, sides, row, ids, n, sig, threshold: float) -> Iterator[np.ndarray]:
    tree = np.flatnonzero(np.insert((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1]), 0, True))
    size = n[row]
    levels = grow(sig[row], size, tree)
    # a tree is traversed with itself, or with the tree of the other side of its cell
    whole = np.flatnonzero(sides[tree] == -1)
    halves = np.flatnonzero((sides[tree][:-1] == 0) & (sides[tree][1:] == 1) & (cells[tree][:-1] == cells[tree][1:]))
    roots = np.concatenate([np.stack([whole, whole], axis=1), np.stack([halves, halves + 1], axis=1)])
    rest = size - ranks

    def by_rank(a, b):
        # at the first cell that two records share, nothing of lower rank is common
        return (row[a] != row[b]) & (np.minimum(rest[a], rest[b]) >= needed(threshold, size[a], size[b]))

    for a, b in traverse(levels, roots, threshold, by_rank):
        x, y = ids[row[a]], ids[row[b]]
        yield np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)


# ---- operator -----------------------------------------------------------------------------------


def _has_shingle(shingle: int) -> Column:
    return (F.col("words") != "") & (F.size(F.split("words", " ")) >= shingle)


def distinct_texts(df: DataFrame, key: str, text: str, shingle: int, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts(id, words), members(id, key)): one id for each distinct sequence of words.

    With ``short``, also for texts of fewer words than a shingle; texts without a word, but not blank, are told apart as they stand.
    """
    rows = df.select(F.col(key).alias("key"), normal_words(F.col(text)).alias("words"), F.col(text).alias("text")).where("key is not null")
    if short:
        rows = rows.where((F.col("words") != "") | F.col("text").rlike(r"[^\s\p{Z}]"))
    else:
        rows = rows.where(_has_shingle(shingle))
    same = F.when(F.col("words") == "", F.col("text")).otherwise(F.col("words")) if short else F.col("words")
    rows = rows.select("key", "words", same.alias("same"), F.xxhash64(same).alias("h1"), F.xxhash64(same, F.lit(7)).alias("h2"))
    name = [F.sha2(F.first("same"), 256).alias("class")] if short else []
    texts = rows.groupBy("h1", "h2").agg(F.first("words").alias("words"), *name)
    names = ["class"] if short else []
    texts = stage(texts.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "words", *names), "texts")
    members = rows.select("h1", "h2", "key").distinct().join(texts.select("id", "h1", "h2", *names), ["h1", "h2"]).select("id", "key", *names)
    return texts.select("id", "words"), members


def _verify(shingle: int, threshold: float) -> Callable:
    def shingles(text: str) -> set:
        words = text.split(" ")
        return set(words) if shingle == 1 else set(zip(*[words[i:] for i in range(shingle)], strict=False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, last, left, sets = [], None, set(), {}
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if a != last:
                    last, left = a, shingles(text_a)
                right = sets[b] if b in sets else sets.setdefault(b, shingles(text_b))
                shared = len(left & right)
                similarity = shared / (len(left) + len(right) - shared)
                if similarity >= threshold:
                    rows.append((a, b, similarity))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity"])

    return run


def verified(candidates: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The candidates (a, b) whose exact similarity reaches the threshold. Only texts of candidates are shipped."""
    ids = stage(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    if small_enough(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    texts = stage(texts.join(ids, "id"), "candidate-texts")
    one = lambda side: texts.select(F.col("id").alias(side), F.col("words").alias(f"text_{side}"))
    both = candidates.join(one("b"), "b").join(one("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInPandas(_verify(shingle, threshold), "a long, b long, similarity double")


def similar_texts(texts: DataFrame, shingle: int, threshold: float, combo: int = 1, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of the ids whose shingle sets reach the threshold. ``texts`` has (id, words), staged.

    ``combo`` > 1 suits sets of a dozen tokens without rare ones; it needs threshold > combo / (combo + 1).
    """
    if combo > 1 and threshold <= combo / (combo + 1):
        raise ValueError("combo is too large for this threshold")
    spark = texts.sparkSession
    n_texts, n_chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    # few enough that a record is not sent everywhere with its bitmap, enough that a partition stays within some 300 MB
    parts = parts or max(spark.sparkContext.defaultParallelism, n_texts // PART_TEXTS + 1)
    size = counter_size(n_chars // WORD_CHARS)
    counted = token_counts(texts, shingle, size)
    cells = _cells(spark.sparkContext.broadcast(counted), shingle, threshold, combo)
    # a cell of one token has no more records than the token's counter says
    cuts = cut_plan(texts, cells, block, size) if combo > 1 or counted.max(initial=0) > block else None
    if cuts is not None:
        texts_cut = texts.join(cuts, "id", "left")
    rows = (texts if cuts is None else texts_cut).mapInArrow(_emit(cells, parts), "part int, id long, n int, sig binary, cells binary, ranks binary, sides binary")
    candidates = rows.repartitionById(parts, F.col("part")).mapInArrow(_search(threshold), "a long, b long").distinct()
    candidates = stage(candidates, "candidates")
    return verified(candidates, texts, shingle, threshold)


def similar_records(df: DataFrame, key: str, text: str, shingle: int, threshold: float, combo: int = 1) -> DataFrame:
    """(key_a, key_b) of all pairs of different keys whose texts reach the threshold, the smaller key first."""
    texts, members = distinct_texts(df, key, text, shingle)
    members = stage(members, "members")
    near = similar_texts(texts, shingle, threshold, combo).select("a", "b")
    side = lambda s: members.select(F.col("id").alias(s), F.col("key").alias(f"key_{s}"))
    pairs = near.join(side("a"), "a").join(side("b"), "b").select("key_a", "key_b")
    several = members.groupBy("id").count().where("count > 1").select("id")
    copies = members.join(several, "id", "left_semi")
    copies = copies.select("id", F.col("key").alias("key_a")).join(copies.select("id", F.col("key").alias("key_b")), "id").where("key_a < key_b").select("key_a", "key_b")
    pairs = pairs.unionByName(copies).where("key_a <> key_b")
    return pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def similar_classes(df: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, combo: int = 1) -> DataFrame:
    """(key, class, n_links): every key with a text, its class of equal texts (the SHA-256 of their words) and how many other classes are similar to that one.

    Texts of fewer words than a shingle have only their exact copies.
    """
    texts, members = distinct_texts(df, key, text, shingle, short=True)
    near = similar_texts(texts.where(_has_shingle(shingle)), shingle, threshold, combo)
    links = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "id", "left").select("key", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
