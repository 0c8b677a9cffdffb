"""Mixing sources to target weights, measured in tokens.

First each source gets its budget of tokens: its share of the size aimed at, or, where that is more
than ``max_repeats`` times all it has, as much as that; what such sources leave is shared by the
others according to their weights. So a source never falls behind both its target and its repeats.

A mixture is a sequence of slots of equal token size. Slot ``i`` takes the golden-ratio point
``frac((i + 1/2) / phi)`` and goes to the source whose interval of cumulative budget holds it, so
every stretch of the mixture is close to the shares. The slots of a source are ranked; the n-th slot
takes the n-th block of the source's stream, which is its shuffled records, over and over. Blocks are
cut at token offsets, so every block but the last of a source has the same size: a record across a
border stands in both blocks, with the tokens of it that belong to each.

Offsets come from a running token sum over the records of a source in hash order. The sum, and the
ranks of the slots, are taken in two steps, within buckets of bounded size and over bucket totals, so a
source with a third of all records is never in one task.

Defined results: sources are compared in clean spelling (lower case, trimmed, ``_`` for blanks and
hyphens); records of sources without target, null sources and null texts are left out; records without
tokens stand in no block; a source without tokens, or with share 0, is reported with 0; each record of a
source is used as often as any other, give or take one; texts are tokenised whole, however long.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import stage

#: Where the public vocabularies are. The environment variable is for clusters that keep them elsewhere.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The usual pre-tokenisation of this vocabulary (its published pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block at most; slots that the smallest budget is cut into at least; records of a hash bucket and slots of a range, about.
BLOCK_TOKENS, LEAST_SLOTS, BUCKET_ROWS, RANGE_SLOTS = 65_536, 8, 20_000, 100_000
GOLDEN = 0.6180339887498949


def clean_source(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"^\s+|\s+$", ""), r"[\s\-]+", "_")


def load_tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    lines = (Path(folder) / vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding(re.sub(r"\W", "_", vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, columns: list[str], text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` and n_tokens of each row; the text itself goes no further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_tokenizer(folder, vocabulary).encode_ordinary
        for b in batches:
            yield b[columns].assign(n_tokens=[len(encode(t)) for t in b["_text"]])

    rows = df.select(*columns, F.col(text).alias("_text")).where("_text is not null")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes if name != "_text") + ", n_tokens long"
    return rows.mapInPandas(run, schema)


def count_bytes(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The same in tokens of a byte-level vocabulary, where each byte of the UTF-8 text is one."""
    rows = df.select(*columns, F.col(text).alias("_text")).where("_text is not null")
    return rows.select(*columns, F.octet_length("_text").cast("long").alias("n_tokens"))


def sized_records(df: DataFrame, targets: DataFrame, key: str, source: str, text: str, count=count_tokens) -> DataFrame:
    """(key, source, n_tokens) of the records of targeted sources, staged."""
    named = df.select(F.col(key).alias("key"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    wanted = [r[0] for r in targets.select("source").distinct().collect()]
    return stage(count(named.where(F.col("source").isin(wanted)), ["key", "source"], "text"), "sized")


def source_totals(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per targeted source: its share of all weights, repeats, records and tokens."""
    sums = records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    weights = targets.groupBy("source").agg(F.sum("target_share").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    return weights.join(sums, "source", "left").na.fill(0, ["n_records", "n_tokens", "weight", "max_repeats"])


def budgets_of(totals: list, total_tokens: int) -> dict[str, int]:
    """Tokens of each source: its share of ``total_tokens``, at most its repeats; what is left over goes to the others by weight."""
    room = {t["source"]: int(t["n_tokens"]) * int(t["max_repeats"]) for t in totals}
    weight = {t["source"]: float(t["weight"]) for t in totals if t["weight"] > 0 and room[t["source"]] > 0}
    budgets, left = {}, float(total_tokens)
    while weight:
        rate = left / sum(weight.values())
        full = [s for s, w in weight.items() if room[s] <= w * rate]
        for s in full or list(weight):
            budgets[s] = room[s] if full else round(weight[s] * rate)
            left -= budgets[s]
            del weight[s]
        left = max(left, 0.0)
    return {s: n for s, n in budgets.items() if n > 0}


def offsets_of(records: DataFrame, buckets: int, seed: int = 0) -> DataFrame:
    """(key, source, n_tokens, start): the token offset of each record in its source's hash order."""
    shuffled = records.withColumn("place", F.xxhash64("key", F.lit(seed)))
    # buckets are ranges of the hash, so bucket order is hash order
    shuffled = shuffled.withColumn("bucket", F.floor((F.shiftright("place", 40) + 2**23) * buckets / 2**24).cast("int"))
    totals = shuffled.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    running = Window.partitionBy("source", "bucket").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = shuffled.join(totals, ["source", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
    return placed.select("key", "source", "n_tokens", "start")


def uses_of(offsets: DataFrame, sizes: DataFrame, block_tokens: int) -> DataFrame:
    """(source, block, copy, key, first_token, n_tokens): the repeated streams of the sources, cut into blocks.

    ``sizes`` has one row per source: (source, budget, all_tokens).
    """
    rows = offsets.where("n_tokens > 0").join(F.broadcast(sizes), "source").where("start < budget")
    copies = rows.select("*", F.explode(F.expr("sequence(0L, (budget - start - 1) div all_tokens)")).alias("copy"))
    copies = copies.withColumn("at", F.col("start") + F.col("copy") * F.col("all_tokens"))
    copies = copies.withColumn("until", F.least(F.col("at") + F.col("n_tokens"), F.col("budget")))
    cut = copies.select("*", F.explode(F.expr(f"sequence(at div {block_tokens}, (until - 1) div {block_tokens})")).alias("block"))
    begin, end = F.greatest("at", F.col("block") * block_tokens), F.least("until", (F.col("block") + 1) * block_tokens)
    return cut.select("source", "block", F.col("copy").cast("int").alias("copy"), "key", (begin - F.col("at")).alias("first_token"), (end - begin).alias("n_tokens"))


def ranked(rows: DataFrame, groups: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with their rank from 0 by the number ``order`` within ``groups``, by way of ranges of ``order``."""
    rows = rows.withColumn("_range", F.expr(f"{order} div {RANGE_SLOTS}"))
    totals = rows.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(order))
    return rows.join(totals, [*groups, "_range"]).withColumn(name, F.col("_base") + within - 1).drop("_range", "_base")


def points(spark, shares: dict[str, float], slots: int) -> DataFrame:
    """(slot, source): the source whose interval of cumulative share holds the slot's golden-ratio point."""
    whole = sum(shares.values()) or 1.0
    point = F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)")
    rows = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    source, edge = F.lit(None).cast("string"), 1.0
    for name in sorted(shares, reverse=True):
        source = F.when(F.col("point") < edge, F.lit(name)).otherwise(source)
        edge -= shares[name] / whole
    return rows.select("slot", source.alias("source"))


def slot_schedule(spark, blocks: dict[str, int]) -> DataFrame:
    """(slot, source, block): one slot for each of a source's ``blocks``, in the order of the golden-ratio points.

    The points go on until every source has its slots; points of sources that have theirs are passed over.
    """
    n, extra = sum(blocks.values()), 0
    while True:
        counts = {r["source"]: r["count"] for r in points(spark, blocks, n + extra).groupBy("source").count().collect()}
        if all(counts.get(s, 0) >= k for s, k in blocks.items()):
            break
        extra = max(2 * extra, n // 64, 8)
    wanted = F.lit(0)
    for s, k in blocks.items():
        wanted = F.when(F.col("source") == s, F.lit(k)).otherwise(wanted)
    served = ranked(points(spark, blocks, n + extra), ["source"], "slot", "block").where(F.col("block") < wanted)
    return ranked(served.withColumn("_all", F.lit(0)), ["_all"], "slot", "dense").select(F.col("dense").alias("slot"), "source", "block")


def mix(records: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """(slot, source, copy, block, key, first_token, n_tokens): the mixture, one row per use of a record in a block.

    ``total_tokens`` is the size aimed at, by default that of all targeted records. ``block_tokens`` is the size of a
    block; where the smallest source would fill fewer than ``LEAST_SLOTS`` of them, all blocks are made smaller.
    """
    spark = records.sparkSession
    totals = source_totals(records, targets).collect()  # one row per target
    budgets = budgets_of(totals, total_tokens or sum(t["n_tokens"] for t in totals))
    if not budgets:
        empty = records.select(F.lit(0).cast("long").alias("slot"), "source", F.lit(0).alias("copy"), F.lit(0).cast("long").alias("block"), "key", F.lit(0).cast("long").alias("first_token"), F.col("n_tokens").cast("long").alias("n_tokens"))
        return empty.limit(0)
    block_tokens = max(1, min(block_tokens, min(budgets.values()) // LEAST_SLOTS))
    buckets = max(1, max(t["n_records"] for t in totals) // BUCKET_ROWS)
    sizes = spark.createDataFrame([(t["source"], budgets[t["source"]], int(t["n_tokens"])) for t in totals if t["source"] in budgets], "source string, budget long, all_tokens long")
    uses = uses_of(offsets_of(records, buckets, seed), sizes, block_tokens)
    schedule = slot_schedule(spark, {s: -(-n // block_tokens) for s, n in budgets.items()})
    return schedule.join(uses, ["source", "block"]).select("slot", "source", "copy", "block", "key", "first_token", "n_tokens")


def reached_shares(mixture: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_uses, n_records, max_copies) of every target; a record that is cut is one use."""
    whole_use = F.sum((F.col("first_token") == 0).cast("int"))
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), whole_use.alias("n_uses"), (F.max("copy") + 1).alias("max_copies"))
    totals = source_totals(records, targets).select("source", F.col("weight").alias("target_share"), "n_records")
    rows = totals.join(used, "source", "left").na.fill(0, ["n_tokens", "n_uses", "max_copies"])
    whole = F.sum("n_tokens").over(Window.partitionBy())  # one row per target
    share = F.when(whole > 0, F.col("n_tokens") / whole).otherwise(F.lit(0.0))
    return rows.select("source", "target_share", share.alias("actual_share"), "n_tokens", "n_uses", "n_records", "max_copies")
