"""Dense vectors: pseudo-embeddings from hashes, a cache of computed ones, and exact filtered cosine search."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import let
from tessera.staging import stage

DIMENSION = 1024


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """The 32 bytes of the text's SHA-256, repeated, each scaled to [-1, 1); a blank text gives zeros."""
    byte = lambda digest, i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    block = let(F.sha2(F.encode(text, "UTF-8"), 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (byte(digest, i) - 128) / F.lit(128.0)))
    values = F.slice(F.flatten(F.array_repeat(block, -(-dimension // 32))), 1, dimension)
    return F.when(~text.rlike(r"[^\s\p{Z}]"), F.array_repeat(F.lit(0.0), dimension)).otherwise(values)


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def embed(texts: DataFrame, key: str, text: str, cache: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """((key, vector) of all texts, (content_hash, vector, created_at) to add to the cache).

    Only texts whose hash is not cached are embedded, each distinct text once, in Arrow batches by ``model``
    or, without one, by ``hash_embedding``.
    """
    hashed = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), content_hash(F.col(text)).alias("content_hash"))
    cached = cache.select("content_hash", "vector")
    misses = hashed.select("content_hash", "text").dropDuplicates(["content_hash"]).join(cached, "content_hash", "left_anti")
    if model is None:
        fresh = misses.select("content_hash", hash_embedding(F.col("text")).alias("vector"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"content_hash": b["content_hash"], "vector": [[float(x) for x in v] for v in model(list(b["text"]))]})

        fresh = misses.mapInPandas(run, "content_hash string, vector array<double>")
    fresh = stage(fresh, "fresh")
    known = cached.unionByName(fresh)
    return hashed.select("key", "content_hash").join(known, "content_hash").select("key", "vector"), fresh.withColumn("created_at", F.lit(now).cast("long"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles; null if one of them is zero or the lengths differ."""
    a, b = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm)


def cosine_top(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int = 10, equal: dict | None = None) -> DataFrame:
    """(the columns of ``vectors`` without the vector, score) of the most similar rows; filters apply before scoring; ties by key."""
    for column, value in (equal or {}).items():
        if value is not None:
            vectors = vectors.where(F.col(column) == value)
    scored = vectors.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).where("score is not null")
    return scored.drop(vector).orderBy(F.desc("score"), key).limit(limit)


@F.pandas_udf(StringType())
def point_id(keys: pd.Series) -> pd.Series:
    """The name-based id (URL namespace) under which an outside vector store would keep a key."""
    return keys.map(lambda k: None if k is None else str(uuid.uuid5(uuid.NAMESPACE_URL, k)))
