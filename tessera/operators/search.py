"""Keyword search: weighted BM25 over a table of documents or over a stored index, and file pointers."""

from __future__ import annotations

import json
import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import index_terms, let, query_terms, strip_spaces
from tessera.sources.store import Files
from tessera.staging import stage

# The searchable columns in their order, and what a hit in each is worth.
WEIGHTS = {"object_id": 0.0, "name": 10.0, "content": 1.0, "tags": 5.0, "file_path": 8.0, "domain": 5.0, "sections": 6.0, "keywords": 6.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Folders that the postings of a segment are spread over by term.
BUCKETS = 64


def document_terms(documents: DataFrame, key: str) -> DataFrame:
    """(key, one array of terms per searchable column, n_terms over all of them)."""
    arrays = [index_terms(F.col(c)).alias(c) for c in WEIGHTS]
    rows = documents.select(F.col(key).alias("key"), *arrays)
    return rows.withColumn("n_terms", sum((F.size(c) for c in WEIGHTS), F.lit(0)).cast("long"))


def _weighted(documents: DataFrame, key: str, n_terms: bool) -> DataFrame:
    """(term, key, weight): for each term of a document the summed column weights of its occurrences.

    With ``n_terms`` also the number of terms of the document, and an empty term that every document has.
    """
    terms = document_terms(documents, key)

    def entries(column: str, weight: float) -> Column:
        return F.transform(F.col(column), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    lists = [entries(c, w) for c, w in WEIGHTS.items()]
    if n_terms:
        lists.append(F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("weight"))))
    more = ["n_terms"] if n_terms else []
    rows = terms.select("key", *more, F.explode_outer(F.flatten(F.array(*lists))).alias("t")).where("t is not null")
    return rows.groupBy("t.term", "key", *more).agg(F.sum("t.weight").alias("weight"))


def postings(documents: DataFrame, key: str) -> DataFrame:
    """(term, key, weight): for each term of a document the summed column weights of its occurrences."""
    return _weighted(documents, key, False)


# ---- stored index: segments of postings; a newer segment may delete documents of the older ones ------


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


def write_segment(documents: DataFrame, key: str, path: str) -> None:
    """Postings with the length of their document, in buckets by term, sorted. A query reads the buckets of its terms
    only, and within them the row groups whose range holds a term."""
    table = _weighted(documents, key, True).withColumn("bucket", (F.crc32(F.encode("term", "UTF-8")) % BUCKETS).cast("int"))
    # a frequent term is spread over several files of its bucket
    spread = table.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "term")
    spread.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")


def write_deletions(keys: DataFrame, path: str) -> None:
    """Documents of older segments that a segment takes out of the index."""
    keys.select("key").distinct().write.option("compression", "zstd").parquet(f"{path}/deleted")


def live_postings(spark: SparkSession, segments: list[str], terms: list[str], key_type: str = "string") -> DataFrame:
    """(term, key, weight, n_terms) of these terms in ``segments`` (the oldest first), without deleted documents."""
    schema = f"term string, key {key_type}, n_terms long, weight double"
    found, deleted = [], []
    for number, path in enumerate(segments):
        files = Files(spark, path)
        places = [f"{path}/postings/bucket={b}" for b in sorted({bucket_of(t) for t in terms}) if files.exists(f"postings/bucket={b}")]
        if places:
            rows = spark.read.schema(schema).parquet(*places).where(F.col("term").isin(terms))
            found.append(rows.withColumn("_segment", F.lit(number)))
        if number and files.exists("deleted"):
            deleted.append(spark.read.schema(f"key {key_type}").parquet(f"{path}/deleted").withColumn("_after", F.lit(number)))
    if not found:
        return spark.createDataFrame([], schema).select("term", "key", "weight", "n_terms")
    rows = reduce(DataFrame.unionByName, found)
    if deleted:
        last = reduce(DataFrame.unionByName, deleted).groupBy(F.col("key").alias("_key")).agg(F.max("_after").alias("_after"))
        rows = rows.join(last, (F.col("key") == F.col("_key")) & (F.col("_after") > F.col("_segment")), "left_anti")
    return rows.select("term", "key", "weight", "n_terms")


def index_totals(spark: SparkSession, segments: list[str], key_type: str = "string") -> dict[str, int]:
    """Number of documents, and of terms of all of them."""
    row = live_postings(spark, segments, [""], key_type).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")).first()
    return row.asDict()


def search_segments(spark: SparkSession, segments: list[str], totals: dict[str, int], query: str, limit: int = 10, key_type: str = "string") -> DataFrame:
    """(key, score) of the best documents, best first, ties by key."""
    terms = query_terms(query)
    if not terms or not totals["n_docs"]:
        return spark.createDataFrame([], f"key {key_type}, score double")
    wanted = {t: terms.count(t) for t in terms}
    hits = live_postings(spark, segments, list(wanted), key_type)
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_hits"))  # one row per word of the query
    hits = hits.join(F.broadcast(counts), "term")
    repeat = F.create_map(*[x for t, n in wanted.items() for x in (F.lit(t), F.lit(n))])[F.col("term")]
    gain = repeat * _idf(F.lit(totals["n_docs"]), F.col("n_hits")) * _gain(F.col("weight"), F.col("n_terms"), F.lit(totals["n_terms"] / totals["n_docs"]))
    return hits.groupBy("key").agg(F.sum(gain).alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def build_index(documents: DataFrame, key: str, path: str) -> None:
    """An index of one segment in a folder of its own."""
    write_segment(documents, key, path)
    kind = dict(documents.dtypes)[key]
    totals = index_totals(documents.sparkSession, [path], kind)
    Files(documents.sparkSession, path).create("index.json", json.dumps(totals | {"key_type": kind}))


def search_index(spark: SparkSession, path: str, query: str, limit: int = 10) -> DataFrame:
    """(key, score) of the best documents of a stored index, best first, ties by key."""
    totals = json.loads(Files(spark, path).read("index.json"))
    return search_segments(spark, [path], totals, query, limit, totals["key_type"])


def _idf(n_docs: Column, n_hits: Column) -> Column:
    idf = F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR))


def _gain(weight: Column, n_terms: Column, mean: Column) -> Column:
    return F.when(weight > 0, weight * (K1 + 1) / (weight + K1 * (1 - B + B * n_terms / mean))).otherwise(F.lit(0.0))


def _query_hits(documents: DataFrame, terms: list[str]) -> DataFrame:
    """The columns of ``documents``, with the number of all their terms and (term, weight) of each occurrence of one of ``terms``."""
    n, hits = F.lit(0), []
    numbers = {f"_{c}": let(index_terms(F.col(c)), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda x: x.isin(terms)).alias("hits"))) for c in WEIGHTS}
    weighted = lambda c, w: F.transform(f"_{c}.hits", lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    for c, w in WEIGHTS.items():
        n = n + F.col(f"_{c}.n")
        hits.append(weighted(c, w))
    return documents.withColumns(numbers).select(*documents.columns, n.cast("long").alias("_n"), F.flatten(F.array(*hits)).alias("_hits"))


def search_documents(documents: DataFrame, key: str, query: str, limit: int = 10) -> DataFrame:
    """(the columns of ``documents``, score) of the best documents of a table without index, best first, ties by key.

    One pass over the texts: what it keeps of a document are its key, its length and its hits, which are staged for the
    statistics and the scores. Only documents with a key of the top list are read again. An empty query has no rows.
    """
    terms = query_terms(query)
    distinct = sorted(set(terms))
    if not distinct:
        return documents.withColumn("score", F.lit(0.0)).limit(0)
    kept = stage(_query_hits(documents, distinct).select(F.col(key).alias("_key"), "_n", "_hits"), "hits")
    of = lambda t: F.filter("_hits", lambda h: h["term"] == F.lit(t))
    stats = kept.agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("terms"), *[F.sum((F.size(of(t)) > 0).cast("long")).alias(f"h{i}") for i, t in enumerate(distinct)]).first()
    if not stats["n"]:
        return documents.withColumn("score", F.lit(0.0)).limit(0)
    mean, score = F.lit(stats["terms"] / stats["n"]), F.lit(0.0)
    for i, t in enumerate(distinct):
        weight = F.aggregate(of(t), F.lit(0.0), lambda total, h: total + h["weight"])
        score = score + terms.count(t) * _idf(F.lit(stats["n"]), F.lit(stats[f"h{i}"])) * _gain(weight, F.col("_n"), mean)
    best = kept.where(F.size("_hits") > 0).withColumn("score", score).orderBy(F.desc("score"), "_key").limit(limit).select("_key").distinct()
    # at most ``limit`` keys; a key that several documents have is scored again for each of them
    again = _query_hits(documents.join(F.broadcast(best), F.col(key).eqNullSafe(F.col("_key")), "left_semi"), distinct)
    return again.where(F.size("_hits") > 0).withColumn("score", score).orderBy(F.desc("score"), key).limit(limit).select(*documents.columns, "score")


def matched_terms(query: str, name: Column, sections: Column, keywords: Column) -> Column:
    """What of a hit matches the query: keyword phrases that share a word, then words of the name and the sections; at most eight."""
    asked = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    asked = F.array(*[F.lit(w) for w in asked]) if asked else F.array().cast("array<string>")
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    phrases = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), ";"), strip_spaces), lambda p: (p != "") & F.arrays_overlap(words(p), asked))
    surface = F.filter(asked, lambda w: F.array_contains(F.array_union(words(name), words(sections)), w))
    best = F.slice(F.array_distinct(F.concat(phrases, surface)), 1, 8)
    return F.when(F.size(best) > 0, F.array_join(best, ", ")).otherwise(F.lit("(matched in body text only)"))


def pointers(hits: DataFrame, key: str, query: str) -> DataFrame:
    """(rank, file, name, why, sections, score, domain): the first hit of every file, best first; hits without a path go.

    ``hits`` is a ranked top list with ``score``, so the windows see a bounded number of rows.
    """
    order = [F.desc("score"), F.col(key)]
    once = hits.where("coalesce(file_path, '') <> ''").withColumn("_nth", F.row_number().over(Window.partitionBy("file_path").orderBy(*order))).where("_nth = 1")
    parts = F.filter(F.transform(F.slice(F.split(F.coalesce("sections", F.lit("")), ";"), 1, 5), strip_spaces), lambda s: s != "")
    rank = F.row_number().over(Window.orderBy(*order))
    return once.select(
        rank.alias("rank"),
        F.col("file_path").alias("file"),
        "name",
        matched_terms(query, F.col("name"), F.col("sections"), F.col("keywords")).alias("why"),
        parts.alias("sections"),
        F.round("score", 3).alias("score"),
        F.coalesce("domain", F.lit("")).alias("domain"),
    )


# The wording of the report.
NOTHING_FOUND = "No relevant documents found for this query."
REPORT_TITLE = "# Search Results for: "
REPORT_HINT = "The following files contain relevant information. Read the files to answer the query."


def pointer_report(found: DataFrame, query: str) -> str:
    """The pointers as one markdown text (at most the top list's rows come to the driver)."""
    rows = found.orderBy("rank").collect()
    if not rows:
        return NOTHING_FOUND
    lines = [REPORT_TITLE + query, "", REPORT_HINT, ""]
    for i, r in enumerate(rows, 1):
        lines += [f"## {i}. {r['name']}", f"**File:** `{r['file']}`", f"**Relevance:** {r['score']}"]
        lines += [f"**Matched terms:** {r['why']}"] if r["why"] else []
        lines += [f"**Sections:** {'; '.join(r['sections'])}"] if r["sections"] else []
        lines += [f"**Domain:** {r['domain']}"] if r["domain"] else []
        lines.append("")
    return "\n".join(lines)
