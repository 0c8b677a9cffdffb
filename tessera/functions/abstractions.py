"""Outlines, summaries and keywords of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import WORD_CLASS, let, split_identifier, strip_spaces

# Words that are no keywords.
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must", "ought", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her",
    "us", "them", "my", "your", "his", "its", "our", "their", "mine", "yours", "hers", "ours", "theirs", "this", "that", "these", "those",
    "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most",
    "other", "some", "such", "no", "only", "same", "than", "too", "very", "just", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "what", "which",
    "who", "whom", "if", "also", "like", "going", "know", "think", "really", "right", "get", "got", "go", "one", "two", "even",
    "well", "back", "much", "many", "still", "now", "way", "look", "make", "come", "see", "take", "want", "give", "use", "say", "said",
    "thing", "things", "people", "something", "lot", "actually", "kind",
]
# Kinds of documents whose name raises a term.
DOCUMENT_KINDS = ["guest lecture", "keynote", "seminar", "workshop", "tutorial", "transcript", "presentation", "interview"]

SENTENCE_END = r"[.!?]\s"
BEFORE, AFTER = rf"(?<![{WORD_CLASS}])", rf"(?![{WORD_CLASS}])"
PROPER_NOUN = rf"{BEFORE}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*{AFTER}"
KIND_PHRASE = rf"{BEFORE}(?:{'|'.join(DOCUMENT_KINDS)}){AFTER}"
#: Shortest text with a summary or keywords; keywords kept; weights of the parts of a score.
MIN_CHARS, TOP_KEYWORDS, BIGRAM_WEIGHT, NOUN_WEIGHT, KIND_WEIGHT = 50, 100, 2, 3, 0.05


def _stripped_paragraphs(text: Column, longer_than: int) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip_spaces), lambda p: F.length(p) > longer_than)


def _first_sentence(paragraph: Column) -> Column:
    return strip_spaces(F.get(F.split(paragraph, SENTENCE_END), F.lit(0)))


def _first_by_key(values: Column, key) -> Column:
    """Values whose key has not occurred before, in order."""
    return let(values, lambda v: let(F.transform(v, key), lambda keys: F.filter(v, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def outline_of_text(text: Column) -> Column:
    """First sentences of the first twenty paragraphs, without repeats, at most ten."""
    sentences = F.transform(F.slice(_stripped_paragraphs(text, 40), 1, 20), _first_sentence)
    kept = F.filter(sentences, lambda s: (F.length(s) > 20) & ~s.rlike(r"^\p{Nd}+$"))
    short = F.transform(kept, lambda s: F.substring(F.regexp_replace(s, r"\s+", " "), 1, 150))
    return F.array_join(F.slice(_first_by_key(short, lambda s: F.lower(F.substring(s, 1, 50))), 1, 10), "; ")


def sample_passages(paragraphs: Column) -> Column:
    """All of up to three paragraphs, else the first, the middle and the last."""

    def chosen(p: Column) -> Column:
        n = F.size(p)
        return F.when(n <= 3, p).otherwise(F.array(F.get(p, F.lit(0)), F.get(p, F.floor(n / 2).cast("int")), F.get(p, n - 1)))

    return let(paragraphs, chosen)


def passages_of_text(text: Column, longer_than: int = 80) -> Column:
    return sample_passages(_stripped_paragraphs(text, longer_than))


# What a summary looks for: runs of capitalised words, marked lines, definitions.
CAPITALISED, MARKED = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", r"▪\s*(.+?)(?:\n|$)"
DEFINED = r"(?:is|are|means?|refers?\s+to|defined?\s+as)\s+(.{20,120}?)[.\n]"


def summary_of_text(name: Column, text: Column) -> Column:
    """Name, key points or longest phrases, and sampled first sentences; ties of length in alphabetical order."""
    found = lambda pattern, group: F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 1, 15)
    nouns = found(f"{BEFORE}{CAPITALISED}{AFTER}", 0)
    bullets = F.regexp_extract_all(text, F.lit(MARKED), F.lit(1))
    defined = found(DEFINED, 1)
    phrases = F.array_distinct(F.filter(F.transform(F.concat(nouns, F.slice(bullets, 1, 15), defined), strip_spaces), lambda p: F.length(p) > 5))
    longest = F.transform(F.slice(F.array_sort(F.transform(phrases, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), 1, 8), lambda x: x["p"])
    points = F.slice(F.filter(F.transform(bullets, strip_spaces), lambda b: F.length(b) > 10), 1, 8)
    listed = let(longest, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("Covers: "), F.array_join(x, ", "))))
    covers = let(points, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("Key topics: "), F.array_join(x, "; "))).otherwise(listed))
    sentences = F.filter(F.transform(passages_of_text(text), _first_sentence), lambda s: F.length(s) > 30)
    parts = F.concat(F.array(F.concat(name, F.lit(".")), covers), F.transform(sentences, lambda s: F.substring(s, 1, 200)))
    return F.when(F.length(text) >= MIN_CHARS, F.substring(F.array_join(F.array_compact(parts), " "), 1, 800)).otherwise(F.lit(""))


def plain_words(text: Column) -> Column:
    """Words of three or more ASCII letters, lower case, with no other word character beside them."""
    return F.filter(F.split(F.lower(text), rf"[^{WORD_CLASS}]+"), lambda w: w.rlike("^[a-z]{3,}$"))


def _kept(word: Column) -> Column:
    return ~word.isin(KEYWORD_STOP_WORDS)


def term_parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, total, kind, term, n, first) per text: counts of words (kind 0), word pairs (1), proper nouns (2), document kinds (3).

    The texts are shuffled by key once; all later grouping stays within their partitions.
    """
    # a number of its own: coalescing by size would leave this work, which is all computing, to a few tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") >= MIN_CHARS).repartition(parts, "key")
    rows = rows.select("key", "text", plain_words(F.col("text")).alias("words"))
    words = F.col("words")
    # zipped, not looked up by position: an array that a lambda refers to would be computed again for every element
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda p: p["b"].isNotNull() & _kept(p["a"]) & _kept(p["b"]))
    entry = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("term"), i.alias("pos")))
    parts = F.concat(
        entry(0, F.filter(words, _kept)),
        entry(1, F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))),
        entry(2, F.regexp_extract_all("text", F.lit(PROPER_NOUN), F.lit(0))),
        entry(3, F.regexp_extract_all(F.lower("text"), F.lit(KIND_PHRASE), F.lit(0))),
    )
    total = F.greatest(F.size(F.filter(words, _kept)), F.lit(1))
    # both are computed before the explosion, not for each of its rows
    rows = rows.select("key", total.alias("total"), parts.alias("parts"))
    # outer, as an inner explosion would compute the array a second time to filter out empty ones
    exploded = rows.select("key", "total", F.explode_outer("parts").alias("p")).where("p is not null").select("key", "total", "p.kind", "p.term", "p.pos")
    return exploded.groupBy("key", "total", "kind", "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def term_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, score, kind, first): the summed score of each term; kind and first tell where it came up first."""
    share, log = F.col("n") / F.col("total"), 1 + F.log("n")
    counted = term_parts(df, key, text).where("kind in (0, 3) or n >= 2").where("kind <> 2 or length(term) > 3")
    score = F.when(F.col("kind") == 0, share * F.when(F.col("n") > 1, log).otherwise(F.lit(1.0))).when(F.col("kind") == 1, share * log * BIGRAM_WEIGHT)
    score = score.when(F.col("kind") == 2, share * NOUN_WEIGHT).otherwise(F.col("n") * KIND_WEIGHT)
    scored = counted.select("key", F.lower("term").alias("term"), score.alias("score"), "kind", "first")
    grouped = scored.groupBy("key", "term").agg(F.sum("score").alias("score"), F.min(F.struct("kind", "first")).alias("at"))
    return grouped.select("key", "term", "score", "at.kind", "at.first")


def keyword_table(df: DataFrame, key: str, text: str, top: int = TOP_KEYWORDS) -> DataFrame:
    """(key, rank, term, score) of the best terms of each text; ties in the order in which the terms came up."""
    order = Window.partitionBy("key").orderBy(F.round("score", 12).desc(), "kind", "first", "term")
    return term_scores(df, key, text).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("key", "rank", "term", "score")


def keywords_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, keywords): the best terms joined with ``; ``. Texts that are too short have no row."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return keyword_table(df, key, text).groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["term"]), "; ").alias("keywords"))


# ---- code ---------------------------------------------------------------------------------------


def _public(names: Column) -> Column:
    return F.filter(names, lambda n: ~n.startswith("_"))


def identifiers_as_prose(classes: Column, functions: Column, imports: Column) -> Column:
    """Names of classes, public methods and functions as words, and the last two parts of imports; at most 800 characters."""
    of_class = lambda c: F.concat(F.array(split_identifier(c["name"])), F.transform(_public(F.transform(c["methods"], lambda m: m["name"])), split_identifier))
    modules = F.transform(imports, lambda i: F.regexp_replace(F.regexp_extract(i["module"], r"((?:[^.]*\.)?[^.]*)$", 1), r"\.", " "))
    names = F.concat(F.flatten(F.transform(classes, of_class)), F.transform(_public(F.transform(functions, lambda f: f["name"])), split_identifier), modules)
    return F.substring(F.array_join(names, " "), 1, 800)


def code_keywords(classes: Column, functions: Column, imports: Column, docstrings: Column, comments: Column) -> Column:
    """Identifiers, module parts and words of comments in alphabetical order, at most a hundred."""
    first_words = lambda texts, n: F.flatten(F.transform(texts, lambda t: F.slice(plain_words(t), 1, n)))
    of_class = lambda c: F.concat(F.array(F.lower(c["name"]), split_identifier(c["name"])), F.transform(c["methods"], lambda m: split_identifier(m["name"])))
    parts = F.flatten(F.transform(imports, lambda i: F.filter(F.split(i["module"], r"\."), lambda p: F.length(p) > 2)))
    terms = F.concat(
        F.flatten(F.transform(classes, of_class)),
        F.transform(functions, lambda f: split_identifier(f["name"])),
        F.transform(parts, F.lower),
        first_words(docstrings, 20),
        first_words(comments, 10),
    )
    return F.array_join(F.slice(F.sort_array(F.array_distinct(F.filter(terms, lambda t: t != ""))), 1, 100), "; ")


def code_outline(classes: Column, functions: Column) -> Column:
    bases = lambda c: F.when(F.size(c["bases"]) > 0, F.concat(F.lit(" extends "), F.array_join(c["bases"], ", "))).otherwise("")
    methods = lambda c: F.when(F.size(c["methods"]) > 0, F.concat(F.lit(" with methods: "), F.array_join(F.transform(c["methods"], lambda m: m["name"]), ", "))).otherwise("")
    returns = lambda f: F.when(F.coalesce(f["returns"], F.lit("")) != "", F.concat(F.lit(" -> "), f["returns"])).otherwise("")
    of_classes = F.transform(classes, lambda c: F.concat(F.lit("Class "), c["name"], bases(c), methods(c)))
    of_functions = F.transform(functions, lambda f: F.concat(F.lit("Function "), f["name"], F.lit("("), F.array_join(f["args"], ", "), F.lit(")"), returns(f)))
    return F.array_join(F.concat(of_classes, of_functions), "; ")
