"""One form for text that looks the same but differs in its characters.

Words are matched against tries of the collection's own spellings by a weighted edit automaton. The
tries hold each spelling in its own letters; the automaton reads a word as it stands, and a step along
an edge whose letter looks like the one that was read costs nothing, as do ignorable characters, width
forms, ligatures and combining sequences; everything else costs one edit. Of the spellings that are
accepted at no cost one stands for the whole class. Words that no trie accepts are normalised by table,
which resolves characters but leaves each letter in its script.

Only words that may have another spelling are looked up, and only vocabulary that could be accepted for
one of them is counted and shipped; it is split by the hash of a word's skeleton, so equal-looking
spellings meet in one bounded task. Only documents that hold such words are rewritten, and ASCII
documents never leave the JVM.

Defined results: a null text stays null and has no pairs; an empty or blank text becomes the empty
string, and blank texts that differ are pairs of one another; repeated equal texts are no pairs;
line breaks count, trailing blanks and blank line ends do not; texts of any length are processed whole.
Letters that are only similar (Greek alpha, dotless i, mathematical alphabets) look different.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.staging import small_enough, stage

# Letters of other scripts whose usual glyph is that of a Latin letter.
CYRILLIC = dict(zip("АВЕКМНОРСТУХІЈЅҮӀԌԚԜаеорсухіјѕһүӏԁԛԝ", "ABEKMHOPCTYXIJSYIGQWaeopcyxijshyldqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
OTHER = {"ɡ": "g", "‐": "-", "‑": "-", "՝": "'", "օ": "o", "ս": "u", "ո": "n", "հ": "h"}
LOOKALIKES = str.maketrans(CYRILLIC | GREEK | CHEROKEE | OTHER)
# Width forms, Latin ligatures and Roman numeral characters take their compatibility form; other compatibility characters look different.
WIDTH_FORMS = str.maketrans({chr(c): unicodedata.normalize("NFKC", chr(c)) for r in (range(0xFF01, 0xFFEF), range(0xFB00, 0xFB07), range(0x2160, 0x2180)) for c in r})
IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
BLANKS = regex.compile(r"[^\S\n]+")
TOKEN = regex.compile(r"\S+")
ASCII_BLANK = r"[ \t\r\x0b\f\x1c-\x1f]"
#: Words of a trie, about; skeletons up to this number (8 bytes each) are broadcast.
TRIE_WORDS, BROADCAST_SKELETONS = 20_000, 500_000


def table_form(token: str) -> str:
    """Ignorables away, width forms and ligatures resolved, composed; letters keep their script."""
    return token if token.isascii() else unicodedata.normalize("NFC", IGNORABLE.sub("", token).translate(WIDTH_FORMS))


def fold(token: str) -> str:
    """The skeleton: the table form with look-alike letters in their Latin form, equal for all spellings that look the same."""
    if token.isascii():
        return token
    parts = unicodedata.normalize("NFD", IGNORABLE.sub("", token).translate(WIDTH_FORMS)).translate(LOOKALIKES)
    return unicodedata.normalize("NFC", parts)


def well_formed(token: str) -> bool:
    """Composed, nothing ignorable, no width forms, letters of one script: a spelling that may stand for its class."""
    if token.isascii():
        return True
    if table_form(token) != token:
        return False
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in token if c.isalpha() and not c.isascii()} | ({"LATIN"} if any(c.isalpha() and c.isascii() for c in token) else set())
    return len(scripts) <= 1


@lru_cache(maxsize=1)
def look_table() -> dict[str, str]:
    """Each letter that has look-alikes, and all letters that look like it, itself among them."""
    classes: dict[str, str] = {}
    for code, latin in LOOKALIKES.items():
        classes[latin] = classes.get(latin, latin) + chr(code)
    return {letter: letters for letters in classes.values() for letter in letters}


class SpellingTrie:
    """A trie of spellings in their own letters, traversed by an automaton of edits with weights.

    The automaton reads the token as it stands. Passing over an ignorable costs 0, and so does a step
    along an edge of the letter read or of one that looks like it; a width form or ligature is read as
    the letters that it stands for. Any other substitution, insertion or deletion costs 1. States over
    ``budget`` are dropped; with the budget 0 only spellings that look the same are accepted.
    """

    def __init__(self) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.words: list[dict[str, int]] = [{}]

    def add(self, word: str, count: int) -> None:
        node = 0
        for c in unicodedata.normalize("NFD", word):
            found = self.edges[node].get(c)
            if found is None:
                found = self.edges[node][c] = len(self.edges)
                self.edges.append({})
                self.words.append({})
            node = found
        self.words[node][word] = self.words[node].get(word, 0) + count

    def accept(self, token: str, budget: int = 0) -> list[tuple[int, str, int]]:
        """(cost, word, count) of every accepted word."""
        states, looks = {0: 0}, look_table()
        for c in unicodedata.normalize("NFD", IGNORABLE.sub("", token)):
            for letter in WIDTH_FORMS.get(ord(c), c):
                after: dict[int, int] = {}

                def reach(node: int, cost: int, after: dict[int, int] = after) -> None:
                    if cost <= budget and cost < after.get(node, budget + 1):
                        after[node] = cost

                for node, cost in self._with_insertions(states, budget).items():
                    edges = self.edges[node]
                    for same in looks.get(letter, letter):
                        if same in edges:
                            reach(edges[same], cost)
                    if cost < budget:
                        reach(node, cost + 1)
                        for child in edges.values():
                            reach(child, cost + 1)
                states = after
                if not states:
                    return []
        return sorted((cost, word, count) for node, cost in self._with_insertions(states, budget).items() for word, count in self.words[node].items())

    def _with_insertions(self, states: dict[int, int], budget: int) -> dict[int, int]:
        if not budget:
            return states
        full, todo = dict(states), list(states.items())
        while todo:
            node, cost = todo.pop()
            if cost < budget:
                for child in self.edges[node].values():
                    if cost + 1 < full.get(child, budget + 1):
                        full[child] = cost + 1
                        todo.append((child, cost + 1))
        return full


def choose_spelling(token: str, accepted: list[tuple[int, str, int]]) -> str:
    """Of the spellings accepted at no cost the plain Latin one if it is a word of one script, else the most frequent such word, else the most frequent; without any, the table's form."""
    zero = [(word, count) for cost, word, count in accepted if cost == 0]
    if not zero:
        return table_form(token)
    skeleton = fold(token)
    return min(zero, key=lambda x: (not well_formed(x[0]), x[0] != skeleton, -x[1], x[0]))[0]


def _spell(vocabulary: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    trie = SpellingTrie()
    for word, count in zip(vocabulary["token"], vocabulary["n"], strict=True):
        trie.add(table_form(word), int(count))
    tokens = list(wanted["token"])
    return pd.DataFrame({"token": tokens, "spelling": [choose_spelling(t, trie.accept(t)) for t in tokens]}, dtype=object)


@F.pandas_udf(StringType())
def folded(tokens: pd.Series) -> pd.Series:
    return tokens.map(fold)


def _non_ascii(column: str) -> Column:
    return F.col(column).rlike(r"[^\x00-\x7f]")


def _changed_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, pos, token, folded) of the tokens that folding changes, or that mix scripts as a folded form may."""
    known: dict[str, str | None] = {}
    for batch in batches:
        rows: list[tuple] = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            for pos, token in enumerate(TOKEN.findall(text)):
                if token.isascii():
                    continue
                if token not in known:
                    if len(known) > 500_000:
                        known.clear()
                    form = fold(token)
                    known[token] = None if form == token and well_formed(token) else form
                if known[token] is not None:
                    rows.append((key, pos, token, known[token]))
        yield pd.DataFrame(rows, columns=["key", "pos", "token", "folded"])


@F.pandas_udf(StringType())
def _rewrite(texts: pd.Series, positions: pd.Series, spellings: pd.Series) -> pd.Series:
    """Replace tokens by position, then bring blanks to one form."""

    def one(text: str, at, to) -> str:
        if at is not None and len(at):
            new = dict(zip(at, to, strict=True))
            count = iter(range(len(text) + 1))
            text = TOKEN.sub(lambda m: new.get(next(count), m[0]), text)
        return layout(text)

    return pd.Series([one(*x) for x in zip(texts, positions, spellings, strict=True)], dtype=object)


def layout(text: str) -> str:
    return regex.sub(r" +(?=\n|\Z)", "", BLANKS.sub(" ", text.replace("\r\n", "\n"))).rstrip("\n")


def _ascii_layout(column: str) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.col(column), r"\r\n", "\n"), ASCII_BLANK + "+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" +(?=\n|\z)", ""), r"\n+\z", "")


def spelling_map(docs: DataFrame, changed: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(token, spelling) for every distinct changed token, by trie traversal per hash range of skeletons.

    ``changed`` has ``token`` and ``folded``. Of the vocabulary of all documents the words with a wanted
    skeleton are counted: plain ones where they are read, if the skeletons are few enough to be sent there.
    """
    wanted = stage(changed.select("token", F.xxhash64("folded").alias("skeleton")).distinct(), "wanted")
    skeletons = stage(wanted.select("skeleton").distinct(), "skeletons")
    if few := small_enough(skeletons, BROADCAST_SKELETONS):
        skeletons = F.broadcast(skeletons)
    words = docs.select(F.explode_outer(F.split("text", r"[\s\x1c-\x1f\x85\p{Z}]+")).alias("token")).where("token <> ''")
    count = lambda df, *more: df.groupBy("token", *more).agg(F.count(F.lit(1)).alias("n"))
    plain = words.where(~_non_ascii("token"))
    if few:
        plain = count(plain.withColumn("skeleton", F.xxhash64("token")).join(skeletons, "skeleton", "left_semi"), "skeleton")
    else:
        plain = count(plain).withColumn("skeleton", F.xxhash64("token")).join(skeletons, "skeleton", "left_semi")
    other = count(words.where(_non_ascii("token"))).withColumn("skeleton", F.xxhash64(folded("token"))).join(skeletons, "skeleton", "left_semi")
    vocabulary = stage(plain.select("token", "n", "skeleton").unionByName(other.select("token", "n", "skeleton")), "vocabulary")
    parts = vocabulary.count() // trie_words + 1
    part = lambda df: df.withColumn("part", F.pmod("skeleton", F.lit(parts)).cast("int"))
    return part(vocabulary).groupBy("part").cogroup(part(wanted).groupBy("part")).applyInPandas(_spell, "token string, spelling string")


def canonical_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, canonical) of every document with a text."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    plain = docs.where(~_non_ascii("text")).select("key", "text", _ascii_layout("text").alias("canonical"))
    other = docs.where(_non_ascii("text"))
    changed = stage(other.mapInPandas(_changed_tokens, f"key {dict(docs.dtypes)['key']}, pos int, token string, folded string"), "changed")
    spellings = spelling_map(docs, changed)
    replaced = changed.join(spellings, "token").groupBy("key").agg(F.collect_list("pos").alias("at"), F.collect_list("spelling").alias("to"))
    rewritten = other.join(replaced, "key", "left").select("key", "text", _rewrite("text", "at", "to").alias("canonical"))
    return plain.unionByName(rewritten)


def lookalike_pairs(canonical: DataFrame) -> DataFrame:
    """(key_a, key_b), a before b, of documents whose canonical texts are equal and whose own are not.

    Texts are compared by 128-bit hashes. Classes with one spelling are dropped first and spellings
    are paired before documents, so copies of one text are never paired with each other.
    """
    two = lambda c: [F.xxhash64(c).alias(f"{c}_1"), F.xxhash64(c, F.lit(7)).alias(f"{c}_2")]
    rows = stage(canonical.select("key", *two("canonical"), *two("text")), "lookalike")
    cls, raw = ["canonical_1", "canonical_2"], ["text_1", "text_2"]
    spelled = rows.select(*cls, *raw).distinct()
    several = spelled.groupBy(*cls).count().where("count > 1").select(*cls)
    spelled, members = spelled.join(several, cls, "left_semi"), rows.join(several, cls, "left_semi")
    left = spelled.select(*cls, *[F.col(c).alias(f"a_{c}") for c in raw])
    right = spelled.select(*cls, *[F.col(c).alias(f"b_{c}") for c in raw])
    pairs = left.join(right, cls).where("a_text_1 < b_text_1 or (a_text_1 = b_text_1 and a_text_2 < b_text_2)")
    side = lambda s: members.select(*cls, *[F.col(c).alias(f"{s}_{c}") for c in raw], F.col("key").alias(s))
    found = pairs.join(side("a"), [*cls, "a_text_1", "a_text_2"]).join(side("b"), [*cls, "b_text_1", "b_text_2"])
    return found.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).where("key_a <> key_b").distinct()
