"""Column functions for names, tokens and text. All are built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word in the sense of the usual regex class: letters, digits, underscore. Java's and RE2's own class is ASCII only.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\s\p{Z}"
#: Line ends that split text into lines (as text readers with universal line ends do).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# First match wins, in this order.
NAME_DOMAINS = [
    ("security", "cybersecurity"), ("cyber", "cybersecurity"), ("crypto", "cryptography"), ("encrypt", "cryptography"),
    ("network", "networking"), ("wireless", "networking"), ("mobile", "networking"), ("cloud", "cloud_computing"),
    ("access", "identity_management"), ("auth", "identity_management"), ("vulnerab", "vulnerability_management"),
    ("ethic", "ethics"), ("privacy", "ethics"), ("crime", "ethics"), ("algorithm", "algorithms"),
    ("data_structure", "data_structures"), ("math", "mathematics"), ("web", "web_development"),
]
TAG_DOMAINS = [
    ("algorithm", "algorithms"), ("graph", "graph_algorithms"), ("data_structure", "data_structures"), ("architecture", "architecture"),
    ("math", "mathematics"), ("web", "web_development"), ("system", "systems"), ("security", "cybersecurity"),
]
# Words that are left out of queries.
QUERY_STOP_WORDS = [
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "and", "or", "is", "are", "was", "were", "be", "been", "am", "do", "does",
    "did", "done", "have", "has", "had", "i", "you", "it", "this", "that", "these", "those", "my", "me", "we", "us", "our", "what", "which",
    "how", "when", "where", "who", "why", "as", "by", "from", "about",
]


def _folding() -> tuple[str, str]:
    """Latin letters with one mark, and their base letters (the index tokeniser folds no others)."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code).lower())
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]) and chr(code).islower():
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (an expression inside a lambda is not shared otherwise)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_spaces(column: Column) -> Column:
    return F.regexp_replace(column, rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def slug(name: Column) -> Column:
    """Lower case, no punctuation, blanks and hyphens as one underscore, at most 200 characters."""
    kept = F.regexp_replace(F.lower(name), rf"[^{WORD_CLASS}{SPACE_CLASS}\-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, rf"[{SPACE_CLASS}\-]+", "_"), r"^_+|_+$", ""), 1, 200)


def split_identifier(name: Column) -> Column:
    """camelCase and snake_case as lower-case words."""
    return strip_spaces(F.lower(F.translate(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), "_", " ")))


def _first_match(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    found = otherwise
    for part, domain in reversed(rules):
        found = F.when(F.contains(text, F.lit(part)), F.lit(domain)).otherwise(found)
    return found


def domain_of_name(name: Column) -> Column:
    return _first_match(F.lower(name), NAME_DOMAINS, F.lit("general"))


def domain_of_tags(tags: Column) -> Column:
    """The domain of the first tag that has one, else the first tag, else the empty string."""
    named = F.filter(F.transform(tags, lambda t: _first_match(F.lower(t), TAG_DOMAINS, F.lit(None).cast("string"))), lambda d: d.isNotNull())
    return F.coalesce(F.get(named, F.lit(0)), F.get(tags, F.lit(0)), F.lit(""))


def domain_of(tags: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(domain_of_tags(tags), F.lit("")), domain_of_name(name))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def embedding_text(name: Column, summary: Column, keywords: Column) -> Column:
    return F.concat_ws(" | ", F.coalesce(name, F.lit("")), F.coalesce(summary, F.lit("")), F.coalesce(keywords, F.lit("")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    """The last extension in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.*[^.](\.[^.]+)$", 1))


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes, bad bytes replaced, line ends as \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def lines_of(text: Column) -> Column:
    """Lines without their ends; no empty last line after a final line end."""
    return let(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def index_terms(text: Column) -> Column:
    """Terms of the keyword index: lower case, marks dropped, Latin letters with a mark folded, runs of letters and digits."""
    text = F.coalesce(text, F.lit(""))
    folded = F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), FOLD_FROM, FOLD_TO)
    # plain text needs no folding, and its terms are found by a plain class
    terms = F.when(text.rlike(r"[^\x00-\x7f]"), F.split(folded, r"[^\p{L}\p{N}\p{Co}]+")).otherwise(F.split(F.lower(text), "[^a-z0-9]+"))
    return F.array_remove(terms, "")


def query_terms(query: str) -> list[str]:
    """Words of a query: what is no letter or digit is deleted inside them; stop words and single letters go; repeats stay."""
    words = ("".join(c for c in raw if c.isalnum()) for raw in query.lower().split())
    return [w for w in words if w and w not in QUERY_STOP_WORDS and (len(w) > 1 or w.isdigit())]
