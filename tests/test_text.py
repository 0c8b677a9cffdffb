import pytest
from pyspark.sql import functions as F

from tessera.functions import abstractions as ab
from tessera.functions import text as tx


def one(spark, value, column, kind="string"):
    frame = spark.createDataFrame([(value,)], f"x {kind}")
    return frame.select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("name", "slug"), [("A.B - (c) d", "ab_c_d"), ("Café-Bar (x)", "café_bar_x"), ("", ""), ("--- ", ""), ("x" * 300, "x" * 200), ("a b", "a_b")])
def test_slug(spark, name, slug):
    assert one(spark, name, tx.slug) == slug


@pytest.mark.parametrize(("name", "words"), [("calculateTotalPrice", "calculate total price"), ("foo_bar", "foo bar"), ("_x", "x"), ("HTTPServer", "httpserver")])
def test_split_identifier(spark, name, words):
    assert one(spark, name, tx.split_identifier) == words


def test_domains(spark):
    assert one(spark, "network_crypto", tx.domain_of_name) == "cryptography"  # order of the rules, not position
    assert one(spark, "diary", tx.domain_of_name) == "general"
    tags = lambda c: tx.domain_of_tags(c)
    assert one(spark, ["x", "websec"], tags, "array<string>") == "web_development"
    assert one(spark, ["x", "y"], tags, "array<string>") == "x"
    assert one(spark, [], tags, "array<string>") == ""


def test_query_terms(spark):
    assert tx.query_terms("What is data-base b 5?") == ["database", "5"]
    assert tx.query_terms("") == [] and tx.query_terms("a the") == []
    assert tx.query_terms("cipher cipher") == ["cipher", "cipher"]


def test_index_terms(spark):
    assert one(spark, "Élan vital foo_bar camelCase data-base don't", tx.index_terms) == ["elan", "vital", "foo", "bar", "camelcase", "data", "base", "don", "t"]
    assert one(spark, None, tx.index_terms) == []
    assert one(spark, "état ß æ", tx.index_terms) == ["etat", "ß", "æ"]


def test_lines(spark):
    text = "a\r\nb\n\nc\x0bd e\n"
    assert one(spark, text, tx.lines_of) == text.splitlines()
    assert one(spark, "", tx.lines_of) == []


def test_paths(spark):
    frame = spark.createDataFrame([("/a/b.tar.gz",), ("/a/.env",), ("/a/X.PY",), ("noext",)], "p string")
    assert [tuple(r) for r in frame.select(tx.file_suffix(F.col("p")), tx.file_stem(F.col("p")), tx.file_name(F.col("p"))).collect()] == [(".gz", "b.tar", "b.tar.gz"), ("", ".env", ".env"), (".py", "X", "X.PY"), ("", "noext", "noext")]


def test_token_estimate(spark):
    assert [one(spark, t, tx.token_estimate) for t in ("", "abc", "abcdefgh")] == [1, 1, 2]


def test_outline(spark):
    first = "This is the first paragraph of the text. And more of it follows here."
    text = "\n\n".join([first, first, "short", "9" * 45 + ". and so on for a while", "The second   paragraph\ntalks of other things! Yes."])
    assert one(spark, text, ab.outline_of_text) == "This is the first paragraph of the text; The second paragraph talks of other things"
    assert one(spark, "", ab.outline_of_text) == ""


@pytest.mark.parametrize(("n", "kept"), [(0, []), (3, [0, 1, 2]), (4, [0, 2, 3]), (7, [0, 3, 6])])
def test_passages(spark, n, kept):
    assert one(spark, [str(i) for i in range(n)], ab.sample_passages, "array<string>") == [str(i) for i in kept]


def test_summary(spark):
    text = "▪ a point that is long enough\n▪ no\nBig Data Systems are machines that keep very large tables for everyone."
    assert one(spark, text, lambda c: ab.summary_of_text(F.lit("N"), c)).startswith("N. Key topics: a point that is long enough")
    summary = one(spark, "Alpha Beta Gamma works. " * 4, lambda c: ab.summary_of_text(F.lit("N"), c))
    assert summary.startswith("N. Covers: Alpha Beta Gamma")
    assert one(spark, "short", lambda c: ab.summary_of_text(F.lit("N"), c)) == ""


def brute_keywords(text, top=100):
    import math
    import re
    from collections import Counter

    tokens = [w for w in re.split(r"[^\w]+", text.lower()) if re.fullmatch("[a-z]{3,}", w)]
    kept = [w for w in tokens if w not in ab.KEYWORD_STOP_WORDS]
    total = max(1, len(kept))
    score = {w: n / total * (1 + math.log(n)) for w, n in Counter(kept).items()}
    pairs = Counter(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False) if a not in ab.KEYWORD_STOP_WORDS and b not in ab.KEYWORD_STOP_WORDS)
    score |= {p: n / total * (1 + math.log(n)) * 2 for p, n in pairs.items() if n > 1}
    for noun, n in Counter(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text)).items():
        if n > 1 and len(noun) > 3:
            score[noun.lower()] = score.get(noun.lower(), 0) + n / total * 3
    for kind in re.findall(r"\b(?:" + "|".join(ab.DOCUMENT_KINDS) + r")\b", text.lower()):
        score[kind] = score.get(kind, 0) + 0.05
    return [t for t, _ in sorted(score.items(), key=lambda x: -round(x[1], 12))[:top]]


def test_keywords(spark):
    text = "The Packet Router sends a packet. The Packet Router of the guest lecture sends élan packets, packets and keynote data to Data Centre and Data Centre again. " * 2
    frame = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "id int, text string")
    found = {r["key"]: r["keywords"] for r in ab.keywords_of_text(frame, "id", "text").collect()}
    assert set(found) == {1} and found[1].split("; ") == brute_keywords(text)
