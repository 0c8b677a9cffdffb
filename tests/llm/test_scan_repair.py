from tessera.llm import scan_repair as sr

WORDS = "The parallel router sends every packet behind the gateway to the other router of the network and waits."
BASE = [(f"base{i}", WORDS) for i in range(40)]
SCAN = (
    "The parallel router sends every pac-\nket behind the gateway to the other\nRouting Systems Handbook   [12]\nrouter of the net-\nPage 13\n\nwork and waits. The parallel\n"
    "14\nrouter sends every packet behind the gateway to the other router of the network and waits."
)


def repair(spark, items):
    frame = spark.createDataFrame(items, "k string, t string")
    return sr.Repair(sr.records_of(frame, "t", "k", "t").distinct())


def defects(spark, items):
    found = {}
    for _, key, defect in repair(spark, items).defects().collect():
        found.setdefault(key, set()).add(defect)
    return found


def test_defects(spark):
    items = [
        *BASE,
        ("scan", SCAN),
        ("misread", WORDS.replace("router", "routcr", 1).replace("packet", "p@cket")),
        ("split", WORDS.replace("gateway", "g@te-\nway")),
        ("fence", "A list of numbers:\n\n```\n12\n```\n\nand that is-\n"),
        ("list", "Numbers\n12\n13\n14\nand more of them"),
        ("notes", "# A Heading Here\n\n- one\n- two\n\nSome Title Words\n\nplain text that\nis wrapped over lines"),
        ("roman", "some running text that goes on\nxlii\nand on over the page"),
        ("soft", "the soft hy­\nphen and the not sign bro¬\nken"),
    ]
    assert defects(spark, items) == {
        "scan": {"hyphenation", "running_header", "page_number"},
        "misread": {"misread"},
        "split": {"misread", "hyphenation"},
        "roman": {"page_number"},
        "soft": {"hyphenation"},
    }


def test_repaired_text(spark):
    done = {r["record_key"]: r["repaired"] for r in repair(spark, [*BASE, ("scan", SCAN), ("m", WORDS.replace("The", "Tbe") + "\tNext  one.")]).repaired().collect()}
    assert done["scan"] == f"{WORDS} {WORDS}"
    assert done["m"] == WORDS + "\tNext  one."
    assert done["base1"] == WORDS


def test_headers_by_frequency(spark):
    page = "some words of a text\n\n{}\n\nMore words of a text stand here."
    items = [(f"h{i}", page.format("A Rather Long Title")) for i in range(3)] + [("once", page.format("Another Rather Long Title"))]
    assert defects(spark, items) == {f"h{i}": {"running_header"} for i in range(3)}


def test_headers_are_masked_lines(spark):
    """Of any case and any number of words, with digits masked; lists, headings and ends of sentences are none."""
    page = "some words of a text\n\n{}\n\nMore words of a text stand here."
    titles = ["Annual Report 202{}", "Volume {} Routing Systems", "Introduction", "the router handbook"]
    items = [(f"{t}-{i}", page.format(title.format(i))) for t, title in enumerate(titles) for i in range(3)]
    others = ["- Annual Report 202{}", "## Introduction", "1. the router handbook", "a sentence that ends.", "status: draft {},"]
    items += [(f"o{t}-{i}", page.format(title.format(i))) for t, title in enumerate(others) for i in range(5)]
    items += [(f"after{i}", "A sentence that ends.\n\nMerged note {i}\n\nMore words of a text stand here.") for i in range(5)]
    assert defects(spark, items) == {f"{t}-{i}": {"running_header"} for t in range(4) for i in range(3)}


def test_long_header(spark):
    """No line is too long for a title, and a masked line between lines of prose need not stand alone."""
    prose = "the words of a long line of prose that goes on and on until it comes to its end and so"
    long = " ".join(["Rather Long"] * 300)
    assert defects(spark, [("long", f"{prose}\n{long}\n{prose} on.")]) == {"long": {"running_header"}}
    items = [(f"b{i}", f"{prose} {i} the\nannual report {i}\n{prose} on {i}.") for i in range(3)]
    assert defects(spark, items) == {f"b{i}": {"running_header"} for i in range(3)}


def test_short_and_neighbouring_misreadings(spark):
    base = [(f"a{i}", "we go to the river with our friends") for i in range(30)]
    assert defects(spark, [*base, ("two", "we 9o to the river with our friends"), ("both", "we go to tbe rivcr with our friends")]) == {"two": {"misread"}, "both": {"misread"}}
    done = {r["record_key"]: r["repaired"] for r in repair(spark, [*base, ("all", "we 9o to tbe rivcr witb our friends")]).repaired().collect()}
    assert done["all"] == "we go to the river with our friends"


def test_context_decides(spark):
    """A rare word that looks like a frequent one is left alone where the frequent one is never seen."""
    items = [(f"a{i}", "we eat bread with cheese today") for i in range(30)] + [("x", "they saw brcad statues"), ("y", "we eat brcad with cheese today")]
    assert defects(spark, items) == {"y": {"misread"}}


def test_edges(spark):
    long = "word and word " * 50_000
    assert defects(spark, [("n", None), ("e", ""), ("l", long), ("l", long), (None, "a-\nb"), ("nl", "\n\n\n"), ("f", "```")]) == {}
    assert defects(spark, [("n", None)]) == {}
    twice = defects(spark, [("k", "a bro-\nken word"), ("k", "some running text that goes on\n7\nand on over the page")])
    assert twice == {"k": {"hyphenation", "page_number"}}
