"""Noise in text from scanned pages: broken words, misread characters, running headers, page numbers.

Lines are judged with SQL windows over each record: page numbers by their form, running headers by
their masked form, in which all digits are one and case and blanks do not count. A masked line that
reads as a title is a header if a page number stands beside it, if it interrupts a sentence, or if it
is repeated in the collection. Any other masked line, of whatever case and number of words, is one if
it is repeated in several records at places where it interrupts the text: alone between blank lines
after an unfinished one, or much shorter than the lines of prose around it; and if most of its
occurrences are of this kind. What is left is joined into flowing text, across line and page ends.

Words are grouped by a skeleton in which glyphs that are easily confused are one. In a skeleton's
group a rare form is a misreading of the frequent form if the frequent form also occurs in the same
context (after the same word or before the same word, misread or not) somewhere in the collection.

All counts cover all records. Lines are shuffled once, by record; word statistics are combined where
the text is read. Words found in millions of records are rows of counts, never lists.

Defined results: null texts have no defects; an empty text neither; repeated rows count once, a key with
several texts has the defects of all of them; fenced blocks, lists, code and headings are left as they
are; a text without defect is returned unchanged; texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import small_enough, stage

# Glyphs that scans confuse, as single characters and as pairs over the result.
CONFUSED = dict(zip("1l!|ce0@59hf68$q4", "iiiieeoasgbtbbsga", strict=True))
CONFUSED_PAIRS = [("rn", "m"), ("vv", "w"), ("ei", "d"), ("ii", "u")]
MARKS = "-‐­¬"

HUNDREDS, TENS, ONES = "(?:cm|cd|d?c{1,3}|d)", "(?:xc|xl|l?x{1,3}|l)", "(?:ix|iv|v?i{1,3}|v)"
ROMAN = f"(?:m{{1,3}}{HUNDREDS}?{TENS}?{ONES}?|{HUNDREDS}{TENS}?{ONES}?|{TENS}{ONES}?|{ONES})"
NUMBER = rf"(?:\d{{1,4}}|{ROMAN})"
PAGE = rf"(?:(?:p|pp|s|pag|pág)\.\s?{NUMBER}|(?i:page|seite|página|pagina|strana)\s{NUMBER}|\[\s?{NUMBER}\s?\]|[-–—]\s?{NUMBER}\s?[-–—]|{NUMBER})"
PAGE_LINE = rf"^{PAGE}\s*$"
CHAPTER = r"(?:(?:Ch|Chap|Kap|Cap|Sec|Sect)\.\s?\d+|(?i:chapter|kapitel|chapitre|capítulo|section|part|teil)\s(?:\d+|[IVXLC]+))"
WORD_UP = r"(?:\p{Lu}[\p{L}\p{M}'’&]*|\p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+)"
SMALL = r"(?:of|the|and|for|in|to|a|an|on|und|der|die|das|von|für|de|la|le|les|des|du|et|del|los|y)"
SEPARATOR = r"(?:\s?[•·|–—:]\s{0,2}|\s{2}[•·|–—:]\s{0,2}|\s{2})"
#: Of a line whose runs of blanks are at most two; the words of group 3 are judged one by one.
HEADER = rf"^(?:({PAGE})\s{{2}})?(?:({CHAPTER}){SEPARATOR})?(\p{{Lu}}[\p{{L}}\p{{M}}'’&\s-]*?)(?:{SEPARATOR}({CHAPTER}))?(?:\s{{2}}({PAGE}))?$"
TITLE_WORD = rf"^(?:{WORD_UP}|{SMALL})$"
FENCE = r"^\s*(?:```|~~~)"
MARKUP = r"^\s*(?:[#>|*+]|[-–•]\s|\d+[.)]\s)"
BROKEN = rf"\p{{L}}[{MARKS}]\s*$"
TOKEN = r"[\p{L}\p{N}!@|$]*\p{L}[\p{L}\p{N}!@|$]*"

#: A line is repeated if it is there this often; a form is frequent if it is this often, and this many times as often as the other.
HEADER_LINES, FREQUENT, RATIO = 3, 5, 8
BROADCAST_ROWS = 100_000


def records_of(df: DataFrame, table_name: str, key: str, text: str) -> DataFrame:
    rows = df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("string").alias("record_key"), F.col(text).alias("text"))
    return rows.where("text is not null and record_key is not null and text <> ''")


def judged_lines(records: DataFrame) -> DataFrame:
    """One row per line of the records with several lines: (rec, n, line, kind, mask, ...).

    ``kind`` is text, blank, fence (also what is inside), page, or title. ``plain`` lines neither end a sentence nor
    are marked up; ``apart`` are those of them that interrupt the text. These and the titles have their ``mask``; ``sure``
    says whether a title is a running header whatever its mask.
    """
    lines = records.where(F.instr("text", "\n") > 0).select("rec", F.posexplode_outer(F.split("text", r"\r?\n")).alias("n", "line"))
    order = Window.partitionBy("rec").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fences = F.sum(F.col("line").rlike(FENCE).cast("int")).over(so_far)
    lines = lines.withColumn("fenced", F.col("line").rlike(FENCE) | (fences % 2 == 1))
    lines = lines.withColumn("page_like", ~F.col("fenced") & F.col("line").rlike(PAGE_LINE))
    free = ~F.col("fenced") & ~F.col("page_like")
    # a header begins with a capital letter or, after a page number or chapter, has two blanks or a mark before its title
    lines = lines.withColumn("squeezed", F.when(free & F.col("line").rlike(r"^\p{Lu}|\s{2}\S|[•·|–—:]"), F.regexp_replace(F.rtrim("line"), r"\s{2,}", "  ")))
    words = F.split(F.regexp_extract("squeezed", HEADER, 3), r"\s+")
    titled = (F.size(words) > 1) & F.get(words, F.size(words) - 1).rlike(rf"^{WORD_UP}$") & F.forall(words, lambda w: w.rlike(TITLE_WORD))
    lines = lines.withColumn("header", F.when(F.col("squeezed").rlike(HEADER) & titled, F.regexp_extract("squeezed", HEADER, 3)))
    near = lambda c, k: F.coalesce(F.lag(c, k).over(order) if k > 0 else F.lead(c, -k).over(order), F.lit(False))
    # numbers below one another are a list
    lines = lines.withColumn("page", F.col("page_like") & ~near("page_like", 1) & ~near("page_like", -1))
    at = lambda k: F.coalesce(F.lag("line", k).over(order) if k > 0 else F.lead("line", -k).over(order), F.lit(""))
    unfinished = lambda line: line.rlike(rf"[\p{{L}}\p{{N}},]\s*$|{BROKEN}") & ~line.rlike(MARKUP)
    goes_on, blank = at(-1).rlike(r"^[\p{Ll}\p{N}]"), lambda line: F.trim(line) == ""
    number = lambda *groups: F.concat(*[F.regexp_extract("squeezed", HEADER, k) for k in groups]) != ""
    sure = near("page", 1) | near("page", -1) | number(1, 2, 4, 5) | (goes_on & unfinished(at(1)))
    lines = lines.withColumn("sure", F.col("header").isNotNull() & (F.col("n") > 0) & sure)
    kind = (
        F.when(F.col("fenced"), "fence").when(F.col("page"), "page").when(F.col("header").isNotNull(), "title").when(blank(F.col("line")), "blank").otherwise("text")
    )
    lines = lines.withColumn("kind", kind)
    plain = (F.col("kind") == "text") & ~F.col("page_like") & ~F.col("line").rlike(rf"[.!?;,:]\s*$|{MARKUP}") & F.col("line").rlike(r"\p{L}")
    long = F.greatest(2 * F.length("line"), F.lit(1))
    prose = lambda line: (F.length(line) >= long) & line.rlike(r"(?:\S+\s+){7}\S")
    alone = blank(at(1)) & blank(at(-1)) & unfinished(at(2)) & ~blank(at(-2))
    beside = (near("page", 1) & prose(at(-1))) | (near("page", -1) & prose(at(1)))
    between = prose(at(1)) & prose(at(-1)) & goes_on & unfinished(at(1))
    lines = lines.withColumn("plain", plain).withColumn("apart", F.col("plain") & (alone | beside | between))
    mask = F.when((F.col("kind") == "title") | F.col("apart"), masked(F.coalesce("header", "line")))
    return lines.select("rec", "n", "line", "kind", "plain", mask.alias("mask"), "sure", "apart", (F.col("page") | (F.col("header").isNotNull() & number(1, 5))).alias("has_page"))


def masked(line: Column) -> Column:
    """What repeats of a header have in common: digits are one, case and the width of blanks do not count."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(line), r"\s+", " "), r"\d+", "#"))


def with_headers(judged: DataFrame) -> DataFrame:
    """Settle titles and plain lines: ``kind`` becomes header or text. ``judged`` is staged."""
    titles = judged.where("kind = 'title'").groupBy("mask").agg(F.count(F.lit(1)).alias("n_lines"), F.bool_or("sure").alias("known"))
    titles = titles.where(f"known or n_lines >= {HEADER_LINES}").select("mask", F.lit("title").alias("of"))
    repeated = judged.where("apart").groupBy("mask").agg(F.count_distinct("rec").alias("n_records")).where(f"n_records >= {HEADER_LINES}")
    repeated = stage(repeated.select("mask"), "repeated")
    # most of all occurrences, not only of those that interrupt
    every = judged.where("plain").select(masked(F.col("line")).alias("mask"), "apart").join(_sent(repeated), "mask").groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("apart").cast("int")).alias("n_apart"))
    known = stage(titles.unionByName(every.where("2 * n_apart > n").select("mask", F.lit("text").alias("of"))), "headers").withColumn("running", F.lit(True))
    # lines without a mask are spread by record where the masks are too many to be sent
    spread = F.col("mask") if small_enough(known, BROADCAST_ROWS) else F.coalesce("mask", F.concat(F.lit("\n"), F.col("rec").cast("string")))
    of = F.when(F.col("kind").isin("title", "text"), F.col("kind"))
    joined = judged.withColumns({"mask": spread, "of": of}).join(_sent(known), ["mask", "of"], "left")
    running = F.coalesce("running", F.lit(False)) & (F.col("n") > 0)
    kind = F.when((F.col("kind") == "title") & (F.col("sure") | running), "header").when(F.col("kind") == "title", "text").when((F.col("kind") == "text") & running & F.col("apart"), "header").otherwise(F.col("kind"))
    return joined.select("rec", "n", "line", kind.alias("kind"), "has_page")


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if small_enough(rows, BROADCAST_ROWS) else rows


def joined_lines(lines: DataFrame) -> DataFrame:
    """Content lines with ``broken`` (the word goes on in the next content line) and the ``piece`` and ``gap`` of the flowing text."""
    order = Window.partitionBy("rec").orderBy("n")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("blanks", F.sum((F.col("kind") == "blank").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lines = lines.withColumn("furniture", F.sum(F.col("kind").isin("header", "page").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    content = lines.where(F.col("kind").isin("text", "fence"))
    follows, next_kind = F.lead("line").over(order), F.lead("kind").over(order)
    prose = (F.col("kind") == "text") & ~F.col("line").rlike(r"^\s*[#>|]")
    broken = prose & (next_kind == "text") & F.col("line").rlike(BROKEN) & F.coalesce(follows.rlike(r"^\s*\p{Ll}"), F.lit(False))
    content = content.withColumn("broken", F.coalesce(broken, F.lit(False)))
    after_break = F.coalesce(F.lag("broken").over(order), F.lit(False))
    apart = F.col("blanks") > F.coalesce(F.lag("blanks").over(order), F.lit(0))
    page_end = F.col("furniture") > F.coalesce(F.lag("furniture").over(order), F.lit(0))
    previous = F.coalesce(F.lag("line").over(order), F.lit(""))
    runs_on = page_end & ~previous.rlike(r"[.!?:;]\s*$") & F.col("line").rlike(r"^\s*[\p{Ll}\p{N}]")
    stays = (F.col("kind") == "fence") | (F.lag("kind").over(order) == "fence") | F.col("line").rlike(MARKUP)
    first = F.count(F.lit(1)).over(back) == 0
    gap = F.when(first | after_break, "").when(apart & ~runs_on, "\n\n").when(stays, "\n").otherwise(" ")
    trimmed = F.rtrim("line")
    piece = F.when(F.col("broken"), F.regexp_replace(trimmed, rf"[{MARKS}]$", "")).when(F.col("kind") == "fence", F.col("line")).otherwise(F.when(stays, trimmed).otherwise(F.trim(trimmed)))
    return content.select("rec", "n", "kind", "broken", piece.alias("piece"), gap.alias("gap"))


def flowing(pieces: DataFrame) -> DataFrame:
    """(rec, text, hyphenation) put together in line order."""
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat("gap", "piece").alias("part"))))
    return pieces.groupBy("rec").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"), F.bool_or("broken").alias("hyphenation"))


def skeleton(word: Column) -> Column:
    word = F.translate(F.lower(word), "".join(CONFUSED), "".join(CONFUSED.values()))
    for pair, one in CONFUSED_PAIRS:
        word = F.replace(word, F.lit(pair), F.lit(one))
    return word


def words_in_context(texts: DataFrame) -> DataFrame:
    """(rec, word, before, after) of every word, lower case."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    # outer, as an inner explosion would extract the words a second time to filter out empty lists
    rows = texts.select("rec", words.alias("w")).select("rec", "w", F.posexplode_outer("w").alias("i", "word")).where("word is not null")
    return rows.select("rec", "word", F.coalesce(F.get("w", F.col("i") - 1), F.lit("")).alias("before"), F.coalesce(F.get("w", F.col("i") + 1), F.lit("")).alias("after"))


def misreadings(texts: DataFrame) -> DataFrame:
    """(rec, word, reading): the words of each record that are misread, and their right form.

    Of several frequent forms the one that the context supports most often is taken.
    """
    pairs = stage(words_in_context(texts).groupBy("word", "before").agg(F.count(F.lit(1)).alias("n")), "bigrams")
    counts = pairs.groupBy("word").agg(F.sum("n").alias("n"))
    forms = stage(counts.withColumn("skeleton", skeleton(F.col("word"))), "forms")
    frequent = forms.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^\p{L}+$")).select("skeleton", F.col("word").alias("reading"), F.col("n").alias("often"))
    suspects = forms.join(frequent, "skeleton").where(f"word <> reading and often >= {RATIO} * n").select("word", "reading", "often")
    suspects = stage(suspects, "suspects")
    # how often each reading stands after, and before, a word of a skeleton
    readings = _sent(stage(suspects.select("reading").distinct(), "readings"))
    side = lambda at, of, beside: pairs.select(F.col(of).alias("reading"), skeleton(F.col(beside)).alias("context"), "n").join(readings, "reading", "left_semi").select(F.lit(at).alias("side"), "*")
    contexts = side(0, "word", "before").unionByName(side(1, "before", "word")).groupBy("reading", "side", "context").agg(F.sum("n").alias("support"))
    contexts = stage(contexts, "contexts")
    found = words_in_context(texts).join(_sent(suspects.select("word").distinct()), "word").distinct()
    found = found.join(_sent(suspects), "word").select("rec", "word", "reading", "often", skeleton(F.col("before")).alias("before"), skeleton(F.col("after")).alias("after"))
    beside = F.posexplode(F.array("before", "after")).alias("side", "context")
    supported = found.select("rec", "word", "reading", "often", "before", "after", beside).join(_sent(contexts), ["reading", "side", "context"])
    supported = supported.groupBy("rec", "word", "reading", "often", "before", "after").agg(F.sum("support").alias("support"))
    return supported.groupBy("rec", "word").agg(F.max(F.struct("support", "often", "reading")).alias("best")).select("rec", "word", "best.reading")


class Repair:
    """The stages of a repair over ``records(table_name, record_key, text)``; each is computed once."""

    def __init__(self, records: DataFrame) -> None:
        records = records.select("table_name", "record_key", "text", F.xxhash64("table_name", "record_key", "text").alias("rec"))
        self.records = records
        self.lines = stage(with_headers(stage(judged_lines(records), "judged")), "lines")
        pieces = joined_lines(self.lines)
        words_only = pieces.withColumn("piece", F.when(F.col("kind") == "text", F.col("piece")).otherwise(F.lit("")))
        self.flat = stage(flowing(words_only), "flat")
        single = records.where(F.instr("text", "\n") == 0).select("rec", "text").distinct()
        self.misread = stage(misreadings(self.flat.select("rec", "text").unionByName(single)), "misread")

    def defects(self) -> DataFrame:
        """(table_name, record_key, defect), distinct."""
        of = lambda df, name: df.select("rec", F.lit(name).alias("defect"))
        found = (
            of(self.flat.where("hyphenation"), "hyphenation")
            .unionByName(of(self.misread, "misread"))
            .unionByName(of(self.lines.where("kind = 'header'"), "running_header"))
            .unionByName(of(self.lines.where("kind = 'page' or (kind = 'header' and has_page)"), "page_number"))
        ).distinct()
        return self.records.select("rec", "table_name", "record_key").join(found, "rec").select("table_name", "record_key", "defect").distinct()

    def repaired(self) -> DataFrame:
        """(table_name, record_key, text, repaired): texts without defect come back as they are."""
        flow = flowing(joined_lines(self.lines)).select("rec", F.col("text").alias("flow"), "hyphenation")
        noisy = self.lines.where("kind in ('header', 'page')").select("rec").distinct().withColumn("noisy", F.lit(True))
        fixes = self.misread.groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("fixes"))
        rows = self.records.dropDuplicates(["rec"]).join(flow, "rec", "left").join(noisy, "rec", "left").join(fixes, "rec", "left")
        reflow = F.coalesce("hyphenation", F.lit(False)) | F.coalesce("noisy", F.lit(False)) | (F.col("fixes").isNotNull() & F.col("flow").isNotNull())
        text = F.when(reflow, F.col("flow")).otherwise(F.col("text"))
        return rows.select("table_name", "record_key", "text", F.when(F.col("fixes").isNull(), text).otherwise(_replace_words(text, F.col("fixes"))).alias("repaired"))


def _replace_words(text: Column, fixes: Column) -> Column:
    """Each misread word replaced by its reading, in the case of its first letter; what is between the words stays."""
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN)
    fixed = F.transform(words, lambda w: F.coalesce(_same_case(F.element_at(fixes, F.lower(w)), w), w))
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), fixed.alias("word")), lambda x: F.concat(F.coalesce(x["gap"], F.lit("")), F.coalesce(x["word"], F.lit("")))), "")


def _same_case(reading: Column, word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return F.when(first != F.lower(first), F.concat(F.upper(F.substring(reading, 1, 1)), F.substring(reading, F.lit(2), F.length(reading)))).otherwise(reading)
