"""Queries of the text functions, the keyword operators and the parsers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import abstractions as ab
from tessera.functions import text as tx
from tessera.operators import code, markdown, ontology
from tessera.operators import compile as cp
from tessera.operators.vectors import hash_embedding
from tessera.sources import files
from tessera.staging import stage, table


def _docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *columns)


def slugs(spark, folder):
    return _docs(spark, folder, "name").where("name is not null").select("doc_id", tx.slug(F.col("name")).alias("slug"))


def split_identifiers(spark, folder):
    return table(spark, folder, "file_state").select("file_path").distinct().select("file_path", tx.split_identifier(tx.file_stem(F.col("file_path"))).alias("words"))


def name_domains(spark, folder):
    return _docs(spark, folder, "name").where("name is not null").select("doc_id", tx.domain_of_name(F.col("name")).alias("name_domain"))


def tag_domains(spark, folder):
    rows = _docs(spark, folder, "name", "tags").where("name is not null").withColumn("t", F.filter(F.split(F.coalesce("tags", F.lit("")), " "), lambda t: t != ""))
    return rows.select("doc_id", tx.domain_of_tags(F.col("t")).alias("tag_domain"), tx.domain_of(F.col("t"), F.col("name")).alias("effective_domain"))


def token_estimates(spark, folder):
    return _docs(spark, folder, "text").where("text is not null").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens"))


def embedding_texts(spark, folder):
    rows = table(spark, folder, "knowledge_store").where("object_id is not null").distinct()
    return rows.select("object_id", tx.embedding_text(F.col("name"), F.col("level_2"), F.col("level_3")).alias("embedding_text"))


def file_types(spark, folder):
    paths = table(spark, folder, "file_state").select("file_path").distinct()
    return paths.select("file_path", tx.file_suffix(F.col("file_path")).alias("suffix"), F.coalesce(files.type_by_name(F.col("file_path")), F.lit("sniff")).alias("kind"))


def ignored_paths(spark, folder):
    paths = table(spark, folder, "file_state").select("file_path").distinct()
    return paths.where(files.is_ignored(F.substring("file_path", F.lit(2), F.lit(1_000_000)), ["*.min.js", "*archive*"])).select("file_path")


def term_frequency(spark, folder):
    rows = _docs(spark, folder, "text").select("doc_id", F.explode_outer(tx.index_terms(F.col("text"))).alias("term")).where("term is not null")
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(spark, folder):
    rows = _docs(spark, folder, "text").select("doc_id", F.explode_outer(F.array_distinct(tx.index_terms(F.col("text")))).alias("term")).where("term is not null")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _scored(spark, folder, kind):
    parts = ab.term_parts(_docs(spark, folder, "text"), "doc_id", "text").where(F.col("kind") == kind)
    return parts.withColumnRenamed("key", "doc_id")


def keywords_unigram(spark, folder):
    score = F.col("n") / F.col("total") * F.when(F.col("n") > 1, 1 + F.log("n")).otherwise(F.lit(1.0))
    return _scored(spark, folder, 0).select("doc_id", "term", F.round(score, 6).alias("score"))


def keywords_bigram(spark, folder):
    score = F.col("n") / F.col("total") * (1 + F.log("n")) * 2
    return _scored(spark, folder, 1).where("n >= 2").select("doc_id", "term", F.round(score, 6).alias("score"))


def proper_nouns(spark, folder):
    return _scored(spark, folder, 2).where("n >= 2 and length(term) > 3").select("doc_id", "term", "n")


def keywords_top100(spark, folder):
    rows = ab.keyword_table(_docs(spark, folder, "text"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "term", F.round("score", 6).alias("score"))


def outlines(spark, folder):
    return _docs(spark, folder, "text").where("text is not null").select("doc_id", ab.outline_of_text(F.col("text")).alias("outline"))


def passages(spark, folder):
    return _docs(spark, folder, "text").where("text is not null").select("doc_id", F.posexplode(ab.passages_of_text(F.col("text"))).alias("pos", "passage")).select("doc_id", F.col("pos").cast("long").alias("pos"), "passage")


def summaries(spark, folder):
    return _docs(spark, folder, "name", "text").where("text is not null").select("doc_id", ab.summary_of_text(F.coalesce("name", F.lit("")), F.col("text")).alias("summary"))


def hash_vectors(spark, folder):
    """The whole vector of every name, zeros for a blank one."""
    return _docs(spark, folder, "name").where("name is not null").select("doc_id", hash_embedding(F.col("name")).alias("vector"))


def _notes(spark, folder):
    return table(spark, folder, "knowledge_store").where("level_0 is not null and object_id is not null").select("object_id", F.col("level_0").alias("text")).distinct()


def markdown_headings(spark, folder):
    rows = _notes(spark, folder).select("object_id", F.explode_outer(markdown.headings_of(tx.lines_of(F.col("text")))).alias("h")).where("h is not null")
    return rows.select("object_id", "h.node", F.col("h.level").cast("long").alias("level"), F.col("h.line").cast("long").alias("line"), F.col("h.line_end").cast("long").alias("line_end"), "h.is_leaf", F.col("h.parent").cast("long").alias("parent"))


def markdown_links(spark, folder):
    rows = _notes(spark, folder).select("object_id", F.explode_outer(markdown.links_of(tx.lines_of(F.col("text")))).alias("l")).where("l is not null")
    return rows.select("object_id", "l.target", "l.alias", F.col("l.line").cast("long").alias("line"))


def markdown_tags(spark, folder):
    return _notes(spark, folder).select("object_id", F.explode_outer(markdown.tags_of(F.col("text"))).alias("tag")).where("tag is not null")


def markdown_blocks(spark, folder):
    rows = _notes(spark, folder).withColumn("lines", tx.lines_of(F.col("text"))).withColumn("h", markdown.headings_of(F.col("lines")))
    return rows.select("object_id", F.explode_outer(markdown.blocks_of(F.col("lines"), F.col("h"))).alias("b")).where("b is not null").select("object_id", "b.heading_context", F.col("b.start_line").cast("long").alias("start_line"), "b.raw_text")


def markdown_front_matter(spark, folder):
    return markdown.parse_markdown(_notes(spark, folder)).select("object_id", F.to_json("metadata").alias("metadata"), F.array_join("tags", ",").alias("tags"))


def _heads(spark, folder):
    return table(spark, folder, "source_heads").where("head is not null").select(F.col("file_path").alias("path"), F.col("head").alias("text"))


def code_bundles(spark, folder):
    """What is found in every code head, as JSON: imports, classes, functions, docstrings and comments."""
    bundle = F.struct("parser_source", "imports", "classes", "functions", "docstrings", "comments")
    return code.parse_code(_heads(spark, folder)).select("path", F.to_json(bundle).alias("bundle"))


def hash_comments(spark, folder):
    return _heads(spark, folder).select("path", F.array_join(code.hash_comments(F.col("text")), "\n").alias("comments"))


def line_comments(spark, folder):
    return _heads(spark, folder).select("path", F.array_join(code.line_comments(F.col("text")), "\n").alias("comments"))


def compiled_objects(spark, folder):
    """Every note, code head and plain text compiled as if it were a file, with the checks' rejections taken out."""
    seq = F.lit(0).cast("long").alias("seq")
    notes = _notes(spark, folder).select(F.concat("object_id", F.lit(".md")).alias("path"), "text", seq)
    heads = _heads(spark, folder).select("path", "text", seq)
    texts = table(spark, folder, "documents").where("content is not null").select(F.concat(F.lit("/texts/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("content").alias("text"), seq)
    objects = stage(cp.compile_markdown(notes).unionByName(cp.compile_code(heads)).unionByName(cp.compile_text(texts)), "objects")
    batch = objects.select(F.col("source_file").alias("batch"), "id", "type", "ontology_class", "level_0", "level_2")
    bad = ontology.validate(batch, cp.links_of_objects(objects)).select(F.col("batch").alias("source_file"), F.col("object_id").alias("id")).distinct()
    return objects.join(bad, ["source_file", "id"], "left_anti").select("id", "type", "name", "domain", "source_file", "level_1", "level_2", "level_3", F.size("relationships").alias("n_links"))


QUERIES = {
    f.__name__: f
    for f in (
        slugs, split_identifiers, name_domains, tag_domains, token_estimates, embedding_texts, file_types, ignored_paths, term_frequency, document_frequency, keywords_unigram, keywords_bigram,
        proper_nouns, keywords_top100, outlines, passages, summaries, hash_vectors, markdown_headings, markdown_links, markdown_tags, markdown_blocks, markdown_front_matter, code_bundles,
        hash_comments, line_comments, compiled_objects,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------


def _cases(text: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{part}') THEN '{domain}'" for part, domain in rules) + f" ELSE {otherwise} END"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SLUG = r"substr(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}\-]', '', 'g'), '[\s\p{{Z}}\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 200)"
FILE = r"regexp_extract(file_path, '([^/]*)$', 1)"
SUFFIX = rf"lower(regexp_extract({FILE}, '^.*[^.](\.[^.]+)$', 1))"
TERMS = f"list_filter(regexp_split_to_array(translate(regexp_replace(lower(coalesce({{0}}, '')), '\\p{{{{M}}}}', '', 'g'), '{tx.FOLD_FROM}', '{tx.FOLD_TO}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Co}}}}]+'), lambda t: t <> '')"
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}'))"
STOPS = _list(ab.KEYWORD_STOP_WORDS)
WORD_CTES = f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents WHERE length(text) >= 50),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
total AS (SELECT doc_id, greatest(count(*) FILTER (WHERE w NOT IN {STOPS}), 1) AS total FROM w GROUP BY 1),
uni AS (SELECT doc_id, w AS term, count(*) AS n, min(i) AS first FROM w WHERE w NOT IN {STOPS} GROUP BY 1, 2),
bi AS (SELECT a.doc_id, a.w || ' ' || b.w AS term, count(*) AS n, min(a.i) AS first FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1
       WHERE a.w NOT IN {STOPS} AND b.w NOT IN {STOPS} GROUP BY 1, 2)
"""
# RE2 knows word borders of ASCII only, so words with other letters are blotted out first
LETTERS = r"\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{370}-\x{52F}\x{1E00}-\x{1EFF}\x{FB00}-\x{FB06}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}"
NOUN_CTE = rf"""
nouns AS (SELECT doc_id, unnest(found) AS noun, generate_subscripts(found, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*[{LETTERS}][A-Za-z0-9_{LETTERS}]*', '0', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') AS found
  FROM documents WHERE length(text) >= 50)),
noun AS (SELECT doc_id, noun AS term, count(*) AS n, min(i) AS first FROM nouns GROUP BY 1, 2)
"""
PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {STRIP.format('p')}), lambda p: length(p) > @chars@)"
SENTENCE = STRIP.format(r"regexp_split_to_array(p, '[.!?]\s')[1]")
LINES = r"CASE WHEN regexp_matches(text, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])$') THEN l[1:len(l)-1] ELSE l END"
NOTES = rf"""
notes AS (SELECT object_id, text, {LINES} AS lines FROM (
  SELECT DISTINCT object_id, level_0 AS text, regexp_split_to_array(level_0, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l
  FROM knowledge_store WHERE level_0 IS NOT NULL AND object_id IS NOT NULL)),
ln AS (SELECT object_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM notes),
marked AS (SELECT *, length(regexp_extract(line, '^#+')) AS level, {STRIP.format("regexp_replace(line, '^#+', '')")} AS title FROM ln),
heads AS (SELECT object_id, text, level, title, n AS line, lead(level) OVER p AS next_level, lead(n) OVER p AS next_line
          FROM marked WHERE level > 0 AND title <> '' WINDOW p AS (PARTITION BY object_id, text ORDER BY n)),
h AS (SELECT t.object_id, t.text, 'H' || level || ': ' || title AS node, level::BIGINT AS level, line::BIGINT AS line, coalesce(next_line - 1, len(s.lines))::BIGINT AS line_end,
      coalesce(next_level, 0) <= level AS is_leaf, row_number() OVER (PARTITION BY t.object_id, t.text ORDER BY line) - 1 AS i FROM heads t JOIN notes s ON s.object_id = t.object_id AND s.text = t.text)
"""

ORACLES = {
    "slugs": f"SELECT doc_id, {SLUG.format('name')} AS slug FROM documents WHERE name IS NOT NULL",
    "split_identifiers": rf"""SELECT file_path, {STRIP.format("lower(replace(regexp_replace(stem, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '))")} AS words FROM (
      SELECT DISTINCT file_path, CASE WHEN {SUFFIX} = '' THEN {FILE} ELSE left({FILE}, length({FILE}) - length({SUFFIX})) END AS stem FROM file_state WHERE file_path IS NOT NULL)""",
    "name_domains": f"SELECT doc_id, {_cases('lower(name)', tx.NAME_DOMAINS, chr(39) + 'general' + chr(39))} AS name_domain FROM documents WHERE name IS NOT NULL",
    "tag_domains": f"""SELECT doc_id, d AS tag_domain, coalesce(nullif(d, ''), {_cases('lower(name)', tx.NAME_DOMAINS, chr(39) + 'general' + chr(39))}) AS effective_domain FROM (
      SELECT doc_id, name, coalesce(list_filter(list_transform(t, lambda x: {_cases('lower(x)', tx.TAG_DOMAINS, 'NULL')}), lambda x: x IS NOT NULL)[1], t[1], '') AS d FROM (
      SELECT doc_id, name, list_filter(string_split(coalesce(tags, ''), ' '), lambda t: t <> '') AS t FROM documents WHERE name IS NOT NULL))""",
    "token_estimates": "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "embedding_texts": "SELECT object_id, coalesce(name, '') || ' | ' || coalesce(level_2, '') || ' | ' || coalesce(level_3, '') AS embedding_text FROM (SELECT DISTINCT * FROM knowledge_store WHERE object_id IS NOT NULL)",
    "term_frequency": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY 1, 2",
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({TERMS.format('text')})) AS term FROM documents) GROUP BY 1",
    "keywords_unigram": WORD_CTES + "SELECT doc_id, term, round(n / total * CASE WHEN n > 1 THEN 1 + ln(n) ELSE 1 END, 6) AS score FROM uni JOIN total USING (doc_id)",
    "keywords_bigram": WORD_CTES + "SELECT doc_id, term, round(n / total * (1 + ln(n)) * 2, 6) AS score FROM bi JOIN total USING (doc_id) WHERE n >= 2",
    "proper_nouns": "WITH " + NOUN_CTE + "SELECT doc_id, term, n FROM noun WHERE n >= 2 AND length(term) > 3",
    "keywords_top100": WORD_CTES
    + ", "
    + NOUN_CTE
    + rf""", kinds AS (SELECT doc_id, unnest(found) AS term, generate_subscripts(found, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\b(?:{"|".join(ab.DOCUMENT_KINDS)})\b') AS found FROM documents WHERE length(text) >= 50)),
    parts AS (
      SELECT doc_id, term, n / total * CASE WHEN n > 1 THEN 1 + ln(n) ELSE 1 END AS score, 0 AS kind, first FROM uni JOIN total USING (doc_id)
      UNION ALL SELECT doc_id, term, n / total * (1 + ln(n)) * 2, 1, first FROM bi JOIN total USING (doc_id) WHERE n >= 2
      UNION ALL SELECT doc_id, lower(term), n / total * 3, 2, first FROM noun JOIN total USING (doc_id) WHERE n >= 2 AND length(term) > 3
      UNION ALL SELECT doc_id, term, count(*) * 0.05, 3, min(i) FROM kinds GROUP BY 1, 2),
    scored AS (SELECT doc_id, term, sum(score) AS score, min(kind * 10000000 + first) AS place FROM parts GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, place, term) AS rank FROM scored)
    SELECT doc_id, rank::BIGINT AS rank, term, round(score, 6) AS score FROM ranked WHERE rank <= 100""",
    "outlines": rf"""WITH s AS (SELECT doc_id, list_transform({PARAGRAPHS.replace('@chars@', '40')}[1:20], lambda p: {SENTENCE}) AS s FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, list_transform(list_filter(s, lambda x: length(x) > 20 AND NOT regexp_full_match(x, '\p{{Nd}}+')), lambda x: substr(regexp_replace(x, '\s+', ' ', 'g'), 1, 150)) AS c FROM s),
    k AS (SELECT doc_id, c, list_transform(c, lambda x: lower(substr(x, 1, 50))) AS k FROM c)
    SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(k, k[i]) = i)[1:10], '; ') AS outline FROM k""",
    "passages": f"""WITH p AS (SELECT doc_id, {PARAGRAPHS.replace('@chars@', '80')} AS p FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, CASE WHEN len(p) <= 3 THEN p ELSE [p[1], p[len(p) // 2 + 1], p[len(p)]] END AS s FROM p)
    SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS passage FROM s""",
    "hash_vectors": r"""SELECT doc_id, list_transform(range(1024), lambda i: CASE WHEN regexp_matches(name, '[^\s\p{Z}]') THEN ((('0x' || substr(h, 2 * (i % 32)::INTEGER + 1, 2))::INTEGER) - 128) / 128.0::DOUBLE ELSE 0::DOUBLE END) AS vector
      FROM (SELECT doc_id, name, sha256(name) AS h FROM documents WHERE name IS NOT NULL)""",
    "markdown_headings": f"""WITH {NOTES} SELECT object_id, node, level, line, line_end, is_leaf,
      (SELECT max(q.i) FROM h q WHERE q.object_id = h.object_id AND q.text = h.text AND q.i < h.i AND q.level < h.level)::BIGINT AS parent FROM h""",
    "markdown_links": rf"""WITH {NOTES}, m AS (SELECT object_id, n, unnest(regexp_extract_all(line, '\[\[([^\]|\\]+)(?:[\\|]+([^\]]+))?\]\]', 1)) AS t, unnest(regexp_extract_all(line, '\[\[([^\]|\\]+)(?:[\\|]+([^\]]+))?\]\]', 2)) AS a FROM ln)
    SELECT object_id, {STRIP.format('t')} AS target, nullif({STRIP.format('a')}, '') AS alias, n::BIGINT AS line FROM m""",
    "markdown_tags": rf"""SELECT DISTINCT object_id, text, tag FROM (SELECT object_id, level_0 AS text, unnest(regexp_extract_all(regexp_replace(level_0, '([\s\p{{Z}}])', '\1\1', 'g'), '(?:^|[\s\p{{Z}}])#([a-zA-Z][a-zA-Z0-9_/\-]*)', 1)) AS tag FROM (SELECT DISTINCT object_id, level_0 FROM knowledge_store WHERE object_id IS NOT NULL AND level_0 IS NOT NULL))""",
    "markdown_blocks": rf"""WITH {NOTES} SELECT object_id, heading_context, start_line, raw_text FROM (
      SELECT h.object_id, h.node AS heading_context, h.line AS start_line, array_to_string(s.lines[h.line + 1 : h.line_end], chr(10)) AS raw_text
      FROM h JOIN notes s ON s.object_id = h.object_id AND s.text = h.text WHERE is_leaf) WHERE regexp_matches(raw_text, '[^\s\p{{Z}}]')""",
}
ORACLES["file_types"] = f"""SELECT file_path, suffix, CASE WHEN suffix IN {_list(files.BINARY)} THEN 'binary' {" ".join(f"WHEN suffix = '{s}' THEN '{k}'" for s, k in files.TYPES.items())} ELSE 'sniff' END AS kind
  FROM (SELECT DISTINCT file_path, {SUFFIX} AS suffix FROM file_state)"""
ORACLES["ignored_paths"] = f"SELECT DISTINCT file_path FROM file_state WHERE list_has_any(string_split(substr(file_path, 2), '/'), [{', '.join(repr(d) for d in files.IGNORED)}]) OR file_path LIKE '%.min.js' OR contains(file_path, 'archive')"
ORACLES["markdown_tags"] = "SELECT object_id, tag FROM (" + ORACLES["markdown_tags"] + ")"
ORACLES["markdown_front_matter"] = rf"""WITH f AS (SELECT DISTINCT object_id, level_0 AS text, regexp_extract(level_0, '^---[\s]*\n(?s:(.*?))\n---[\s]*\n', 1) AS y FROM knowledge_store WHERE object_id IS NOT NULL AND level_0 IS NOT NULL),
  m AS (SELECT *, regexp_extract(y, 'title: ([^\n]*)', 1) AS title, regexp_extract(y, 'tags: \[([^\n]*)\]', 1) AS tags FROM f),
  g AS (SELECT *, CASE WHEN tags = '' THEN [] ELSE string_split(tags, ', ') END AS listed FROM m)
  SELECT object_id, '{{' || CASE WHEN title = '' THEN '' ELSE '"title":' || to_json(title) END || CASE WHEN y LIKE '%tags:%' THEN ',"tags":' || to_json('[' || array_to_string(list_transform(listed, lambda t: '"' || t || '"'), ', ') || ']') ELSE '' END || '}}' AS metadata,
    array_to_string(list_sort(list_distinct(list_concat(listed, regexp_extract_all(regexp_replace(text, '([\s\p{{Z}}])', '\1\1', 'g'), '(?:^|[\s\p{{Z}}])#([a-zA-Z][a-zA-Z0-9_/\-]*)', 1)))), ',') AS tags FROM g"""
HEAD_LINES = rf"SELECT file_path AS path, list_transform(regexp_split_to_array(head, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {STRIP.format('l')}) AS l FROM source_heads WHERE head IS NOT NULL"
LONG_ENOUGH = f"array_to_string(list_filter(list_transform(c, lambda x: {STRIP.format('x')}), lambda x: length(x) >= {code.MIN_COMMENT}), chr(10)) AS comments"
ORACLES["hash_comments"] = rf"SELECT path, {LONG_ENOUGH} FROM (SELECT path, list_transform(list_filter(l, lambda x: contains(x, '#')), lambda x: CASE WHEN starts_with(x, '#') THEN regexp_replace(x, '^#+', '') ELSE regexp_extract(x, '^[^#]*#(.*)$', 1) END) AS c FROM ({HEAD_LINES}))"
ORACLES["line_comments"] = rf"SELECT path, {LONG_ENOUGH} FROM (SELECT path, list_transform(list_filter(l, lambda x: regexp_matches(x, '^(?://|#|/\*)')), lambda x: CASE WHEN starts_with(x, '/*') THEN regexp_replace(x, '^[/*]+|[*/]+$', '', 'g') ELSE regexp_replace(x, '^[/#]+', '') END) AS c FROM ({HEAD_LINES}))"
ORACLES["summaries"] = rf"""WITH b AS (SELECT doc_id, coalesce(name, '') AS name, text, list_transform(regexp_extract_all(text, '▪\s*(.+?)(?:\n|$)', 1), lambda p: {STRIP.format('p')}) AS bullets,
    regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*[{LETTERS}][A-Za-z0-9_{LETTERS}]*', '0', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b')[1:15] AS nouns,
    regexp_extract_all(text, '(?:is|are|means?|refers?\s+to|defined?\s+as)\s+(.{{20,120}}?)[.\n]', 1)[1:15] AS defined, {PARAGRAPHS.replace('@chars@', '80')} AS p FROM documents WHERE text IS NOT NULL),
  c AS (SELECT *, list_filter(list_transform(list_concat(list_concat(nouns, bullets[1:15]), defined), lambda p: {STRIP.format('p')}), lambda p: length(p) > 5) AS phrases,
    list_filter(bullets, lambda b: length(b) > 10)[1:8] AS points, CASE WHEN len(p) <= 3 THEN p ELSE [p[1], p[len(p) // 2 + 1], p[len(p)]] END AS s FROM b),
  d AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(phrases), lambda p: struct_pack(n := -length(p), p := p)))[1:8], lambda x: x.p) AS longest, list_filter(list_transform(s, lambda p: {SENTENCE}), lambda x: length(x) > 30) AS sentences FROM c)
  SELECT doc_id, CASE WHEN length(text) >= {ab.MIN_CHARS} THEN substr(array_to_string(list_filter(list_concat([name || '.', CASE WHEN len(points) > 0 THEN 'Key topics: ' || array_to_string(points, '; ') WHEN len(longest) > 0 THEN 'Covers: ' || array_to_string(longest, ', ') END],
    list_transform(sentences, lambda x: substr(x, 1, 200))), lambda x: x IS NOT NULL), ' '), 1, 800) ELSE '' END AS summary FROM d"""
