"""Queries of the training-data operators and, where SQL can express one, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lookalike, mixture, multi_index, scan_repair, signature_tree, source_filter, winnow
from tessera.staging import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return source_filter.foreign_sources(table(spark, folder, "file_state"), table(spark, folder, "source_heads")).select("file_path")


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    found = source_filter.foreign_sources(table(spark, folder, "file_state"), table(spark, folder, "source_heads"))
    return found.select("file_path", F.explode("kinds").alias("kind"))


def p1_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What shows each kind of a file: its layout, an opening comment, or its path."""
    found = source_filter.foreign_sources(table(spark, folder, "file_state"), table(spark, folder, "source_heads"))
    return found.select("file_path", F.explode("evidence").alias("e")).select("file_path", "e.kind", F.col("e.by").alias("shown_by"))


def p1_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    return source_filter.handwritten_sources(table(spark, folder, "file_state"), table(spark, folder, "source_heads"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = signature_tree.similar_records(table(spark, folder, "knowledge_store"), "object_id", "level_0", shingle=3, threshold=0.7)
    paths = table(spark, folder, "doc_meta").select("file_path").distinct().select(F.col("file_path").alias("key"), "file_path")
    paths = signature_tree.similar_records(paths, "key", "file_path", shingle=1, threshold=0.8, combo=3)
    return texts.select(F.lit("level_0").alias("field_name"), "*").unionByName(paths.select(F.lit("file_path").alias("field_name"), "*"))


def p2_text_classes(spark: SparkSession, folder: str) -> DataFrame:
    return signature_tree.similar_classes(table(spark, folder, "knowledge_store"), "object_id", "level_0")


def _scans(spark: SparkSession, folder: str) -> scan_repair.Repair:
    notes = scan_repair.records_of(table(spark, folder, "knowledge_store"), "knowledge_store", "object_id", "level_0").distinct()
    return scan_repair.Repair(notes.unionByName(scan_repair.records_of(table(spark, folder, "documents"), "documents", "doc_id", "content")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).defects()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).repaired().select("table_name", "record_key", "repaired")


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = multi_index.usable_vectors(table(spark, folder, "embedding_cache"), "content_hash", "vector", "created_at", 64)
    return multi_index.nearest_vectors(vectors, 64, 5).withColumn("similarity", F.round("similarity", 6))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.mutual_pairs(p5_neighbours(spark, folder)).select(F.col("key_a").alias("hash_a"), F.col("key_b").alias("hash_b"))


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "passage")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n_words").cast("long").alias("n_words"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).select("doc_id", "item_id").distinct()


def p6_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest_span"))


def _sized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    return mixture.sized_records(table(spark, folder, "documents"), targets, "doc_id", "source", "text"), targets


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    records, targets = _sized(spark, folder)
    return mixture.mix(records, targets).withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    records, targets = _sized(spark, folder)
    return mixture.reached_shares(mixture.mix(records, targets), records, targets)


def p7_byte_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by a mixture measured in tokens of a byte-level vocabulary."""
    targets = table(spark, folder, "mix_targets")
    records = mixture.sized_records(table(spark, folder, "documents"), targets, "doc_id", "source", "text", mixture.count_bytes)
    shares = mixture.reached_shares(mixture.mix(records, targets), records, targets)
    return shares.select("source", "target_share", F.round("actual_share", 9).alias("actual_share"), "n_tokens", "n_records")


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, folder, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), F.col("canonical").alias("canonical_text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lookalike.lookalike_pairs(lookalike.canonical_texts(table(spark, folder, "documents"), "doc_id", "text"))
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


QUERIES = {
    "p1_found": p1_found,
    "p1_kinds": p1_kinds,
    "p1_evidence": p1_evidence,
    "p1_handwritten": p1_handwritten,
    "p2_found": p2_found,
    "p2_text_classes": p2_text_classes,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p6_leaked_items": p6_leaked_items,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_byte_shares": p7_byte_shares,
    "p8_found": p8_found,
    "p8_canonical": p8_canonical,
}
# ---- SQL ----------------------------------------------------------------------------------------


def _translated(column: str, letters: bool = True) -> str:
    """The table of ``lookalike.table_form``, with ``letters`` that of ``lookalike.fold``, in SQL: ignorables away, then width forms and letters, then composed."""
    single = {chr(a): b for a, b in lookalike.WIDTH_FORMS.items() if len(b) == 1}
    if letters:
        single |= {chr(a): b for a, b in lookalike.LOOKALIKES.items()}
        # composed letters of other scripts whose base looks like a Latin letter
        single |= {chr(a): b for a in range(0x370, 0x530) if len(b := lookalike.fold(chr(a))) == 1 and b != chr(a)}
    folded = f"regexp_replace({column}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180B}}-\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    for character, several in lookalike.WIDTH_FORMS.items():
        if len(several) > 1 and several.isascii():
            folded = f"replace({folded}, '{chr(character)}', '{several}')"
    # composed first, so that a base letter with a mark is one letter; letters that were not part of one are replaced then
    quoted = lambda x: x.replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({folded}), '{quoted(''.join(single))}', '{quoted(''.join(single.values()))}'))"


def _layout(column: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace({column}, chr(13) || chr(10), chr(10)), '[\t\r\x0b\x0c\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'), ' +(\n|$)', '\1', 'g'), '\n+$', '')"


WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _similar(rows: str, grams: str, threshold: float) -> str:
    """Pairs of keys of ``rows(k, x)`` whose sets of ``grams`` (of the words w) reach the threshold."""
    return f"""(WITH s AS (SELECT k, list_distinct({grams}) AS s FROM (SELECT k, {WORDS.format('x')} AS w FROM ({rows}))),
      t AS (SELECT k, s, len(s) AS n, row_number() OVER () AS i, unnest(s) AS g FROM s),
      p AS (SELECT a.k AS ka, b.k AS kb, a.n + b.n AS total, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k, a.s, b.s, a.n, b.n)
      SELECT DISTINCT ka, kb FROM p WHERE c / (total - c) >= {threshold})"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _limits(statistic: str) -> str:
    k = source_filter.STATISTICS.index(statistic)
    return "CASE ext " + " ".join(f"WHEN '{name}' THEN {limits[k]}" for name, limits in source_filter.LIMITS.items()) + f" ELSE {source_filter.OTHER_LIMITS[k]} END"


def _source_evidence() -> str:
    """Common tables e(file_path, kind, shown_by) and c(file_path), the code files."""
    sf = source_filter
    run = sf.STATISTICS.index("run")
    runs = {n: [e for e, limits in sf.LIMITS.items() if limits[run] == n] for n in {limits[run] for limits in sf.LIMITS.values()} - {sf.OTHER_LIMITS[run]}}
    encoded = "CASE " + " ".join(f"WHEN ext IN {tuple(names)} THEN regexp_matches(head, {_quoted(sf.ENCODED.replace('@', str(n)))})" for n, names in runs.items()) + f" ELSE regexp_matches(head, {_quoted(sf.ENCODED.replace('@', str(sf.OTHER_LIMITS[run])))}) END"
    by_path = {"generated": sf.GENERATED_PATH, "minified": sf.MINIFIED_PATH, "vendored": sf.VENDOR_PATH, "data": sf.DATA_PATH}
    paths = " UNION ALL ".join(f"SELECT file_path, '{kind}', 'path' FROM c WHERE regexp_matches(file_path, {_quoted(pattern)})" for kind, pattern in by_path.items())
    return rf"""c AS (SELECT DISTINCT file_path FROM file_state WHERE file_path IS NOT NULL AND (lower(regexp_replace(file_type, '^\s+|\s+$', '', 'g')) = 'code'
        OR file_type IS NULL AND '.' || lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) IN {tuple(sf.CODE_EXTENSIONS)})),
      h AS (SELECT *, lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) AS ext, greatest(length(head), 1) AS chars, string_split(head, chr(10)) AS lines,
        regexp_replace(array_to_string(regexp_extract_all(head, {_quoted(sf.COMMENT_LINE)}), chr(10)), {_quoted(sf.QUOTED)}, '''''', 'g') AS comments FROM source_heads WHERE file_path IN (SELECT file_path FROM c)),
      s AS (SELECT *, CASE WHEN n_lines > 0 AND n_bytes >= 0 THEN n_bytes / n_lines END >= {_limits('mean_line')} AS long_mean, list_max(list_transform(lines, lambda l: length(l))) >= {_limits('max_line')} AS long_line,
        (length(head) - length(regexp_replace(head, '[\s]+', '', 'g'))) / chars <= {_limits('whitespace')} AS dense, length(regexp_replace(head, '[^\p{{L}}\p{{N}}]+', '', 'g')) / chars >= {_limits('alnum')} AND length(head) >= {sf.ALNUM_CHARS} AS alnum,
        (length(head) - length(regexp_replace(head, {_quoted(sf.NUMBER)}, '', 'g'))) / chars >= {_limits('numeric')} AS numbers, {encoded} AS encoded,
        len(regexp_extract_all(head, {_quoted(sf.LITERAL_LINE)})) / greatest(len(lines) - 2, 1) >= {_limits('literal')} AND n_lines >= {sf.TABLE_LINES} AS literals FROM h),
      v AS (SELECT *, coalesce(encoded, false) OR coalesce(numbers, false) OR coalesce(literals, false) OR coalesce(dense AND alnum, false) AS is_data, coalesce(long_mean, false) OR coalesce(long_line AND dense, false) AS is_long FROM s),
      e(file_path, kind, shown_by) AS (SELECT DISTINCT * FROM ({paths} UNION ALL SELECT file_path, 'data', 'layout' FROM v WHERE is_data UNION ALL SELECT file_path, 'minified', 'layout' FROM v WHERE is_long AND NOT is_data
        UNION ALL SELECT file_path, 'generated', 'comment' FROM v WHERE regexp_matches(comments, {_quoted(sf.GENERATED_HEAD)}) UNION ALL SELECT file_path, 'vendored', 'comment' FROM v WHERE regexp_matches(comments, {_quoted(sf.VENDOR_HEAD)})))"""


NEAREST = """v AS (SELECT content_hash AS h, created_at AS t, TRY_CAST(vector AS DOUBLE[]) AS v FROM embedding_cache WHERE content_hash IS NOT NULL),
      u AS (SELECT h, v, row_number() OVER (PARTITION BY h ORDER BY t DESC) AS r FROM v WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
      k AS (SELECT a.h AS a, b.h AS b, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.h ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.h) AS n FROM u a, u b WHERE a.r = 1 AND b.r = 1 AND a.h <> b.h)"""


def _leaks() -> str:
    """Common table f(doc_id, item_id, n_words): runs of shared words from 13-grams that follow one another on a diagonal."""
    grams = lambda of: f"SELECT {of}, unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda k: array_to_string(w[k:k + 12], ' '))) AS g, unnest(range(1, greatest(len(w) - 11, 1))) AS p"
    return f"""d AS (SELECT doc_id, {WORDS.format(_translated('text'))} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {WORDS.format(_translated('passage'))} AS w FROM eval_items WHERE passage IS NOT NULL),
      h AS (SELECT doc_id, item_id, a.p AS p, a.p - b.p AS diagonal FROM ({grams('doc_id')} FROM d) a JOIN ({grams('item_id')} FROM i) b USING (g)),
      r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run FROM h), n AS (SELECT doc_id, item_id, count(*) + 12 AS n FROM r GROUP BY doc_id, item_id, diagonal, run),
      f AS (SELECT doc_id, item_id, max(n)::BIGINT AS n_words FROM n GROUP BY 1, 2)"""


def _skeleton(column: str) -> str:
    out = f"translate(lower({column}), {_quoted(''.join(scan_repair.CONFUSED))}, {_quoted(''.join(scan_repair.CONFUSED.values()))})"
    for pair, one in scan_repair.CONFUSED_PAIRS:
        out = f"replace({out}, '{pair}', '{one}')"
    return out


def _scans_sql(result: str) -> str:
    """Common tables of the repair of scanned text, and a query of them."""
    sr, q = scan_repair, _quoted
    part = lambda k: f"regexp_extract(squeezed, {q(sr.HEADER)}, {k})"
    unfinished = lambda x: f"(regexp_matches({x}, {q(rf'[\p{{L}}\p{{N}},]\s*$|{sr.BROKEN}')}) AND NOT regexp_matches({x}, {q(sr.MARKUP)}))"
    prose = lambda x: f"(length({x}) >= greatest(2 * length(line), 1) AND regexp_matches({x}, '(?:\\S+\\s+){{7}}\\S'))"
    mask = lambda x: f"upper(regexp_replace(regexp_replace(trim({x}), '\\s+', ' ', 'g'), '\\d+', '#', 'g'))"
    over = "OVER (PARTITION BY rec ORDER BY n)"
    return rf"""WITH rec AS (SELECT row_number() OVER () AS rec, * FROM (SELECT DISTINCT 'knowledge_store' AS table_name, object_id AS record_key, level_0 AS text FROM knowledge_store WHERE level_0 <> '' AND object_id IS NOT NULL
        UNION ALL SELECT 'documents', doc_id::VARCHAR, content FROM documents WHERE content <> '' AND doc_id IS NOT NULL)),
      a1 AS (SELECT rec, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS n FROM (SELECT rec, regexp_split_to_array(text, '\r?\n') AS s FROM rec WHERE contains(text, chr(10)))),
      a2 AS (SELECT *, regexp_matches(line, {q(sr.FENCE)}) AS f FROM a1), a3 AS (SELECT *, f OR (sum(f::INT) {over}) % 2 = 1 AS fenced FROM a2),
      a4 AS (SELECT *, NOT fenced AND regexp_matches(line, {q(sr.PAGE_LINE)}) AS page_like FROM a3),
      a5 AS (SELECT *, CASE WHEN NOT fenced AND NOT page_like AND regexp_matches(line, '^\p{{Lu}}|\s{{2}}\S|[•·|–—:]') THEN regexp_replace(rtrim(line), '\s{{2,}}', '  ', 'g') END AS squeezed,
        page_like AND NOT coalesce(lag(page_like) {over}, false) AND NOT coalesce(lead(page_like) {over}, false) AS page, coalesce(lag(line) {over}, '') AS b1, coalesce(lag(line, 2) {over}, '') AS b2, coalesce(lead(line) {over}, '') AS f1, coalesce(lead(line, 2) {over}, '') AS f2 FROM a4),
      a6 AS (SELECT *, {part(3)} AS t, regexp_split_to_array({part(3)}, '\s+') AS w, coalesce(lag(page) {over}, false) AS page_before, coalesce(lead(page) {over}, false) AS page_after FROM a5),
      a7 AS (SELECT *, CASE WHEN regexp_matches(squeezed, {q(sr.HEADER)}) AND len(w) > 1 AND regexp_matches(w[-1], {q(f'^{sr.WORD_UP}$')}) AND list_bool_and(list_transform(w, lambda x: regexp_matches(x, {q(sr.TITLE_WORD)}))) THEN t END AS header,
        regexp_matches(f1, '^[\p{{Ll}}\p{{N}}]') AS goes_on FROM a6),
      a8 AS (SELECT *, header IS NOT NULL AND n > 0 AND (page_before OR page_after OR {part(1)} || {part(2)} || {part(4)} || {part(5)} <> '' OR goes_on AND {unfinished('b1')}) AS sure,
        CASE WHEN fenced THEN 'fence' WHEN page THEN 'page' WHEN header IS NOT NULL THEN 'title' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind, page OR header IS NOT NULL AND {part(1)} || {part(5)} <> '' AS has_page FROM a7),
      a9 AS (SELECT *, kind = 'text' AND NOT page_like AND NOT regexp_matches(line, {q(rf'[.!?;,:]\s*$|{sr.MARKUP}')}) AND regexp_matches(line, '\p{{L}}') AS plain FROM a8),
      j AS (SELECT *, plain AND (trim(b1) = '' AND trim(f1) = '' AND {unfinished('b2')} AND trim(f2) <> '' OR page_before AND {prose('f1')} OR page_after AND {prose('b1')} OR {prose('b1')} AND {prose('f1')} AND goes_on AND {unfinished('b1')}) AS apart, {mask('coalesce(header, line)')} AS mask FROM a9),
      known AS (SELECT mask, 'title' AS of FROM j WHERE kind = 'title' GROUP BY 1 HAVING bool_or(sure) OR count(*) >= {sr.HEADER_LINES}
        UNION ALL SELECT mask, 'text' FROM j WHERE plain GROUP BY 1 HAVING count(DISTINCT rec) FILTER (WHERE apart) >= {sr.HEADER_LINES} AND 2 * count(*) FILTER (WHERE apart) > count(*)),
      l AS (SELECT rec, n, line, has_page, CASE WHEN kind = 'title' AND (sure OR k.mask IS NOT NULL AND n > 0) THEN 'header' WHEN kind = 'title' THEN 'text' WHEN kind = 'text' AND apart AND n > 0 AND k.mask IS NOT NULL THEN 'header' ELSE kind END AS kind
        FROM j LEFT JOIN known k ON k.mask = j.mask AND k.of = j.kind),
      c1 AS (SELECT *, sum((kind = 'blank')::INT) {over} AS blanks, sum((kind IN ('header', 'page'))::INT) {over} AS furniture FROM l), c2 AS (SELECT * FROM c1 WHERE kind IN ('text', 'fence')),
      c3 AS (SELECT *, kind = 'text' AND NOT regexp_matches(line, '^\s*[#>|]') AND coalesce(lead(kind) {over} = 'text', false) AND regexp_matches(line, {q(sr.BROKEN)}) AND coalesce(regexp_matches(lead(line) {over}, '^\s*\p{{Ll}}'), false) AS broken,
        blanks > coalesce(lag(blanks) {over}, 0) AS apart, furniture > coalesce(lag(furniture) {over}, 0) AS page_end, coalesce(lag(line) {over}, '') AS previous, lag(kind) {over} AS kind_before, row_number() {over} AS nth FROM c2),
      c4 AS (SELECT *, coalesce(lag(broken) {over}, false) AS after_break, page_end AND NOT regexp_matches(previous, '[.!?:;]\s*$') AND regexp_matches(line, '^\s*[\p{{Ll}}\p{{N}}]') AS runs_on,
        kind = 'fence' OR coalesce(kind_before = 'fence', false) OR regexp_matches(line, {q(sr.MARKUP)}) AS stays FROM c3),
      c5 AS (SELECT rec, n, broken, kind, CASE WHEN nth = 1 OR after_break THEN '' WHEN apart AND NOT runs_on THEN chr(10) || chr(10) WHEN stays THEN chr(10) ELSE ' ' END AS gap,
        CASE WHEN broken THEN regexp_replace(rtrim(line), {q(f'[{sr.MARKS}]$')}, '') WHEN kind = 'fence' THEN line WHEN stays THEN rtrim(line) ELSE trim(rtrim(line)) END AS piece FROM c4),
      flat AS (SELECT rec, string_agg(gap || CASE WHEN kind = 'text' THEN piece ELSE '' END, '' ORDER BY n) AS text, string_agg(gap || piece, '' ORDER BY n) AS flow, bool_or(broken) AS hyphenation FROM c5 GROUP BY 1),
      x AS (SELECT rec, regexp_extract_all(lower(text), {q(sr.TOKEN)}) AS w FROM (SELECT rec, text FROM flat UNION ALL SELECT rec, text FROM rec WHERE NOT contains(text, chr(10)))),
      y AS (SELECT rec, w[i] AS word, coalesce(CASE WHEN i > 1 THEN w[i - 1] END, '') AS before, coalesce(w[i + 1], '') AS after FROM (SELECT rec, w, unnest(range(1, len(w) + 1)) AS i FROM x)),
      p AS (SELECT word, before, count(*) AS n FROM y GROUP BY 1, 2), forms AS (SELECT word, sum(n) AS n, {_skeleton('word')} AS skeleton FROM p GROUP BY 1),
      s AS (SELECT a.word, b.word AS reading, b.n AS often FROM forms a JOIN forms b ON a.skeleton = b.skeleton AND a.word <> b.word WHERE b.n >= {sr.FREQUENT} AND regexp_full_match(b.word, '\p{{L}}+') AND b.n >= {sr.RATIO} * a.n),
      ctx AS (SELECT word AS reading, 0 AS side, {_skeleton('before')} AS c, sum(n) AS n FROM p WHERE word IN (SELECT reading FROM s) GROUP BY ALL UNION ALL SELECT before, 1, {_skeleton('word')}, sum(n) FROM p WHERE before IN (SELECT reading FROM s) GROUP BY ALL),
      o AS (SELECT rec, word, reading, often, {_skeleton('before')} AS b, {_skeleton('after')} AS a FROM (SELECT DISTINCT * FROM y) JOIN s USING (word)),
      v AS (SELECT rec, word, o.reading, often, b, a, sum(n) AS support FROM o JOIN ctx ON ctx.reading = o.reading AND (side = 0 AND c = b OR side = 1 AND c = a) GROUP BY ALL),
      m AS (SELECT rec, word, (max(struct_pack(support := support, often := often, reading := reading))).reading AS reading FROM v GROUP BY 1, 2) {result}"""


SCAN_DEFECTS = """, d AS (SELECT rec, 'hyphenation' AS defect FROM flat WHERE hyphenation UNION SELECT rec, 'misread' FROM m UNION SELECT rec, 'running_header' FROM l WHERE kind = 'header'
        UNION SELECT rec, 'page_number' FROM l WHERE kind = 'page' OR kind = 'header' AND has_page)
      SELECT DISTINCT table_name, record_key, defect FROM rec JOIN d USING (rec)"""
SCAN_TEXTS = f""", b AS (SELECT r.*, CASE WHEN coalesce(hyphenation, false) OR rec IN (SELECT rec FROM l WHERE kind IN ('header', 'page')) OR rec IN (SELECT rec FROM m) AND flow IS NOT NULL THEN flow ELSE r.text END AS base FROM rec r LEFT JOIN (SELECT rec, flow, hyphenation FROM flat) USING (rec)),
      w AS (SELECT rec, regexp_extract_all(base, {_quoted(scan_repair.TOKEN)}) AS w, regexp_split_to_array(base, {_quoted(scan_repair.TOKEN)}) AS g FROM b WHERE rec IN (SELECT rec FROM m)),
      t AS (SELECT rec, w[i] AS w, g[i] AS g, i FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM w)),
      f AS (SELECT t.rec, string_agg(g || coalesce(CASE WHEN m.reading IS NULL THEN t.w WHEN substr(t.w, 1, 1) <> lower(substr(t.w, 1, 1)) THEN upper(substr(m.reading, 1, 1)) || substr(m.reading, 2) ELSE m.reading END, ''), '' ORDER BY i) AS fixed FROM t LEFT JOIN m ON m.rec = t.rec AND m.word = lower(t.w) GROUP BY 1)
      SELECT table_name, record_key, coalesce(fixed, base) AS repaired FROM b LEFT JOIN f USING (rec)"""


ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_source_evidence()} SELECT DISTINCT file_path FROM e",
    "p1_kinds": f"WITH {_source_evidence()} SELECT DISTINCT file_path, kind FROM e",
    "p1_evidence": f"WITH {_source_evidence()} SELECT * FROM e",
    "p1_handwritten": f"WITH {_source_evidence()} SELECT file_path FROM c WHERE file_path NOT IN (SELECT file_path FROM e)",
    "p3_found": _scans_sql(SCAN_DEFECTS),
    "p3_repaired": _scans_sql(SCAN_TEXTS),
    "p2_found": f"""SELECT 'level_0' AS field_name, ka AS key_a, kb AS key_b FROM {_similar("SELECT DISTINCT object_id AS k, level_0 AS x FROM knowledge_store WHERE object_id IS NOT NULL AND level_0 IS NOT NULL", "list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])", 0.7)}
      UNION ALL SELECT 'file_path', ka, kb FROM {_similar("SELECT DISTINCT file_path AS k, file_path AS x FROM doc_meta WHERE file_path IS NOT NULL", "w", 0.8)}""",
    "p2_text_classes": f"""WITH t AS (SELECT DISTINCT object_id AS key, level_0 AS x, array_to_string({WORDS.format('level_0')}, ' ') AS words FROM knowledge_store WHERE object_id IS NOT NULL AND level_0 IS NOT NULL),
      m AS (SELECT DISTINCT key, sha256(CASE WHEN words = '' THEN x ELSE words END) AS class, words FROM t WHERE words <> '' OR regexp_matches(x, '[^\\s\\p{{Z}}]')),
      p AS {_similar("SELECT DISTINCT class AS k, words AS x FROM m", "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])", 0.8)},
      l AS (SELECT class, count(*) AS n FROM (SELECT ka AS class FROM p UNION ALL SELECT kb FROM p) GROUP BY 1) SELECT key, class, coalesce(n, 0)::BIGINT AS n_links FROM (SELECT DISTINCT key, class FROM m) LEFT JOIN l USING (class)""",
    # exact here, as all vectors of a small table are visited
    "p5_found": f"WITH {NEAREST} SELECT DISTINCT least(a, b) AS hash_a, greatest(a, b) AS hash_b FROM k WHERE n <= 5",
    "p5_neighbours": f"WITH {NEAREST} SELECT a AS key, b AS other, round(s, 6) AS similarity, n AS rank FROM k WHERE n <= 5",
    "p6_found": f"WITH {_leaks()} SELECT doc_id, item_id FROM f",
    "p6_leaks": f"WITH {_leaks()} SELECT * FROM f",
    "p6_leaked_items": f"WITH {_leaks()} SELECT item_id, count(*) AS n_documents, max(n_words) AS longest_span FROM f GROUP BY 1",
    # sources in the order in which they run out of repeats: the first that does not decides the rate of the rest
    "p7_byte_shares": r"""WITH d AS (SELECT regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g') AS source, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
      t AS (SELECT m.source, target_share AS w, max_repeats AS r, coalesce(sum(n), 0)::BIGINT AS n, count(n) AS n_records FROM mix_targets m LEFT JOIN d ON d.source = m.source GROUP BY ALL),
      o AS (SELECT *, n * r AS room, sum(n) OVER () AS whole, row_number() OVER (ORDER BY n * r / w, source) AS k FROM t WHERE w > 0 AND n * r > 0),
      p AS (SELECT *, (whole - coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM o),
      f AS (SELECT min(k) AS k, first(rate ORDER BY k) AS rate FROM p WHERE room > w * rate),
      b AS (SELECT source, CASE WHEN f.k IS NULL OR p.k < f.k THEN room ELSE round(w * f.rate)::BIGINT END AS n_tokens FROM p, f)
      SELECT t.source, w AS target_share, round(coalesce(n_tokens, 0) / sum(coalesce(n_tokens, 0)) OVER (), 9) AS actual_share, coalesce(n_tokens, 0)::BIGINT AS n_tokens, n_records FROM t LEFT JOIN b USING (source)""",
    "p8_found": f"""WITH c AS (SELECT doc_id, text, {_layout(_translated('text'))} AS x FROM documents WHERE text IS NOT NULL)
      SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.x = b.x AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_canonical": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_layout('text')}, '[^ \n]+|[ \n]+') AS parts FROM documents WHERE text IS NOT NULL),
      t AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM d), w AS (SELECT p, count(*) AS n FROM t GROUP BY 1),
      s AS (SELECT {_translated('p')} AS f, {_translated('p', letters=False)} AS s, sum(n) AS n FROM w GROUP BY 1, 2),
      b AS (SELECT f, first(s ORDER BY regexp_matches(s, '\p{{Latin}}')::INT + regexp_matches(s, '\p{{Greek}}')::INT + regexp_matches(s, '\p{{Cyrillic}}')::INT > 1, s <> f, n DESC, s) AS s FROM s GROUP BY 1),
      m AS (SELECT p, b.s FROM w JOIN b ON b.f = {_translated('p')}),
      j AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS x FROM t JOIN m USING (p) GROUP BY 1) SELECT doc_id, coalesce({_layout("x")}, '') AS canonical_text FROM d LEFT JOIN j USING (doc_id)""",
}
