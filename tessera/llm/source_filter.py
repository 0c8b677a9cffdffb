"""Generated, minified, vendored and data-only source files.

What a head is made of decides first: layout statistics (maximum and mean line length, whitespace and
alphanumeric share, density of numeric literals, long encoded runs, lines that are literals), each
with a limit per language in ``LIMITS``. They tell minified code and data whatever a file is called.
A generated file or a copy of somebody's hand-written file is laid out like any other, so these show
by their path (directory and file names that tools and package managers use) and by the opening
comment lines alone. ``classify_sources`` says for every kind which evidence there is. Everything is
built-in expressions; the heads are judged where they are read, so that only verdicts are shuffled.

Defined results: a null head leaves the path and the counts as evidence; null or zero counts give no
mean line length; one row per path, however many states it has; a file is named with every kind that
the evidence shows, in a fixed order; null paths are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The extensions that make a file of unknown type a code file.
CODE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".cs", ".rb", ".sh", ".bash"]

# Directories whose whole content comes from elsewhere.
VENDOR_DIRS = ["vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "external", "externals", "pods", "carthage", "godeps"]
# Directories that tools write into.
GENERATED_DIRS = ["generated", "__generated__", "generated-sources", "generated_sources", "generated-src", "gen", "autogen", "__pycache__"]

VENDOR_PATH = r"(?i)/(?:" + "|".join(d.replace("-", r"\-") for d in VENDOR_DIRS) + r")/|/deps/[^/]*[a-z][^/]*-v?\d+(?:\.\d+)+/"
GENERATED_PATH = (
    r"(?i)/(?:" + "|".join(d.replace("-", r"\-") for d in GENERATED_DIRS) + r")/[^/]"
    r"|_pb2(?:_grpc)?\.pyi?$|\.pb(?:\.gw)?\.[a-z]+$|_pb\.(?:js|ts|rb)$|\.designer\.(?:cs|vb)$|\.g(?:\.i)?\.(?:cs|dart)$"
    r"|\.(?:gen|generated|graphql|autogen)\.[a-z]+$|[_-](?:generated|autogen)\.[a-z]+$|/zz_generated[._][^/]*$|/moc_[^/]*\.(?:cpp|cc|cxx)$|/qrc_[^/]*\.(?:cpp|cc|cxx)$"
    r"|\.tab\.[ch](?:c|pp|xx)?$|/lex\.yy\.[a-z]+$|\.yy\.[a-z]+$"
)
MINIFIED_PATH = r"(?i)[.-]min(?:\.m?js)*\.(?:m?js|cjs|jsx|ts|css)$|\.(?:bundle|packed|chunk)\.(?:m?js|cjs|ts)$|\.[0-9a-f]{8,40}\.(?:[^/]*\.)?(?:m?js|cjs)$"
DATA_PATH = r"(?i)_(?:blob|font_data|base64|bindata)\.[a-z]+$|_rc\.py$|\.data\.(?:m?js|ts|py)$|/(?:fixtures|testdata)/[^/]*_dump\.[a-z]+$"

#: A phrase counts only in a comment line of the head, and not inside quotation marks.
COMMENT_LINE = r"(?m)^[ \t]*(?://+!?|#+|/\*+|\*+|--|;+|<!--|\"\"\"|''')[^\n]*"
GENERATED_HEAD = (
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b.{0,40}\b(?:by|from|with|file|compiler|code)\b|^\W*autogenerated\b"
    r"|\b(?:automatically|machine)[ -](?:generated|made|produced|written)\b|\bgenerated (?:by|from|with|using)\b.{0,80}\b(?:do not|don't|never)\b"
    r"|\b(?:do not|don't) (?:edit|modify|change)\b|\bmanual changes? (?:will|may) be (?:lost|overwritten)|\bany (?:edit|change)s? (?:is|are|will be) (?:overwritten|lost)"
    r"|\bedit the (?:schema|template|source|grammar|proto)[a-z]* instead|\berzeugt (?:mit|von|durch|aus)\b|\bnicht von hand (?:bearbeiten|ändern|editieren)"
    r"|\bne pas (?:modifier|éditer|editer)|\bgénéré (?:par|automatiquement)|\b(?:generado|creado) (?:por|automáticamente)\b.{0,60}\bno (?:editar|modificar)|\bno (?:editar|modificar)\b"
)
VENDOR_HEAD = (
    r"(?i)\bnot our code\b|\bimported unchanged from\b|\bbundled copy of\b|\b(?:copied|taken|vendored|borrowed) (?:verbatim |unchanged )?from\b.{0,60}\d+\.\d+"
    r"|\bthird[- ]party\b.{0,40}\b(?:local changes|unmodified|unchanged|copy|code)\b|\bin (?:step|sync) with upstream\b|\bthis file is part of the \S+ (?:distribution|library|package|project)\b"
    r"|\bv?\d+\.\d+\.\d+\W+\(c\)|\(c\) the \S+ (?:authors|contributors|project)\b|\breport (?:problems|bugs|issues) to\b|\bsend patches to\b"
)
QUOTED = r"'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`"
NUMBER = r"\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b[,;\]\[\s]*"
ENCODED = r"[A-Za-z0-9+/]{@,}={0,2}|(?:\\x[0-9a-fA-F]{2}){25,}"
LITERAL_LINE = r"(?m)^[ \t]*(?:'[^'\n]*'|\"[^\"\n]*\")[ \t]*,?[ \t]*$"

#: The limits lie between hand-written heads and those of files that paths or comments call minified or data, in a sample of
#: 65,000 heads (the bound; the table of check_l): there no hand-written file has lines over 48 bytes on average, and no hand-written
#: head a share of numbers of 0.10, a run of 65 characters or a line of literals, and none but Python's a line of 145 characters.
STATISTICS = ["mean_line", "max_line", "whitespace", "alnum", "numeric", "run", "literal"]
#: Per language: mean bytes a line of the file, longest line of a dense head, the whitespace share that makes a head dense, alphanumeric
#: share of a dense head, share of numeric literals, characters of an encoded run, share of literal lines in a long file.
LIMITS = {
    "js": (160, 250, 0.13, 0.86, 0.35, 90, 0.85), "mjs": (160, 250, 0.13, 0.86, 0.35, 90, 0.85), "jsx": (170, 250, 0.13, 0.86, 0.35, 90, 0.85),
    "ts": (170, 250, 0.13, 0.86, 0.35, 90, 0.85), "tsx": (170, 250, 0.13, 0.86, 0.35, 90, 0.85), "py": (130, 260, 0.10, 0.85, 0.40, 90, 0.85),
    "rb": (130, 260, 0.10, 0.85, 0.40, 90, 0.85), "sh": (150, 300, 0.08, 0.85, 0.35, 100, 0.90), "bash": (150, 300, 0.08, 0.85, 0.35, 100, 0.90),
    "go": (140, 280, 0.10, 0.86, 0.45, 100, 0.90), "rs": (140, 280, 0.10, 0.85, 0.45, 100, 0.90), "java": (150, 300, 0.10, 0.85, 0.45, 100, 0.90),
    "cs": (150, 300, 0.10, 0.85, 0.45, 100, 0.90), "c": (140, 280, 0.10, 0.85, 0.50, 96, 0.85), "h": (140, 280, 0.10, 0.85, 0.50, 96, 0.85),
}
OTHER_LIMITS = (150, 280, 0.10, 0.85, 0.50, 100, 0.85)
#: Least characters of a head whose alphanumeric share counts, least lines of a file that is a table of literals.
ALNUM_CHARS, TABLE_LINES = 100, 60
KINDS = ["generated", "minified", "vendored", "data"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def code_paths(file_state: DataFrame) -> DataFrame:
    """Distinct paths of code files, by recorded type or, where that is null, by extension."""
    kind = F.lower(F.regexp_replace("file_type", r"^\s+|\s+$", ""))
    by_name = F.col("file_type").isNull() & F.concat(F.lit("."), extension(F.col("file_path"))).isin(CODE_EXTENSIONS)
    return file_state.where(F.col("file_path").isNotNull() & ((kind == "code") | by_name)).select("file_path").distinct()


def _limit(ext: Column, statistic: str) -> Column:
    k = STATISTICS.index(statistic)
    chosen = F.lit(float(OTHER_LIMITS[k]))
    for name, limits in LIMITS.items():
        chosen = F.when(ext == name, F.lit(float(limits[k]))).otherwise(chosen)
    return chosen


def _encoded(head: Column, ext: Column) -> Column:
    """Whether there is a run of the language's length; one pattern per length, so that each is compiled once."""
    k = STATISTICS.index("run")
    pattern = lambda n: head.rlike(ENCODED.replace("@", str(n)))
    found = pattern(OTHER_LIMITS[k])
    for n in sorted({limits[k] for limits in LIMITS.values()} - {OTHER_LIMITS[k]}):
        found = F.when(ext.isin([name for name, limits in LIMITS.items() if limits[k] == n]), pattern(n)).otherwise(found)
    return found


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def layout_statistics(heads: DataFrame) -> DataFrame:
    """The layout figures of each head that the limits are applied to; null where there is no head."""
    head, ext = F.col("head"), extension(F.col("file_path"))
    chars = F.length(head)
    squeezed = F.length(F.regexp_replace(head, r"\s+", ""))
    return heads.select(
        "*",
        ext.alias("ext"),
        F.when((F.col("n_lines") > 0) & (F.col("n_bytes") >= 0), F.col("n_bytes") / F.col("n_lines")).alias("mean_line"),
        F.array_max(F.transform(F.split(head, "\n"), lambda line: F.length(line))).alias("max_line"),
        _share(chars - squeezed, chars).alias("whitespace"),
        _share(F.length(F.regexp_replace(head, r"[^\p{L}\p{N}]+", "")), chars).alias("alnum"),
        _share(chars - F.length(F.regexp_replace(head, NUMBER, "")), chars).alias("numeric"),
        _share(F.lit(1.0) * F.regexp_count(head, F.lit(LITERAL_LINE)), F.lit(1.0) * F.greatest(F.size(F.split(head, "\n")) - 2, F.lit(1))).alias("literal"),
        _encoded(head, ext).alias("encoded"),
    )


def judge_layout(heads: DataFrame) -> DataFrame:
    """``layout_statistics`` with the two verdicts ``l_data`` and ``l_minified`` that they allow."""
    limit = {name: _limit(F.col("ext"), name) for name in STATISTICS}
    over = lambda name: F.col(name) >= limit[name]
    dense = F.col("whitespace") <= limit["whitespace"]
    data = {
        "encoded run": F.col("encoded"),
        "numbers": over("numeric"),
        "table of literals": over("literal") & (F.col("n_lines") >= TABLE_LINES),
        "no blanks": dense & over("alnum") & (F.length("head") >= ALNUM_CHARS),
    }
    is_data = F.lit(False)
    for shown in data.values():
        is_data = is_data | F.coalesce(shown, F.lit(False))
    long = F.coalesce(over("mean_line"), F.lit(False)) | F.coalesce(over("max_line") & dense, F.lit(False))
    return layout_statistics(heads).withColumn("l_data", is_data).withColumn("l_minified", long & ~is_data)


def judge_heads(heads: DataFrame) -> DataFrame:
    """(file_path, two verdicts by layout, two by comment) of each head, without its text."""
    comments = F.regexp_replace(F.array_join(F.regexp_extract_all(F.col("head"), F.lit(COMMENT_LINE), F.lit(0)), "\n"), QUOTED, "''")
    says = lambda pattern: F.coalesce(comments.rlike(pattern), F.lit(False))
    return judge_layout(heads).select("file_path", "l_minified", "l_data", says(GENERATED_HEAD).alias("c_generated"), says(VENDOR_HEAD).alias("c_vendored"))


def classify_sources(file_state: DataFrame, source_heads: DataFrame) -> DataFrame:
    """(file_path, kinds, evidence) of every code file; ``kinds`` is empty for hand-written source.

    ``evidence`` has (kind, by) with by = layout, comment or path, in this order.
    """
    heads = judge_heads(source_heads.where("file_path is not null").select("file_path", "n_lines", "n_bytes", "head"))
    flags = [c for c in heads.columns if c != "file_path"]
    heads = heads.groupBy("file_path").agg(*[F.bool_or(c).alias(c) for c in flags])
    by_path = {"generated": GENERATED_PATH, "minified": MINIFIED_PATH, "vendored": VENDOR_PATH, "data": DATA_PATH}
    by_head = {"minified": ("layout", "l_minified"), "data": ("layout", "l_data"), "generated": ("comment", "c_generated"), "vendored": ("comment", "c_vendored")}
    shown = []
    for kind in KINDS:
        by, flag = by_head[kind]
        shown += [F.when(F.col(flag), F.struct(F.lit(kind).alias("kind"), F.lit(by).alias("by"))), F.when(F.col("file_path").rlike(by_path[kind]), F.struct(F.lit(kind).alias("kind"), F.lit("path").alias("by")))]
    rows = code_paths(file_state).join(heads, "file_path", "left").select("file_path", F.array_compact(F.array(*shown)).alias("evidence"))
    return rows.select("file_path", F.array_distinct(F.transform("evidence", lambda e: e["kind"])).alias("kinds"), "evidence")


def foreign_sources(file_state: DataFrame, source_heads: DataFrame) -> DataFrame:
    return classify_sources(file_state, source_heads).where(F.size("kinds") > 0)


def handwritten_sources(file_state: DataFrame, source_heads: DataFrame) -> DataFrame:
    return classify_sources(file_state, source_heads).where(F.size("kinds") == 0).select("file_path")
