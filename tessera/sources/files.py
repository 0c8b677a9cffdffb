"""Files as rows: listing, ignoring, classifying, hashing, reading."""

from __future__ import annotations

import fnmatch
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import decoded, file_name, file_suffix
from tessera.sources.store import Files

# Types by extension, extensions that are never read, directories that are never entered.
TYPES = {
    ".md": "markdown", ".pdf": "pdf", ".py": "code", ".js": "code", ".ts": "code", ".jsx": "code", ".tsx": "code", ".go": "code", ".rs": "code",
    ".java": "code", ".c": "code", ".h": "code", ".cpp": "code", ".cc": "code", ".cxx": "code", ".hpp": "code", ".cs": "code", ".rb": "code",
    ".sh": "code", ".bash": "code",
}
BINARY = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".flac", ".ogg",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz", ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".woff", ".woff2", ".ttf",
    ".otf", ".eot", ".db", ".sqlite", ".sqlite3", ".class", ".jar", ".war", ".pyc", ".pyo", ".wasm",
]
IGNORED = [".git", ".obsidian", "blueprint", "data", "docker", "scripts", "tests", "node_modules", "__pycache__", "build", "dist", "venv", ".venv", "env"]
#: Bytes that are looked at to tell text from binary.
SNIFF = 8192


def ignore_patterns(path: str | Path | None) -> list[str]:
    """The patterns of an ignore file: stripped lines that are neither empty nor comments."""
    if not path or not Path(path).exists():
        return []
    return [line.strip() for line in Path(path).read_text().splitlines() if line.strip() and not line.strip().startswith("#")]


def is_ignored(relative: Column, patterns: list[str] | None = None) -> Column:
    """A path with an ignored part, or that a shell pattern matches as a whole or by its name (``*`` crosses ``/``)."""
    ignored = F.arrays_overlap(F.split(relative, "/"), F.array(*[F.lit(d) for d in IGNORED]))
    for pattern in patterns or []:
        regex = fnmatch.translate(pattern).replace(r"\z", r"\Z")
        ignored = ignored | relative.rlike(regex) | file_name(relative).rlike(regex)
    return ignored


def looks_like_text(content: Column) -> Column:
    """Not empty, no zero byte and valid UTF-8 within the first bytes (a character that is cut there counts as invalid)."""
    head = F.substring(content, 1, SNIFF)
    return (F.length(head) > 0) & ~F.hex(head).rlike("^(?:..)*?00") & F.is_valid_utf8(head.cast("string"))


def type_by_name(path: Column) -> Column:
    """The type that the extension alone tells, ``binary``, or null."""
    suffix = file_suffix(path)
    known = F.when(suffix.isin(BINARY), F.lit("binary"))
    for kind in sorted(set(TYPES.values())):
        known = known.when(suffix.isin([s for s, k in TYPES.items() if k == kind]), F.lit(kind))
    return known


def classify(path: Column, content: Column) -> Column:
    """The type of a file, or null if it is not to be read."""
    return F.coalesce(F.nullif(type_by_name(path), F.lit("binary")), F.when(type_by_name(path).isNull() & looks_like_text(content), F.lit("text")))


def kept_roots(spark: SparkSession, root: str, patterns: list[str] | None = None) -> list[str]:
    """What is to be listed below ``root``: whole folders without an ignored one in them, and single files beside ignored ones.

    Folders are walked here by name; an ignored one is neither entered nor listed by the reader afterwards.
    """
    files = Files(spark, root)
    ignored = {d for d in IGNORED}
    matchers = [re.compile(fnmatch.translate(p)) for p in patterns or []]

    def dropped(relative: str) -> bool:
        name = relative.rsplit("/", 1)[-1]
        return name in ignored or any(m.match(relative) or m.match(name) for m in matchers)

    def walk(relative: str) -> tuple[bool, list[str]]:
        folders, plain = files.children(relative)
        below = lambda names: [f"{relative}/{n}" if relative else n for n in names if not n.startswith((".", "_"))]
        kept = [f for f in below(folders) if not dropped(f)]
        walked = [walk(f) for f in kept]
        if len(kept) == len(below(folders)) and all(whole for whole, _ in walked):
            return True, [relative]
        return False, [f for f in below(plain) if not dropped(f)] + [place for _, places in walked for place in places]

    return walk("")[1]


def _escaped(path: str) -> str:
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


FILE = "path string, relative string, content binary, sha256 string, last_modified long, file_type string"


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, max_file_bytes: int | None = None, only: list[str] | None = None) -> DataFrame:
    """(path, relative, content, sha256, last_modified, file_type) of the files below ``root`` that are to be read.

    Ignored folders are neither listed nor read. Contents are read where the hash is computed; columns that are not used
    are not kept. ``only`` names the paths that are wanted, so that no other file is read. The source lists no empty
    files, so a file that was emptied counts as deleted.
    """
    base = root.rstrip("/")
    places = [f"{base}/{p}" if p else base for p in kept_roots(spark, base, patterns)] if only is None else only
    if not places:
        return spark.createDataFrame([], FILE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([_escaped(p) for p in places])
    if max_file_bytes is not None:
        files = files.where(F.col("length") <= max_file_bytes)
    path = F.regexp_replace("path", r"^file:/+", "/")
    files = files.withColumn("path", path).withColumn("relative", F.substring("path", F.lit(len(base) + 2), F.length("path")))
    files = files.where(~is_ignored(F.col("relative"), patterns)).withColumn("file_type", classify(F.col("path"), F.col("content"))).where("file_type is not null")
    return files.select("path", "relative", "content", F.sha2("content", 256).alias("sha256"), F.unix_timestamp("modificationTime").alias("last_modified"), "file_type")


def texts(files: DataFrame) -> DataFrame:
    """Scanned files with ``text`` in place of ``content``."""
    return files.withColumn("text", decoded(F.col("content"))).drop("content")


def lookup(objects: DataFrame, key: str) -> DataFrame:
    """One object by id."""
    return objects.where(F.col("object_id") == key)


def lookup_many(objects: DataFrame, keys: list[str]) -> DataFrame:
    """The objects of a list of ids; null levels come out empty."""
    wanted = objects.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "object_id string")
    found = objects.join(F.broadcast(wanted), "object_id", "left_semi")  # as long as the caller's list
    return found.select(*[F.coalesce(c, F.lit("")).alias(c) if c.startswith("level_") else F.col(c) for c in objects.columns])
