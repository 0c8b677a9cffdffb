"""Structure of markdown texts: front matter, links, tags, headings, leaf blocks. Built-ins but for YAML.

The heading tree is a flat array in document order: level, line, end of the section, and the position of
the parent; a heading is a leaf if the next one is not deeper. ``#`` lines inside fences count as headings.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from tessera.functions.text import SPACE_CLASS, let, lines_of, strip_spaces

# Front matter, wiki links and inline tags.
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
WIKILINK = r"\[\[([^\]|\\]+)(?:[\\|]+([^\]]+))?\]\]"
TAG = rf"(?:^|[{SPACE_CLASS}])#([a-zA-Z][a-zA-Z0-9_/\-]*)"


@F.pandas_udf(MapType(StringType(), StringType()))
def yaml_map(texts: pd.Series) -> pd.Series:
    """YAML mappings as strings: a string stays, anything else is JSON; what is no mapping gives an empty map."""
    import yaml

    def one(text):
        try:
            value = yaml.safe_load(text) if text else None
        except yaml.YAMLError:
            value = None
        return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in value.items() if v is not None} if isinstance(value, dict) else {}

    return texts.map(one)


def front_matter(text: Column) -> Column:
    return yaml_map(F.regexp_extract(text, FRONT_MATTER, 1))


def metadata_list(metadata: Column, name: str) -> Column:
    """A front-matter value that is a list, as strings; anything else is an empty list."""
    value = F.try_element_at(metadata, F.lit(name))
    return F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")), F.array().cast("array<string>"))


def inline_tags(text: Column) -> Column:
    # consecutive tags share the blank between them, so blanks are doubled first
    return F.regexp_extract_all(F.regexp_replace(text, rf"([{SPACE_CLASS}])", "$1$1"), F.lit(TAG), F.lit(1))


def tags_of(text: Column, metadata: Column | None = None) -> Column:
    """Distinct tags in alphabetical order, from the text and from the front matter's list."""
    found = inline_tags(text)
    return F.sort_array(F.array_distinct(F.concat(found, metadata_list(metadata, "tags")) if metadata is not None else found))


def links_of(lines: Column) -> Column:
    """Wiki links as (target, alias, line), in order; an alias that is not there is null."""
    one = lambda line, i: F.transform(
        F.arrays_zip(F.regexp_extract_all(line, F.lit(WIKILINK), F.lit(1)).alias("t"), F.regexp_extract_all(line, F.lit(WIKILINK), F.lit(2)).alias("a")),
        lambda m: F.struct(strip_spaces(m["t"]).alias("target"), F.nullif(strip_spaces(m["a"]), F.lit("")).alias("alias"), (i + 1).alias("line")),
    )
    return F.flatten(F.transform(lines, one))


def headings_of(lines: Column) -> Column:
    """Headings as (node, level, line, line_end, is_leaf, parent), in order; ``parent`` is a position from 0, or null."""
    marks = F.transform(lines, lambda s, i: F.struct(F.length(F.regexp_extract(s, "^#+", 0)).alias("level"), strip_spaces(F.regexp_replace(s, "^#+", "")).alias("title"), (i + 1).alias("line")))
    return let(F.filter(marks, lambda h: (h["level"] > 0) & (h["title"] != "")), lambda found: let(F.size(lines), lambda n: _nested(found, n)))


def _nested(found: Column, n_lines: Column) -> Column:
    following = lambda i: F.get(found, i + 1)
    return F.transform(
        found,
        lambda h, i: F.struct(
            F.concat(F.lit("H"), h["level"].cast("string"), F.lit(": "), h["title"]).alias("node"),
            h["level"].alias("level"),
            h["line"].alias("line"),
            F.coalesce(following(i)["line"] - 1, n_lines).alias("line_end"),
            (F.coalesce(following(i)["level"], F.lit(0)) <= h["level"]).alias("is_leaf"),
            F.array_max(F.filter(F.transform(F.slice(found, 1, i), lambda p, k: F.when(p["level"] < h["level"], k)), lambda k: k.isNotNull())).alias("parent"),
        ),
    )


def blocks_of(lines: Column, headings: Column) -> Column:
    """Texts under leaf headings as (heading_context, start_line, end_line, raw_text); blank ones are left out."""
    return let(lines, lambda found: _leaf_blocks(found, F.filter(headings, lambda h: h["is_leaf"])))


def _leaf_blocks(lines: Column, leaves: Column) -> Column:
    one = lambda h: F.struct(h["node"].alias("heading_context"), h["line"].alias("start_line"), h["line_end"].alias("end_line"), F.array_join(F.slice(lines, h["line"] + 1, h["line_end"] - h["line"]), "\n").alias("raw_text"))
    return F.filter(F.transform(leaves, one), lambda b: b["raw_text"].rlike(rf"[^{SPACE_CLASS}]"))


def outline_of(headings: Column) -> Column:
    return F.array_join(F.transform(headings, lambda h: h["node"]), "; ")


def parse_markdown(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` and metadata, headings, links, tags and blocks of its text."""
    parsed = df.withColumn("metadata", front_matter(F.col(text))).withColumn("_lines", lines_of(F.col(text)))
    parsed = parsed.withColumn("headings", headings_of(F.col("_lines"))).withColumns({"links": links_of(F.col("_lines")), "tags": tags_of(F.col(text), F.col("metadata"))})
    return parsed.withColumn("blocks", blocks_of(F.col("_lines"), F.col("headings"))).drop("_lines")
