"""PDF files as pages of text lines with their font sizes. The reader is an optional package and runs in
the workers; without it every file is an empty parse with an error, as the tests cover."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUT = "path string, error string, outline array<struct<level:int,title:string,page:int>>, lines array<struct<page:int,text:string,font_size:double,font_name:string,bbox:array<double>>>"
#: A line is a heading if its font is larger than the most usual one by this factor.
HEADING = 1.15


def _layout(content: bytes) -> tuple[str | None, list, list]:
    try:
        import fitz
    except ImportError:
        return "PDF reader not installed", [], []
    try:
        with fitz.open(stream=content, filetype="pdf") as document:
            outline = [{"level": level, "title": title, "page": page} for level, title, page in document.get_toc()]
            lines = []
            for number, page in enumerate(document, 1):
                for block in page.get_text("dict", flags=fitz.TEXT_PRESERVE_WHITESPACE)["blocks"]:
                    for line in block.get("lines", []) if block.get("type") == 0 else []:
                        text = "".join(span["text"] for span in line.get("spans", []))
                        if text.strip():
                            lines.append({"page": number, "text": text, "font_size": float(line["spans"][0]["size"]), "font_name": line["spans"][0]["font"], "bbox": [float(x) for x in block["bbox"]]})
            return None, outline, lines
    except Exception as broken:  # a damaged file is an error row, not a failed job
        return str(broken), [], []


def read_layout(files: DataFrame) -> DataFrame:
    """(path, error, outline, lines) of ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *_layout(content)) for path, content in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "error", "outline", "lines"])

    return files.select("path", "content").mapInPandas(run, LAYOUT)


def headings(layouts: DataFrame) -> DataFrame:
    """(path, pos, page, text, font_size) of lines larger than the body size: the most usual size, the first seen of equally usual ones."""
    lines = layouts.select("path", F.posexplode("lines").alias("pos", "line")).select("path", "pos", "line.*")
    sizes = lines.groupBy("path", "font_size").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    body = sizes.groupBy("path").agg(F.max_by("font_size", F.struct("n", -F.col("first"))).alias("body_size"))
    return lines.join(body, "path").where(F.col("font_size") > F.col("body_size") * HEADING).select("path", "pos", "page", F.trim("text").alias("text"), "font_size")


def pages(layouts: DataFrame) -> DataFrame:
    """(path, text, outline_text): all pages' text, and the headings or else the bookmarks as one line."""
    of_page = F.transform(F.sequence(F.lit(1), F.coalesce(F.array_max(F.transform("lines", lambda x: x["page"])), F.lit(1))), lambda p: F.array_join(F.transform(F.filter("lines", lambda x: x["page"] == p), lambda x: x["text"]), "\n"))
    found = headings(layouts).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda h: h["text"]), "; ").alias("headed"))
    marks = F.array_join(F.transform("outline", lambda o: o["title"]), "; ")
    return layouts.join(found, "path", "left").select("path", "error", F.array_join(of_page, "\n\n").alias("text"), F.coalesce(F.nullif("headed", F.lit("")), marks).alias("outline_text"))
