"""Parsed files to knowledge objects: id, kind, name, domain, four levels of text, links and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import abstractions as ab
from tessera.functions.text import SPACE_CLASS, domain_of, domain_of_name, file_name, file_stem, slug
from tessera.operators.code import parse_code
from tessera.operators.markdown import outline_of, parse_markdown
from tessera.sources import pdf
from tessera.sources.files import texts

LINKS = "array<struct<target:string,predicate:string>>"
OBJECT = (
    "id string, type string, name string, domain string, source_file string, level_0 string, level_1 string, level_2 string, level_3 string, "
    "ontology_class string, ontology_depth int, relationships array<struct<target:string,predicate:string>>, tags array<string>, metadata map<string,string>, seq long"
)
COLUMNS = [part.strip().split(" ")[0] for part in OBJECT.replace("array<struct<target:string,predicate:string>>", "x").replace("map<string,string>", "x").split(",")]


def concept_id(name: Column) -> Column:
    return F.concat(F.lit("concept_"), slug(name))


def _links(targets: Column, predicate: str) -> Column:
    return F.transform(targets, lambda t: F.struct(concept_id(t).alias("target"), F.lit(predicate).alias("predicate"))).cast(LINKS)


def _object(kind: str, ontology_class: str, depth: int | None, **values: Column) -> list[Column]:
    none = F.array().cast(LINKS)
    defaults = {"domain": F.lit(""), "level_0": F.lit(""), "level_1": F.lit(""), "level_2": F.lit(""), "level_3": F.lit(""), "relationships": none, "tags": F.array().cast("array<string>"), "metadata": F.create_map().cast("map<string,string>")}
    fixed = {"type": F.lit(kind), "ontology_class": F.lit(ontology_class), "ontology_depth": F.lit(depth).cast("int"), "source_file": F.col("path"), "seq": F.col("seq")}
    return [(defaults | fixed | values)[c].alias(c) for c in COLUMNS]


def _with_keywords(df: DataFrame, text: str) -> DataFrame:
    """``level_3`` of every row (its path is unique); texts without keywords get an empty one."""
    found = ab.keywords_of_text(df.select("path", text), "path", text).withColumnRenamed("key", "path")
    return df.join(found, "path", "left").withColumn("level_3", F.coalesce("keywords", F.lit(""))).drop("keywords")


def _file_node(df: DataFrame, name: Column, depth: int | None) -> DataFrame:
    link = F.array(F.struct(concept_id(name).alias("target"), F.lit("example_of").alias("predicate"))).cast(LINKS)
    return df.select(*_object("implementation", "Implementation", depth, id=F.col("path"), name=file_name(F.col("path")), relationships=link))


def compile_markdown(files: DataFrame) -> DataFrame:
    """A concept (named by its title or file) and a file node for each of ``files(path, text, seq)``."""
    parsed = parse_markdown(files)
    body = F.array_join(F.transform("blocks", lambda b: b["raw_text"]), "\n\n")
    name = F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("title")), F.lit("")), file_stem(F.col("path")))
    rows = parsed.withColumns({"level_0": F.when(body.rlike(rf"[^{SPACE_CLASS}]"), body).otherwise(F.col("text")), "name": name})
    rows = _with_keywords(rows, "level_0")
    headed = outline_of(F.col("headings"))
    concept = rows.select(
        *_object(
            "concept", "Concept", 3,
            id=concept_id(F.col("name")), name=F.col("name"), domain=domain_of(F.col("tags"), F.col("name")), level_0=F.col("level_0"),
            level_1=F.when(headed != "", headed).otherwise(ab.outline_of_text(F.col("level_0"))), level_2=ab.summary_of_text(F.col("name"), F.col("level_0")), level_3=F.col("level_3"),
            relationships=_links(F.transform("links", lambda x: x["target"]), "uses"), tags=F.col("tags"), metadata=F.col("metadata"),
        )
    )
    return concept.unionByName(_file_node(rows, F.col("name"), 4))


def compile_code(files: DataFrame) -> DataFrame:
    """One implementation for each of ``files(path, text, seq)``; imports become dependencies."""
    rows = parse_code(files)
    prose = F.concat("docstrings", "comments")
    level_2 = F.when(F.size(prose) > 0, F.substring(F.array_join(prose, " "), 1, 800)).otherwise(ab.identifiers_as_prose(F.col("classes"), F.col("functions"), F.col("imports")))
    modules = F.transform("imports", lambda i: F.regexp_extract(i["module"], r"([^.]*)$", 1))
    stem = file_stem(F.col("path"))
    return rows.select(
        *_object(
            "implementation", "Implementation", 4,
            id=concept_id(stem), name=file_name(F.col("path")), domain=domain_of_name(stem), level_0=F.col("text"), level_1=ab.code_outline(F.col("classes"), F.col("functions")),
            level_2=level_2, level_3=ab.code_keywords(*[F.col(c) for c in ("classes", "functions", "imports", "docstrings", "comments")]), relationships=_links(modules, "depends_on"),
        )
    )


def compile_text(files: DataFrame) -> DataFrame:
    """One concept for each of ``files(path, text, seq)``: named by the file, with the id of its stem."""
    name, stem = file_name(F.col("path")), file_stem(F.col("path"))
    rows = _with_keywords(files, "text")
    values = {"level_0": F.col("text"), "level_1": ab.outline_of_text(F.col("text")), "level_2": ab.summary_of_text(name, F.col("text")), "level_3": F.col("level_3")}
    return rows.select(*_object("concept", "Concept", 3, id=concept_id(stem), name=name, domain=domain_of_name(stem), **values))


def compile_pdf(files: DataFrame) -> DataFrame:
    """A reference and a file node for each of ``files(path, content, seq)``; a reference has no summary and no domain."""
    rows = files.select("path", "seq").join(pdf.pages(pdf.read_layout(files)), "path")
    rows = _with_keywords(rows, "text")
    stem = file_stem(F.col("path"))
    reference = rows.select(*_object("reference", "Concept", 3, id=concept_id(stem), name=stem, level_0=F.col("text"), level_1=F.col("outline_text"), level_3=F.col("level_3")))
    return reference.unionByName(_file_node(rows, stem, None))


def compile_files(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Objects of scanned ``files(path, content, file_type, seq)``; other types have none. ``kinds``: the types that occur, if they are known."""
    of = lambda kind: files.where(F.col("file_type") == kind)
    compilers = {"markdown": lambda: compile_markdown(texts(of("markdown"))), "code": lambda: compile_code(texts(of("code"))), "text": lambda: compile_text(texts(of("text"))), "pdf": lambda: compile_pdf(of("pdf"))}
    parts = [make() for kind, make in compilers.items() if kinds is None or kind in kinds]
    return reduce(DataFrame.unionByName, parts) if parts else files.sparkSession.createDataFrame([], OBJECT)


def object_json(objects: DataFrame) -> DataFrame:
    """(id, json) of each object, without its metadata."""
    levels = F.struct(*[F.col(f"level_{k}") for k in range(4)]).alias("abstractions")
    ontology = F.struct(F.col("ontology_class").alias("class"), F.col("ontology_depth").alias("depth")).alias("ontology")
    return objects.select("id", F.to_json(F.struct("id", "type", "name", "domain", "source_file", levels, ontology, "relationships", "tags")).alias("json"))


def links_of_objects(objects: DataFrame) -> DataFrame:
    """(batch, source_id, target_id, predicate) of the objects' relationships; the batch is the file."""
    return objects.select(F.col("source_file").alias("batch"), F.col("id").alias("source_id"), F.explode("relationships").alias("r")).select("batch", "source_id", F.col("r.target").alias("target_id"), "r.predicate")
