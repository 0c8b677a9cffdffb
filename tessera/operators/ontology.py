"""The ontology and the checks against it. Every check gives (batch, object_id, rule, message).

A batch is the group of objects that are checked together (for ingested files, the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.staging import stage

# Class, depth, parent.
CLASSES = [
    ("KnowledgeObject", None, None), ("Concept", None, "KnowledgeObject"), ("Implementation", None, "KnowledgeObject"), ("Reference", None, "KnowledgeObject"),
    ("Algorithm", 3, "Concept"), ("DataStructure", 3, "Concept"), ("ArchitecturePattern", 2, "Concept"), ("MathematicalTheory", 2, "Concept"),
    ("Domain", 0, "Concept"), ("SubDomain", 1, "Concept"),
]
BASES = ["Concept", "Implementation", "Reference"]
# What a predicate may join (base types of source and target).
PREDICATES = {
    "is_a": (["Concept", "Implementation", "Reference"], ["Concept"]),
    "part_of": (["Concept"], ["Concept"]),
    "depends_on": (["Concept", "Implementation"], ["Concept", "Implementation"]),
    "example_of": (["Implementation"], ["Concept"]),
    "extends": (["Concept", "Implementation"], ["Concept", "Implementation"]),
    "uses": (["Concept", "Implementation"], ["Concept", "Implementation"]),
    "optimized_by": (["Concept"], ["Concept"]),
}
# The wording of the messages, by rule.
MESSAGES = {
    "invalid_class": "Class '%s' is not in the ontology taxonomy",
    "invalid_predicate": "Predicate '%s' is not allowed",
    "type_mismatch": "Predicate '%s' invalid between '%s' and '%s'",
    "cycle_detected": "Circular taxonomy chain detected involving '%s'",
    "orphan_implementation": "Implementation node has no link to a parent concept",
}
HIERARCHY, CONCEPT_LINKS = ["is_a", "part_of"], ["example_of", "is_a", "part_of"]


def class_table(spark: SparkSession) -> DataFrame:
    """(class, depth, parent, base) of the ten classes."""
    parents = {name: parent for name, _, parent in CLASSES}

    def base(name: str | None) -> str | None:
        while name and name not in BASES:
            name = parents.get(name)
        return name

    return spark.createDataFrame([(n, d, p, base(n)) for n, d, p in CLASSES], "class string, depth int, parent string, base string")


def predicate_table(spark: SparkSession) -> DataFrame:
    """(predicate, source_base, target_base), one row per allowed combination."""
    return spark.createDataFrame([(p, s, t) for p, (sources, targets) in PREDICATES.items() for s in sources for t in targets], "predicate string, source_base string, target_base string")


def _base(column: Column) -> Column:
    """The base type of a class; an unknown class stands for itself."""
    found = column
    for name, _, parent in CLASSES:
        if parent == "Concept":
            found = F.when(column == name, F.lit("Concept")).otherwise(found)
    return found


def invalid_classes(objects: DataFrame) -> DataFrame:
    """Objects ``(batch, id, ontology_class)`` with a class that is set and not in the taxonomy."""
    bad = objects.where((F.coalesce("ontology_class", F.lit("")) != "") & ~F.col("ontology_class").isin([c[0] for c in CLASSES]))
    return bad.select("batch", F.col("id").alias("object_id"), F.lit("invalid_class").alias("rule"), F.format_string(MESSAGES["invalid_class"], "ontology_class").alias("message"))


def invalid_predicates(links: DataFrame) -> DataFrame:
    """Links ``(batch, source_id, target_id, predicate)`` with a predicate that is not allowed."""
    bad = links.where(~F.coalesce(F.col("predicate").isin(list(PREDICATES)), F.lit(False)))
    return bad.select("batch", F.col("source_id").alias("object_id"), F.lit("invalid_predicate").alias("rule"), F.format_string(MESSAGES["invalid_predicate"], F.coalesce("predicate", F.lit(""))).alias("message"))


def type_mismatches(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links between two objects of a batch, both with a class, that the predicate may not join."""
    classed = objects.where("coalesce(ontology_class, '') <> ''").select("batch", "id", "ontology_class")
    source = classed.select("batch", F.col("id").alias("source_id"), F.col("ontology_class").alias("source_class"))
    target = classed.select("batch", F.col("id").alias("target_id"), F.col("ontology_class").alias("target_class"))
    both = links.where(F.col("predicate").isin(list(PREDICATES))).join(source, ["batch", "source_id"]).join(target, ["batch", "target_id"])
    allowed = F.lit(False)
    for p, (sources, targets) in PREDICATES.items():
        allowed = allowed | ((F.col("predicate") == p) & _base(F.col("source_class")).isin(sources) & _base(F.col("target_class")).isin(targets))
    message = F.format_string(MESSAGES["type_mismatch"], "predicate", "source_class", "target_class")
    return both.where(~allowed).select("batch", F.col("source_id").alias("object_id"), F.lit("type_mismatch").alias("rule"), message.alias("message"))


def cycles(links: DataFrame) -> DataFrame:
    """Objects on a circle of hierarchy links: those in a strongly connected component of several, and those linked to themselves.

    First nodes without a predecessor or a successor among the remaining ones are cut off until none is left to
    cut, which shrinks a hierarchy by a level a round. What remains lies on circles or between them. There every node
    takes the smallest label that reaches it and the smallest that it reaches; links between nodes whose two labels
    differ are on no circle and go, and the rest is trimmed and labelled again, until the labels show that every
    node reaches the smallest of its part and is reached by it. No step holds more than a row per link and node.
    """
    edges = links.where(F.col("predicate").isin(HIERARCHY)).select("batch", F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a is not null and b is not null")
    empty = links.select("batch", F.col("source_id").alias("object_id"), F.lit("").alias("rule"), F.lit("").alias("message")).limit(0)
    if edges.isEmpty():
        return empty
    edges = stage(edges.distinct(), "hierarchy")
    found = stage(edges.where("a = b").select("batch", F.col("a").alias("id")), "self-links")
    edges = _trimmed(edges.where("a <> b"))
    while not edges.isEmpty():
        labels = _labels(edges)
        ends = lambda end: labels.select("batch", F.col("id").alias(end), F.struct("down", "up").alias(f"label_{end}"))
        inner = edges.join(ends("a"), ["batch", "a"]).join(ends("b"), ["batch", "b"]).where("label_a = label_b")
        # nodes whose two labels are the same reach that node and are reached by it: a component, or a node alone between circles
        settled = labels.where("down = up").select("batch", "id", "down")
        several = settled.groupBy("batch", "down").count().where("count > 1").select("batch", "down")
        found = found.unionByName(settled.join(several, ["batch", "down"], "left_semi").select("batch", "id"))
        rest = inner.join(settled.select("batch", F.col("id").alias("a")), ["batch", "a"], "left_anti").select("batch", "a", "b")
        edges = _trimmed(rest)
    found = found.distinct().withColumnRenamed("id", "object_id")
    return found.select("batch", "object_id", F.lit("cycle_detected").alias("rule"), F.format_string(MESSAGES["cycle_detected"], "object_id").alias("message"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The links (batch, a, b) whose two ends have both a predecessor and a successor among what is left, staged."""
    edges = stage(edges, "core")
    n = edges.count()
    while n:
        inner = edges.join(edges.select("batch", F.col("b").alias("a")).distinct(), ["batch", "a"], "left_semi")
        edges = stage(inner.join(inner.select("batch", F.col("a").alias("b")).distinct(), ["batch", "b"], "left_semi").select("batch", "a", "b"), "core")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _labels(edges: DataFrame) -> DataFrame:
    """(batch, id, down, up): the smallest node that reaches each node, and the smallest that it reaches, itself included."""
    nodes = edges.select("batch", F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = stage(nodes.select("batch", "id", F.col("id").alias("down"), F.col("id").alias("up")), "labels")
    while True:
        start = labels.select("batch", F.col("id").alias("a"), F.col("down").alias("first"))
        end = labels.select("batch", F.col("id").alias("b"), F.col("up").alias("last"))
        down = edges.join(start, ["batch", "a"]).groupBy("batch", F.col("b").alias("id")).agg(F.min("first").alias("first"))
        up = edges.join(end, ["batch", "b"]).groupBy("batch", F.col("a").alias("id")).agg(F.min("last").alias("last"))
        joined = labels.join(down, ["batch", "id"], "left").join(up, ["batch", "id"], "left")
        moved = (F.coalesce("first", "down") < F.col("down")) | (F.coalesce("last", "up") < F.col("up"))
        labels = stage(joined.select("batch", "id", F.least("down", F.coalesce("first", "down")).alias("down"), F.least("up", F.coalesce("last", "up")).alias("up"), moved.alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.drop("moved")


def orphans(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Implementations ``(batch, id, type, level_0, level_2)`` without text and without a link to a concept of the batch."""
    empty = objects.where("type = 'implementation' and coalesce(level_0, '') = '' and coalesce(level_2, '') = ''")
    concepts = objects.where("type = 'concept'").select("batch", F.col("id").alias("target_id")).distinct()
    linked = links.where(F.col("predicate").isin(CONCEPT_LINKS)).join(concepts, ["batch", "target_id"], "left_semi").select("batch", F.col("source_id").alias("id")).distinct()
    bad = empty.join(linked, ["batch", "id"], "left_anti")
    return bad.select("batch", F.col("id").alias("object_id"), F.lit("orphan_implementation").alias("rule"), F.lit(MESSAGES["orphan_implementation"]).alias("message"))


def validate(objects: DataFrame, links: DataFrame) -> DataFrame:
    """The errors of all checks."""
    errors = invalid_classes(objects).unionByName(invalid_predicates(links)).unionByName(type_mismatches(links, objects))
    return errors.unionByName(cycles(links)).unionByName(orphans(objects, links))
