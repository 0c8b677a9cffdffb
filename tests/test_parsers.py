from types import SimpleNamespace

from pyspark.sql import functions as F

from tessera.functions.text import lines_of
from tessera.operators import code, markdown
from tessera.sources import pdf


def parsed(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    return markdown.parse_markdown(frame).first()


def test_tags(spark):
    assert parsed(spark, "#a #b\n#c ##d x#e (#f")["tags"] == ["a", "b", "c"]


def test_links(spark):
    found = parsed(spark, "[[A|b]] [[C\\d]]\n[[E#h]] [[ x ]]")["links"]
    assert [(x["target"], x["alias"], x["line"]) for x in found] == [("A", "b", 1), ("C", "d", 1), ("E#h", None, 2), ("x", None, 2)]


def test_headings(spark):
    row = parsed(spark, "# T\nintro\n## A\naa\n## B\nbb")
    assert [h["node"] for h in row["headings"]] == ["H1: T", "H2: A", "H2: B"]
    assert [h["parent"] for h in row["headings"]] == [None, 0, 0]
    assert [b["raw_text"] for b in row["blocks"]] == ["aa", "bb"]
    deep = spark.createDataFrame([("# A\n### B\n## C\n# D\n#\nx",)], "text string").select(F.explode(markdown.headings_of(lines_of(F.col("text")))).alias("h")).select("h.*").collect()
    assert [(h["node"], h["level"], h["line"], h["line_end"], h["is_leaf"], h["parent"]) for h in deep] == [("H1: A", 1, 1, 1, False, None), ("H3: B", 3, 2, 2, True, 0), ("H2: C", 2, 3, 3, True, 0), ("H1: D", 1, 4, 6, True, None)]


def test_front_matter(spark):
    row = parsed(spark, "---\ntitle: X\ntags: [p, q]\nn: 3\n---\nbody #z")
    assert row["metadata"]["title"] == "X" and row["tags"] == ["p", "q", "z"] and row["metadata"]["n"] == "3"
    assert parsed(spark, "---\n: [\n---\nx")["metadata"] == {} and parsed(spark, "")["metadata"] == {}


SOURCE = '''"""Module."""
import os.path as p
from . import sibling
from a.b import c

# a comment
class Thing(base.Base, make()):
    """Doc."""
    @wraps(x)
    def run(self, a, b=1):
        import late
        return "no # comment"

async def go(x) -> list[int] | None:
    pass
'''


def test_python(spark):
    row = code.parse_code(spark.createDataFrame([("/x/m.py", SOURCE), ("/x/bad.py", "def (\n# kept comment"), ("/x/a.js", "// hello there\n/* one line */\nx # no\n")], "path string, text string")).collect()
    good, bad, script = row
    assert good["parser_source"] == "python_ast"
    assert [i["module"] for i in good["imports"]] == ["os.path", ".sibling", "a.b.c", "late"]
    thing = good["classes"][0]
    assert (thing["name"], thing["bases"], thing["methods"][0]["args"], thing["methods"][0]["decorators"]) == ("Thing", ["base.Base", "make"], ["a", "b"], ["wraps"])
    assert [(f["name"], f["args"], f["returns"]) for f in good["functions"]] == [("go", ["x"], "list[int] | None")]
    assert good["docstrings"] == ["Module.", "Doc."] and good["comments"] == ["a comment", 'comment"']
    assert bad["parser_source"] == "generic_code" and bad["comments"] == ["kept comment"]
    assert script["comments"] == ["hello there", "one line"]


class Node(SimpleNamespace):
    """A stand-in for a grammar's node: kind, text span and children."""


def node(kind, source, text, *children):
    start = source.index(text)
    return Node(type=kind, start_byte=start, end_byte=start + len(text), children=list(children), parent=None, start_point=SimpleNamespace(row=source[:start].count("\n")), end_point=SimpleNamespace(row=source[: start + len(text)].count("\n")))


def test_grammar_bundle():
    s = 'import x from "mod"\nclass A extends B { run(p) {} }\nfunction f(q) {}\n// remark here\n'
    run = node("method_definition", s, "run(p) {}", node("property_identifier", s, "run"), node("formal_parameters", s, "(p)", node("identifier", s, "p)")))
    run.children[1].children[0].end_byte -= 1
    heritage = node("class_heritage", s, "extends B", node("identifier", s, "B {"))
    heritage.children[0].end_byte -= 2
    cls = node("class_declaration", s, "class A extends B { run(p) {} }", node("identifier", s, "A extends"), heritage, node("class_body", s, "{ run(p) {} }", run))
    cls.children[0].end_byte -= 8
    fun = node("function_declaration", s, "function f(q) {}", node("identifier", s, "f(q)"), node("formal_parameters", s, "(q)"))
    fun.children[0].end_byte -= 3
    imp = node("import_statement", s, 'import x from "mod"', node("string", s, '"mod"'))
    root = node("program", s, s, imp, cls, fun, node("comment", s, "// remark here"))
    bundle = code.SyntaxTable(root, s.encode(), ".js").bundle()
    assert bundle["imports"] == [{"module": "mod", "alias": None, "line": 1}]
    assert bundle["classes"][0]["name"] == "A" and bundle["classes"][0]["bases"] == ["B"] and bundle["classes"][0]["methods"][0]["args"] == ["p"]
    assert [f["name"] for f in bundle["functions"]] == ["f"] and bundle["comments"] == ["remark here"]


def tree(source, shape, at=0):
    """A stand-in tree from nested [kind, text, children...], each text found after the one before it."""
    kind, text, *children = shape
    start = source.index(text, at)
    made = Node(type=kind, start_byte=start, end_byte=start + len(text), children=[], parent=None, start_point=SimpleNamespace(row=source[:start].count("\n")), end_point=SimpleNamespace(row=source[: start + len(text)].count("\n")))
    for child in children:
        made.children.append(tree(source, child, start))
        start = made.children[-1].start_byte + (len(child[1]) - 1 if len(child) == 2 else 0)
    return made


def test_grammar_of_go():
    s = 'import (\n "fmt"\n "net/http"\n)\nfunc (r *T) Serve(w W, q *Q) {}\n'
    specs = [["import_spec", '"fmt"', ["interpreted_string_literal", '"fmt"']], ["import_spec", '"net/http"', ["interpreted_string_literal", '"net/http"']]]
    imports = ["import_declaration", s[: s.index(")") + 1], ["import_spec_list", s[7 : s.index(")") + 1], *specs]]
    method = ["method_declaration", "func (r *T) Serve(w W, q *Q) {}", ["parameter_list", "(r *T)"], ["field_identifier", "Serve"], ["parameter_list", "(w W, q *Q)", ["parameter_declaration", "w W", ["identifier", "w"]], ["parameter_declaration", "q *Q", ["identifier", "q"]]]]
    bundle = code.SyntaxTable(tree(s, ["source_file", s, imports, method]), s.encode(), ".go").bundle()
    assert bundle["imports"] == [{"module": "fmt", "alias": None, "line": 2}, {"module": "net/http", "alias": None, "line": 3}]
    assert [(f["name"], f["args"], f["line_bounds"], f["returns"]) for f in bundle["functions"]] == [("Serve", ["w", "q"], [5, 5], None)]


def test_grammar_of_scripts_and_modules():
    s = "use a::b::c;\nconst go = (x: int, this) => x;\nfunction f(y = 1): Result<T> {}\n/* one\n * two words\n */\n"
    arrow = ["arrow_function", "(x: int, this) => x", ["formal_parameters", "(x: int, this)", ["required_parameter", "x: int"], ["required_parameter", "this"]]]
    shape = [
        "program", s, ["use_declaration", "use a::b::c;", ["scoped_identifier", "a::b::c"]], ["lexical_declaration", "const go = (x: int, this) => x;", ["variable_declarator", "go = (x: int, this) => x", ["identifier", "go"], arrow]],
        ["function_declaration", "function f(y = 1): Result<T> {}", ["identifier", "f("], ["formal_parameters", "(y = 1)", ["optional_parameter", "y = 1"]], ["type_annotation", ": Result<T>"]], ["comment", "/* one\n * two words\n */"],
    ]
    root = tree(s, shape)
    root.children[2].children[0].end_byte -= 1
    bundle = code.SyntaxTable(root, s.encode(), ".ts").bundle()
    assert [i["module"] for i in bundle["imports"]] == ["a.b.c"] and bundle["comments"] == ["two words"]
    assert [(f["name"], f["args"], f["returns"]) for f in bundle["functions"]] == [("f", ["y"], "Result<T>"), ("go", ["x"], None)]
    for text, module in (("import x from 'y'", "y"), ("use thing;", "thing"), ("#include <stdio.h>", "<stdio.h>"), (" ;", "")):
        assert code.SyntaxTable(tree(text, ["import_statement", text]), text.encode(), ".c").module(0) == module


def test_written_expressions():
    show = lambda text, kind: code.shown(code.ast.parse(text, mode="eval").body, kind)
    assert [show(t, code.NAMES) for t in ("a.b.c", "make(1).x", "f()", "a")] == ["a.b.c", "make.x", "f", "a"] and show("a[0]", code.NAMES).startswith("Subscript(")
    assert [show(t, code.ANNOTATIONS) for t in ("dict[str, int]", "a.b | None", "'x'", "a, b", "...")] == ["dict[str, int]", "a.b | None", "'x'", "a, b", "Ellipsis"]
    assert show("x[[int], y]", code.ANNOTATIONS).startswith("x[List(elts=") and show("a + b", code.ANNOTATIONS).startswith("BinOp(")


def test_comments(spark, rows):
    frame = spark.createDataFrame([("  ## two marks\nx = 1  # behind it\ny '# no'\n#no\n//  slashes\n/* a block */\n/**\n",), ("",)], "text string")
    found = rows(frame.select(code.hash_comments(F.col("text")).alias("h"), code.line_comments(F.col("text")).alias("l")))
    assert found == [(["two marks", "behind it"], ["two marks", "slashes", "a block"]), ([], [])]


def test_pdf_headings(spark):
    lines = [(1, "body", 10.0, "f", []), (1, "Title", 12.0, "f", []), (2, "more", 10.0, "f", []), (2, "text", 10.0, "f", [])]
    layouts = spark.createDataFrame([("/a.pdf", None, [(1, "Mark", 1)], lines)], pdf.LAYOUT)
    assert [r["text"] for r in pdf.headings(layouts).collect()] == ["Title"]
    assert tuple(pdf.pages(layouts).first())[2:] == ("body\nTitle\n\nmore\ntext", "Title")


def test_pdf_without_reader(spark):
    import importlib.util

    files = spark.createDataFrame([("/a.pdf", bytearray(b"%PDF-"))], "path string, content binary")
    row = pdf.read_layout(files).first()
    assert row["error"] and row["lines"] == []
    if importlib.util.find_spec("fitz") is None:
        assert row["error"] == "PDF reader not installed"
