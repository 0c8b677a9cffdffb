import pytest
from pyspark.sql import functions as F

from tessera.llm import source_filter as sf

STATE = "file_path string, file_type string, status string"
HEAD = "file_path string, n_lines long, n_bytes long, head string"
PLAIN = "def run(a):\n    return a + 1\n"


def judged(spark, items):
    """{path: kinds} of (path, head, n_lines, n_bytes) items, in one go; counts that are left out come from the head."""
    state = spark.createDataFrame([(path, "code", "ACTIVE") for path, *_ in items], STATE)
    counted = [(path, *(counts or (len((head or "").split("\n")), len(head or ""))), head) for path, head, *counts in items]
    return {r["file_path"]: r["kinds"] for r in sf.classify_sources(state, spark.createDataFrame(counted, HEAD)).collect()}


PATHS = [
        ("/code/a/src/run.py", []), ("/code/a/vendor/x/run.go", ["vendored"]), ("/code/a/Vendor/x/run.go", ["vendored"]), ("/code/a/src/vendor_portal/run.py", []),
        ("/code/a/deps/zlib-1.2.3/x.c", ["vendored"]), ("/code/a/deps/tools/x.c", []), ("/code/a/node_modules/b/index.js", ["vendored"]), ("/code/a/stats/dist/run.py", []),
        ("/code/a/proto/run_pb2_grpc.py", ["generated"]), ("/code/a/protobuf_tools/run_check.py", []), ("/code/a/zz_generated_x.go", ["generated"]), ("/code/a/tools/generated_report/x.py", []),
        ("/code/a/gen/X.java", ["generated"]), ("/code/a/src/generator/x.ts", []), ("/code/a/web/app.min.js", ["minified"]), ("/code/a/web/app-min.js", ["minified"]), ("/code/a/minify/app.js", []),
        ("/code/a/dist/x.93701bca.js", ["minified"]), ("/code/a/build/static/main.226362dc.foo.js", ["minified"]), ("/code/a/res/x_blob.h", ["data"]), ("/code/a/blob_store/x.py", []),
        ("/code/a/fixtures/x_dump.py", ["data"]), ("/code/a/ui/Main.Designer.cs", ["generated"]), ("/code/a/external_users/x.java", []),
    ]


@pytest.mark.parametrize("counts", [(PLAIN, 3, 28), (None, None, None)])
def test_paths(spark, counts):
    head, *numbers = counts
    assert judged(spark, [(path, head, *numbers) for path, _ in PATHS]) == dict(PATHS)


HEADS = [
        ("// Code generated by mockgen. DO NOT EDIT.\npackage x\n", ["generated"]), ("# @generated by tool\nx = 1\n", ["generated"]), ("#!/bin/sh\n# Erzeugt mit werkzeug. Bitte nicht von Hand bearbeiten.\n", ["generated"]),
        ("// Writes the line 'DO NOT EDIT' on top of every file that it emits.\npackage x\n", []), ("# The generated report is checked here by hand.\nx = 1\n", []), ("text = 'do not edit'\n", []),
        ("/* Bundled copy of libfoo 1.2.3, see there */\nint x;\n", ["vendored"]), ("# foo v1.2.3 | (c) the foo authors | permissive licence\nx = 1\n", ["vendored"]), ("# (c) our own team. All rights reserved.\nx = 1\n", []),
        ("// Thin wrapper around foo; talks to version 1 only.\nx\n", []), ("// Loader for the vendor catalogue; replaces the minified one.\nx\n", []),
        ("var a=b=>{" + "c?d:e;f(g,1);" * 30, ["minified"]), ("X = \"" + "aB3/" * 90, ["data"]), ("const x = [\n" + "  0x1f, 0x2a, 0x00, 0xff,\n" * 14, ["data"]),
        ("export default [" + "[12,0.5],[7,0.25]," * 20, ["data"]), ("", []), (PLAIN, []),
    ]


def test_heads(spark):
    found = judged(spark, [(f"/code/a/src/x{i}.py", head) for i, (head, _) in enumerate(HEADS)])
    assert [found[f"/code/a/src/x{i}.py"] for i in range(len(HEADS))] == [kinds for _, kinds in HEADS]


def test_string_tables(spark):
    head = "WORDS = [\n" + "    'some',\n" * 30
    assert judged(spark, [("/code/a/long.py", head, 5000, 60000), ("/code/a/short.py", head, 33, 400)]) == {"/code/a/long.py": ["data"], "/code/a/short.py": []}


def test_code_files(spark, rows):
    state = spark.createDataFrame([("/a.py", " Code ", "x"), ("/b.py", None, None), ("/c.PY", None, None), ("/d.txt", None, None), ("/e.py", "text", None), (None, "code", None), ("/a.py", "CODE", "y")], STATE)
    assert rows(sf.code_paths(state)) == [("/a.py",), ("/b.py",), ("/c.PY",)]


def test_edges(spark):
    state = spark.createDataFrame([("/x.py", "code", "A")] * 2, STATE).withColumn("head", F.lit(1))
    heads = spark.createDataFrame([("/x.py", None, None, "x = 1\n" * 100_000), ("/x.py", 0, 0, None), (None, 1, 1, "x")], HEAD).withColumn("status", F.lit("?"))
    assert [tuple(r) for r in sf.classify_sources(state, heads).collect()] == [("/x.py", [], [])]
    assert sf.handwritten_sources(state, heads).count() == 1
    assert sf.classify_sources(state.limit(0), heads).count() == 0 and sf.foreign_sources(state, heads.limit(0)).count() == 0


def test_wrapped_encoded_data(spark):
    """Base64 and hex in lines too short for an encoded run show by their density alone."""
    base64 = "\n".join(["    " + "aB3/dE5fG7hJ9kLmmN1pQ3rS5tU7vW9xY+0" * 2] * 5)
    heads = {"base": 'X = """\n' + base64, "hex": "X = `\n" + "\n".join(["00ff1e2d" * 9] * 5), "code": "a_long_name_of_a_thing = another_name(first_value, second_value)\n" * 6}
    found = judged(spark, [(f"/code/a/{name}.{ext}", head) for name, head in heads.items() for ext in ("py", "ts", "go")])
    assert {path for path, kinds in found.items() if kinds == ["data"]} == {f"/code/a/{n}.{e}" for n in ("base", "hex") for e in ("py", "ts", "go")} and all(kinds in ([], ["data"]) for kinds in found.values())


PY_TABLE = "\n".join(f"    {n}, {n + 7}, {n * 3}," for n in range(100, 120))


def test_limits_are_per_language(spark):
    numbers, run, code = "\n".join(["const t = {name_a: 1234, name_b: 5678, name_c: 91011,"] * 7), "key = '" + "aB3x" * 24 + "'\n" + PLAIN * 4, "let aaaa = bbbb(cccc);" * 12
    wanted = {("js", numbers): ["data"], ("c", numbers): [], ("ts", run): ["data"], ("go", run): [], ("py", PY_TABLE): ["data"], ("rs", code): ["minified"], ("sh", code + "\n"): []}
    found = judged(spark, [(f"/code/a/src/x{i}.{ext}", head) for i, (ext, head) in enumerate(wanted)])
    assert found == {f"/code/a/src/x{i}.{ext}": kinds for i, ((ext, _), kinds) in enumerate(wanted.items())}


def test_layout_alone_decides(spark, rows):
    """Whatever the files are called and their comments say, layout finds minified code and data, and names no plain file."""
    heads = {"a.js": "var a=b=>{" + "c?d:e;f(g,1);" * 30, "b.py": PY_TABLE, "c.ts": "X = \"" + "aB3/" * 90, "d.go": PLAIN * 5, "vendor/e.go": PLAIN * 5, "f.py": "# @generated by tool\nx = 1\n"}
    frame = spark.createDataFrame([(f"/code/{n}", h.count("\n") + 1, len(h), h) for n, h in heads.items()], HEAD)
    judged = {r["file_path"]: (r["l_minified"], r["l_data"]) for r in sf.judge_layout(frame).collect()}
    assert {n for n, flags in judged.items() if any(flags)} == {"/code/a.js", "/code/b.py", "/code/c.ts"}
    state = spark.createDataFrame([(f"/code/{n}", "code", "A") for n in heads], STATE)
    shown = sf.foreign_sources(state, frame).select("file_path", F.explode("evidence").alias("e")).select("file_path", "e.kind", "e.by")
    assert rows(shown) == [("/code/a.js", "minified", "layout"), ("/code/b.py", "data", "layout"), ("/code/c.ts", "data", "layout"), ("/code/f.py", "generated", "comment"), ("/code/vendor/e.go", "vendored", "path")]
