from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlake.functions import text
from patchlake.operators import chunks, definitions, imports, skew
from patchlake.sources import files
from tests import models

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v string").select("id", expression(F.col("v")).alias("r"))
    return [row.r for row in rows.orderBy("id").collect()]


def test_paths(spark):
    paths = ["a/b.py", ".bashrc", "a.b.", "..x.y", "d.x/file", "A.PY", "src/.env/a.py", "vendor/a.go", "a/yarn.lock", "x.mjs"]
    assert column(spark, paths, text.extension) == ["py", "", "", "y", "", "PY", "py", "go", "lock", "mjs"]
    assert column(spark, paths, text.is_indexed_path) == [True, False, False, False, False, True, False, False, False, True]
    assert column(spark, paths, text.is_reviewed_path) == [True, False, False, False, False, False, True, True, False, False]
    assert column(spark, [".py", "TSX", "h", "mjs", ""], text.language) == ["python", "typescript", "c", "unknown", "unknown"]


def test_strip_like_python(spark):
    values = [" a ", "\u2003a\x1c\n", "\t\n", "a b", "", "\x85\u00a0x"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.is_blank) == [not v.strip() for v in values]


def test_decode(spark):
    raw = ["é\r\nx\ry".encode(), "é\r\n".encode("latin-1"), b""]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "id int, content binary")
    assert [r.content for r in files.decode_files(df).orderBy("id").collect()] == ["é\nx\ny", "é\n", ""]


def test_read_tree(spark, tmp_path):
    for path in ("src/a.py", "node_modules/b.js", "src/c.txt", "d.go"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x = 1\r\n")
    rows = files.read_tree(spark, str(tmp_path), "org/r").collect()
    assert sorted((r.repo, r.file_path, r.content) for r in rows) == [("org/r", "d.go", "x = 1\n"), ("org/r", "src/a.py", "x = 1\n")]


def test_local_modules(spark):
    df = spark.createDataFrame([("r", "src/pyutils.py"), ("r", "pkg/__init__.py"), ("r", "a/b.js")], "repo string, file_path string")
    # Slashes become dots before ".py" goes, so the two names run together.
    assert sorted(r.module for r in imports.local_modules(df, ["repo"]).collect()) == ["__init__", "pkg", "pkg.__init__", "srcutils"]


def test_imports(spark):
    code = "import os, sys\nimport app.core as c\nfrom . import x\nfrom .rel.y import z\nfrom os import path\n  import hidden\nfrom PIL import Image\nimport __future__\nfrom app.core import d\nimport Flask"
    df = spark.createDataFrame([("r", "f.py", code, "python"), ("r", "g.js", code, "javascript")], "repo string, file_path string, content string, language string")
    modules = spark.createDataFrame([("r", "app"), ("r", "os"), ("other", "PIL")], "repo string, module string")
    rows = imports.classify(imports.import_rows(df, ["repo", "file_path"]), modules, ["repo"])
    got = [(r.raw_import, r.module_name, r.full_path, r.import_type, r.is_relative) for r in rows.orderBy("pos").collect()]
    assert got == [
        ("os", "os", "os", "stdlib", False), ("app.core", "app", "app.core", "local", False),
        ("__future__", "__future__", "__future__", "third_party", False), ("Flask", "Flask", "Flask", "third_party", False),
        (".", "", "", "local", True), (".rel.y", "rel", "rel.y", "local", True), ("PIL", "PIL", "PIL", "third_party", False),
    ]
    lists = imports.imports_by_type(rows, ["repo", "file_path"]).collect()[0]
    assert [i.raw_import for i in lists.local] == ["app.core", ".", ".rel.y"]
    facts = definitions.file_facts(df, ["repo", "file_path"])
    summary = definitions.file_summaries(facts, imports.imports_by_type(rows, ["repo", "file_path"]), ["repo", "file_path"])
    assert {r.file_path: r.summary for r in summary.collect()} == {"f.py": "Local: app, , rel; Stdlib: os", "g.js": "No structure detected"}


def code(spark, content, language="python"):
    return spark.createDataFrame([("dir/f.x", content, language)], "file_path string, content string, language string")


def test_definitions_of_languages(spark):
    samples = {
        "python": ("def a(x):\n  class B:\nasync def c():\nasync  def d ()", [("a", "function", 1), ("B", "class", 2), ("c", "async_function", 3), ("d", "async_function", 4)]),
        "typescript": ("const f = async (\nfunction g() { class H }\ninterface I", [("f", "function", 1), ("g", "function", 2), ("H", "class", 2), ("I", "interface", 3)]),
        "java": ("x = new Foo(1);\npublic class Bar {", [("Foo", "method", 1), ("Bar", "class", 2)]),
        "go": ("func (s *T) Run(a) {\ntype T struct {", [("Run", "function", 1), ("T", "struct", 2)]),
        "rust": ("fn main() {", []),
    }
    for language, (content, wanted) in samples.items():
        rows = definitions.definition_rows(code(spark, content, language), ["file_path"]).orderBy("pos").collect()
        assert [(r.name, r.type, r.line) for r in rows] == wanted


def spans(df):
    return [(r.start_line, r.end_line, r.chunk_type, r["name"], r.content) for r in df.orderBy("chunk_ord").collect()]


def test_function_chunks(spark):
    body = "\n".join(f"# {i}" for i in range(28))
    content = f"import os\n{body}\ndef a(): pass\nx = '" + "y" * 6000 + "'\nclass B: pass"
    got = spans(chunks.function_chunks(code(spark, content), ["file_path"]))
    assert [g[:4] for g in got] == [(1, 29, "imports", "imports"), (30, 31, "function", "a"), (32, 32, "class", "B")]
    assert len(got[1][4]) == 5000 and got[0][4].startswith("import os\n# 0")
    short = spans(chunks.function_chunks(code(spark, "def a(): pass\n"), ["file_path"]))
    assert short == [(1, 2, "file", "f.x", "def a(): pass\n")]
    # Two definitions on one line leave the first with no lines.
    twice = spans(chunks.function_chunks(code(spark, "\n" * 40 + "function a() { class B }", "javascript"), ["file_path"]))
    assert twice == [(41, 40, "function", "a", ""), (41, 41, "class", "B", "function a() { class B }")]


@QUICK
@given(st.lists(st.tuples(st.integers(1, 120), st.integers(1, 20), st.integers(0, 25)), min_size=1, max_size=4))
def test_fixed_chunks(spark, cases):
    for count, size, overlap in cases:
        lines = [f"l{i}" for i in range(1, count + 1)]
        got = spans(chunks.fixed_chunks(code(spark, "\n".join(lines)), ["file_path"], size, overlap))
        assert got == [(a, b, "block", None, "\n".join(lines[a - 1 : b])) for a, b in models.windows(count, size, overlap)]


def test_code_chunks_split_long_definitions(spark):
    lines = ["", "x = 1", "def a():"] + ["    pass"] * 11 + ["def b(): pass"]
    got = spans(chunks.code_chunks(code(spark, "\n".join(lines)), ["file_path"], max_lines=5, overlap=2))
    inner = [(a + 2, b + 2, "function", "a") for a, b in models.windows(12, 5, 2)]
    assert [g[:4] for g in got] == [(1, 2, "import", None), *inner, (15, 15, "function", "b")]


def test_running_start_in_blocks(spark):
    rows = [("g", i * 3, i % 5) for i in range(200)] + [("h", 7, 4)]
    df = spark.createDataFrame(rows, "g string, o long, n long")
    got = {(r.g, r.o): r.s for r in skew.with_running_start(df, ["g"], "o", "n", "s", block=16).collect()}
    total = 0
    for _, order, count in rows[:200]:
        assert got["g", order] == total
        total += count
    assert got["h", 7] == 0
    numbered = skew.with_position(df, ["g"], "o", "p").where("g = 'g'").orderBy("o").collect()
    assert [r.p for r in numbered] == list(range(200))
