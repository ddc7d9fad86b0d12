"""Edges between files, and what a change reaches."""

from patchlake.operators import import_graph as graph

REPO = ["repo"]


def edges_of(spark, files):
    df = spark.createDataFrame([(r, p, c, "python" if p.endswith(".py") else "javascript") for r, p, c in files], "repo string, file_path string, content string, language string")
    return graph.import_edges(df, REPO)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_resolution(spark):
    files = [
        ("r", "src/app/core.py", "import os\nfrom app import util\nimport app.util.deep\n"),
        ("r", "src/app/util.py", "from .core import x\nfrom . import core\nfrom ..app.core import y\nfrom ...x import z\n"),
        ("r", "src/app/__init__.py", "import app.core\nimport app\n"),  # itself: no edge
        ("r", "lib/core.py", "import core\nfrom .missing import x\nimport numpy\n"),
        ("r", "core.js", "import core\n"),
        ("q", "main.py", "import app.core\n"),  # another repository
        (None, "a.py", "import b\n"),
        (None, "b.py", "import a\n"),
    ]
    assert rows(edges_of(spark, files)) == sorted([
        ("r", "src/app/core.py", "src/app/__init__.py", "app"),
        ("r", "src/app/core.py", "src/app/util.py", "app.util.deep"),
        ("r", "src/app/util.py", "src/app/core.py", ".core"),
        ("r", "src/app/util.py", "src/app/__init__.py", "."),
        ("r", "src/app/util.py", "src/app/core.py", "..app.core"),
        ("r", "src/app/__init__.py", "src/app/core.py", "app.core"),
        (None, "a.py", "b.py", "b"), (None, "b.py", "a.py", "a"),
    ], key=str)


def test_of_several_files_the_nearest_name_wins(spark):
    files = [("r", "deep/er/core.py", ""), ("r", "x/core.py", ""), ("r", "b/core.py", ""), ("r", "main.py", "import core\n")]
    assert rows(edges_of(spark, files)) == [("r", "main.py", "b/core.py", "core")]


def test_degrees_and_importers(spark):
    files = [("r", "a.py", "import b\nfrom b import x\nfrom .b import y\nimport c\n"), ("r", "b.py", "import c\n"), ("r", "c.py", "")]
    edges = edges_of(spark, files)
    assert rows(graph.importers(edges, REPO)) == [("r", "b.py", "a.py", 2), ("r", "c.py", "a.py", 1), ("r", "c.py", "b.py", 1)]
    assert rows(graph.import_degrees(edges, REPO).select("file_path", "imported", "imported_by")) == [("a.py", 2, 0), ("b.py", 1, 1), ("c.py", 0, 2)]


def test_affected_files(spark, tmp_path):
    # a ring of five with a tail, in a named and in the null repository; an edge of another repository stays out
    ring = [(repo, f"f{i}.py", f"f{(i + 1) % 5}.py", "") for repo in ("r", None) for i in range(5)]
    edges = spark.createDataFrame([*ring, ("r", "t.py", "f0.py", ""), ("r", "u.py", "t.py", ""), ("q", "v.py", "f0.py", "")], "repo string, source string, target string, raw_import string")
    changed = spark.createDataFrame([("r", "f0.py"), (None, "f3.py"), (None, "f3.py"), ("q", "new.py")], "repo string, file_path string")
    found = rows(graph.affected_files(edges, changed, REPO, str(tmp_path / "a")))
    assert found == sorted([
        ("r", "f0.py", 0), ("r", "f4.py", 1), ("r", "f3.py", 2), ("r", "f2.py", 3), ("r", "f1.py", 4), ("r", "t.py", 1), ("r", "u.py", 2),
        (None, "f3.py", 0), (None, "f2.py", 1), (None, "f1.py", 2), (None, "f0.py", 3), (None, "f4.py", 4), ("q", "new.py", 0),
    ], key=str)
    assert rows(graph.affected_files(edges.limit(0), changed.limit(0), REPO, str(tmp_path / "b"))) == []
