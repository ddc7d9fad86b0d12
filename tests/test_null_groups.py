"""Rows of a null repository are rows of a repository like others, in every join; and groups of any size are searched in cells."""

import random

import numpy as np
from pyspark.sql import functions as F

from patchlake.operators import context, definitions, imports, nearest, reviews


def test_classify(spark):
    files = [("r", "app/core.py", "import app.core\nimport os\nimport numpy\n"), (None, "app/core.py", "import app.core\nfrom core.x import y\nimport nope\n")]
    df = spark.createDataFrame([(i, r, p, c, "python") for i, (r, p, c) in enumerate(files)], "id int, repo string, file_path string, content string, language string")
    made = imports.classify(imports.import_rows(df, ["id", "repo"]), imports.local_modules(df, ["repo"]), ["repo"])
    assert sorted((x.id, x.raw_import, x.import_type) for x in made.collect()) == [
        (0, "app.core", "local"), (0, "numpy", "third_party"), (0, "os", "stdlib"), (1, "app.core", "local"), (1, "core.x", "local"), (1, "nope", "third_party")]
    by_type = imports.imports_by_type(made, ["repo"])
    lines = definitions.file_summaries(definitions.file_facts(df, ["repo"]), by_type, ["repo"]).collect()
    assert {x.repo: x.summary for x in lines} == {"r": "Local: app; Stdlib: os", None: "Local: app, core"}


def test_find_by_name(spark):
    rows = [(g, i, "f", name, [1.0, float(i)]) for g in ("r", None) for i, name in enumerate(["alpha", "beta"])]
    df = spark.createDataFrame(rows, "repo string, chunk_idx long, file_path string, name string, embedding array<double>")
    found = nearest.find_by_name(df, ["repo"], ["alpha", "nope"], embed=lambda texts: [[1.0, 1.0] for _ in texts])
    assert {(x.repo, x.query) for x in found.collect()} == {(r, q) for r in ("r", None) for q in ("alpha", "nope")}


def test_gather_and_reviews(spark):
    files = spark.createDataFrame([(None, 1, 0, "a.py"), ("r", 1, 0, "a.py")], "repo string, pr int, query_idx long, file_path string")
    chunks = spark.createDataFrame([(g, 1, i, i, p, 1, "n", "text") for g in ("r", None) for i, p in enumerate(["a.py", "b.py"])], "repo string, pr int, chunk_idx long, chunk_ord long, file_path string, start_line int, name string, content string")
    matches = spark.createDataFrame([(g, 1, 0, 1, 0.9, 1) for g in ("r", None)], "repo string, pr int, query_idx long, chunk_idx long, score float, rank int")
    made = context.gather(files, matches, chunks, ["repo", "pr"]).collect()
    assert {(x.repo, len(x.similar), x.similar[0].file_path, len(x.related)) for x in made} == {("r", 1, "b.py", 1), (None, 1, "b.py", 1)}
    changed = spark.createDataFrame([(None, 1, 0, "a.py", "+x", 1)], "repo string, pr int, file_ord long, filename string, patch string, changes long")
    contents = spark.createDataFrame([(None, 1, "a.py", "body")], "repo string, pr int, filename string, content string")
    assert reviews.attach_contents(changed, contents, ["repo", "pr"]).first().content == "body"


def test_a_large_group_is_searched_in_cells(spark):
    """Nine tenths of all rows in the null group; cells of five queries and seven chunks give what one cell gives."""
    r = random.Random(5)
    rows = [(None if i % 10 else f"g{i % 3}", i, f"f{i % 9}", [r.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "repo string, chunk_idx long, file_path string, embedding array<double>")
    asked = df.withColumnRenamed("chunk_idx", "query_idx")

    def search(**more):
        return sorted(map(tuple, nearest.nearest(asked, df, ["repo"], k=3, exclude_own_file=True, **more).collect()), key=str)

    assert search(cell_size=(5, 7)) == search()
    left, right = nearest._with_grid(asked, df, ["repo"], (5, 7))
    grid = left.groupBy("repo", "_rows", "_columns").agg(F.count("*").alias("n")).collect()
    assert all(x._rows == -(-x.n // 5) and x._columns == -(-x.n // 7) for x in grid) and len(grid) == 4 and right.count() == 200
    one = [x for x in rows if x[0] is None]
    vectors = np.array([x[3] for x in one])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    best = {x[1]: max(((vectors[i] @ vectors[j], one[j][1]) for j in range(len(one)) if one[j][2] != x[2]))[1] for i, x in enumerate(one)}
    assert {q: c for repo, q, c, _, rank in search() if repo is None and rank == 1} == best
