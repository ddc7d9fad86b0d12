"""Inputs that are costly to make are made once."""

from pyspark.sql import functions as F

from checks import corpora
from patchlake.operators import import_graph, reviews
from patchlake.plans.review import retrieve

PR = ["repo", "pr"]


def counted(df, read):
    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema)


def test_imports_are_searched_once(spark, tmp_path):
    rows = [(r, p, c, "python") for r in ("r", None) for p, c in (("a/b.py", "import c\n"), ("c.py", "import os\nfrom a.b import x\n"))]
    files = spark.createDataFrame(rows, "repo string, file_path string, content string, language string")
    read = spark.sparkContext.accumulator(0)
    one = import_graph.import_rows  # the other reader of the files takes their paths only
    edges = import_graph.import_edges(counted(files, read), ["repo"], folder=str(tmp_path))
    saved_at = read.value
    got = sorted((x.repo or "", x.source, x.target) for x in edges.collect())
    want = sorted((x.repo or "", x.source, x.target) for x in import_graph.import_edges(files, ["repo"]).collect())
    assert got == want and len(got) == 4 and one(files, ["repo"]).count() == 6
    assert saved_at == 4 and read.value == 8


def test_comments_are_matched_once(spark):
    comments = "array<struct<pos:int,line:int,text:string>>"
    rows = [(r, p, k, f"f{k}", [(0, 1, f"t{k}")] if k % 3 else []) for r in ("r", None) for p in (1, 2) for k in (1, 2, 3, 150, 151, 153)]
    commented = spark.createDataFrame([*rows, ("r", 3, None, "f", [(0, 1, "t")]), ("r", 4, 1, "f", [])], f"repo string, pr long, file_ord long, filename string, comments {comments}")
    read = spark.sparkContext.accumulator(0)
    made = reviews.fallback_bodies(counted(commented, read)).collect()
    assert read.value == len(rows) + 2
    parts = {(x.repo, x.pr, x.part): x.body for x in made}
    assert len(parts) == len(made) and {k[2] for k in parts if k[:2] == (None, 1)} == {0, 1, 2} and ("r", 4, 0) not in parts
    assert parts[None, 1, 1] == "**f1**: t1\n\n**f2**: t2\n\n" and parts["r", 3, 0] == parts["r", 1, 0] and parts["r", 3, None]


def test_starts_of_changed_files(spark, tmp_path):
    texts = ["", None, "one", "A " * 50, "1 2 3", "é", "x y\nz"]
    rows = [(i if i % 23 else None, texts[i % 7]) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(length(text) as bigint) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    keys = ["repo", "pr", "file_ord", "filename"]
    whole, start = (reviews.eligible_files(made(spark, str(tmp_path))).select(*keys) for made in (corpora.pr_files, corpora.pr_file_starts))
    assert whole.count() and whole.exceptAll(start).count() == start.exceptAll(whole).count() == 0
    assert corpora.linked_paths(spark, str(tmp_path)).select("repo", "file_path").exceptAll(corpora.linked_files(spark, str(tmp_path)).select("repo", "file_path")).count() == 0


def test_files_are_asked_for_once(spark, tmp_path):
    """The texts of files are read for their queries, and once more for the result; keys come from the saved queries. A file without a text
    to ask with calls no model, and has the context of its own chunks."""
    index = spark.createDataFrame(
        [("r", 1, k, k, "a.py", k + 1, f"n{k}", "x" * k, [1.0, float(k)]) for k in range(4)],
        "repo string, pr long, chunk_idx long, chunk_ord int, file_path string, start_line int, name string, content string, embedding array<float>",
    )
    rows = [("r", 1, 0, "a.py", None, ""), ("r", 1, 1, "b.py", "p", "c"), ("r", 2, 0, "b.py", "p", "c"), (None, None, None, "b.py", "", "c")]
    files = spark.createDataFrame(rows, "repo string, pr long, file_ord long, file_path string, patch string, content string")
    read, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return [[1.0, 0.0] for _ in texts]

    made = {(x.pr, x.file_ord): x for x in retrieve(counted(files, read), index, embed, str(tmp_path)).collect()}
    assert read.value == 2 * len(rows) and asked.value == 3
    assert len(made) == 4 and [len(made[1, 0].similar), len(made[1, 0].related), len(made[1, 1].similar)] == [0, 3, 4]
    assert made[1, 0].has_index and not made[2, 0].has_index and not made[None, None].has_index
