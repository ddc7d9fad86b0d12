"""What a review reads once, and what travels with it."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from patchlake.functions import vectors
from patchlake.operators.batches import embed_batches
from patchlake.plans import review

PR = ["repo", "pr"]


def letters(texts):
    return [[float(text.count(c)) for c in "abcd"] for text in texts]


def test_changed_files_are_read_once(spark):
    """All results of a run over files that are costly to make; two rows of one file and a null repository among them."""
    rows = [(r, p, k, f"src/f{k}.py", "@@ -1,2 +1,2 @@\n+abc\n-d", "def a():\n    abc\n", 2) for r in ("r", None) for p in (1, 2) for k in (0, 1)]
    given = spark.createDataFrame([*rows, rows[0]], "repo string, pr long, file_ord long, filename string, patch string, content string, changes long")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    durations = given.groupBy(*PR).agg(F.lit(1.0).alias("duration"), F.lit(0.5).alias("indexing_duration"), F.lit(0.25).alias("retrieval_duration"))
    failed = spark.createDataFrame([("r", 2, "UnicodeDecodeError")], "repo string, pr long, error_type string")
    run = review.review_pull_requests(
        given.mapInPandas(count, given.schema), durations, failed, letters, lambda prompt: ("1 : look", 10, 1, 11), "system", "model", tempfile.mkdtemp(), 4
    )
    points = [(x.repo, x.pr, x.metric) for x in run.points.collect()]
    assert {x.pr for x in run.headlines.collect()} == {1, 2} and run.comments.count() == len({(x.repo, x.pr, x.file_ord) for x in run.comments.collect()}) + 1
    assert points.count(("r", 2, "llm.errors")) == 1 and points.count((None, 1, "rag.retrieval.chunks")) == 2 and points.count(("r", 1, "rag.retrieval.chunks")) == 3
    assert read.value == len(rows) + 1


def test_unit_rows(spark):
    made = [[3.0, 4.0, 0.0], [0.0, 0.0, 0.0], [1e-20, 2e-20, 3.5], [0.1, 0.2, 0.3]]
    df = spark.createDataFrame([(v,) for v in made], "v array<float>").select("v", vectors.normalize(F.col("v"), vectors.norm(F.col("v"))).alias("u"))
    got = df.collect()
    flat = np.array([x.v for x in got], dtype=np.float32).ravel()
    assert vectors.unit_rows(flat, np.arange(0, 13, 3)).tolist() == [x.u for x in got]


def test_texts_are_made_at_the_call(spark):
    """Batches of the model over several Arrow batches, null groups and vectors of several lengths."""
    rows = [(g, i, i // 7, "ab" * (i % 4)) for g in ("x", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, pos long, batch long, body string")

    def model(texts):
        return [[float(len(text))] * (1 + len(text) % 2) for text in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = embed_batches(df, ["g"], "pos", model, 2, source=F.concat(F.lit("-"), "body"), unit=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) == len(rows) and made[0].asDict().keys() == {"g", "pos", "batch", "embedding", "embed_ok", "embed_seconds"}
    for x in made:
        size = 1 + 2 * (x.pos % 4)
        want = [1.0] if size % 2 == 0 else [np.float32(1 / np.sqrt(2))] * 2
        assert x.embed_ok and np.allclose(x.embedding, want)
