"""Groups that a task can hold are indexed in one pass over their files, and give the index that the way for larger groups gives."""

import pytest

from checks.corpora import letter_counts
from patchlake.plans import indexing

FILES = "repo string, pr long, file_ord long, filename string, content string"


def code(n, lines):
    return "import os\n" + "\n".join(f"def f{n}_{k}(a):\n    x{k} = 'é{'y' * (k * n % 97)}'" for k in range(lines))


def rows():
    whole = [(f"r{p % 3}" if p % 4 else None, p, k, f"src/m{k}.py", code(k + p, 40 * k + p)) for p in range(9) for k in range(5)]
    odd = [("r", 90, 0, "vendor/a.py", "x"), ("r", 90, 1, "a.md", "x"), ("r", 90, 2, "b.py", ""), ("r", 90, 3, "b.py", None), ("r", 90, None, "c.go", "func Run() {")]
    return [*whole, *odd, *whole[:7], ("r1", 1, 2, "src/m2.py", code(3, 20)), ("r", 91, 5, "src/a.py", code(7, 300) + "z" * 20_000), (None, None, 1, "a.js", "class A {\n" * 40)]


def indexed(spark, folder, embed=letter_counts):
    made = indexing.index_pull_requests(spark.createDataFrame(rows(), FILES), embed, str(folder), 26)
    return made.columns, sorted(map(repr, made.drop("embed_seconds").collect()))


@pytest.mark.parametrize("chars", [0, 9_000])
def test_both_ways_give_the_same(spark, tmp_path, monkeypatch, chars):
    want = indexed(spark, tmp_path / "whole")
    monkeypatch.setattr(indexing, "WHOLE_GROUP_CHARS", chars)
    assert indexed(spark, tmp_path / "parted") == want and len(want[1]) > 3000


def test_failed_calls(spark, tmp_path):
    def embed(texts):
        if any("class A" in text for text in texts):
            raise ValueError
        return [[1.0] * 26 for _ in texts]

    found = spark.createDataFrame(rows(), FILES)
    made = indexing.index_pull_requests(found, embed, str(tmp_path), 26).select("repo", "pr", "embed_ok", "embedding").distinct().collect()
    assert {(x.repo, x.pr) for x in made if not x.embed_ok} == {(None, None)} and all(sum(x.embedding) == 0 for x in made if not x.embed_ok)


def test_chunks_are_not_joined(spark, tmp_path):
    """One shuffle of the files, none of their chunks; the sizes of the groups are another one."""
    shuffles = []

    def plan(df, path):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return one(df, path)

    one, indexing.saved = indexing.saved, plan
    try:
        assert indexed(spark, tmp_path)[1]
    finally:
        indexing.saved = one
    assert shuffles == [1, 1]
