"""Definitions that are found in a text as a whole are those that line by line work finds."""

import gc

import pytest
from patchlake import fixed
from patchlake.functions.frames import no_collection
from patchlake.operators import batches, context, definitions, reviews

LINES = [
    "def a(x):", "  \tdef b (", "def", "\r def c(", "class D", "  class E:", "class class F", "class", "async def g(", " async  def h(", "def i", "x def j(",
    "function k(", "const l = (", "class M class N", "interface O", "interface", "P(", "public class Q", "func r(", "func (s *S) t(", "type U struct", "\x0bdef v(", "",
]
TEXTS = ["\n".join(LINES), "\n".join(LINES) + "\n", "\n\n" + "\n".join(reversed(LINES)), "class\nA", "def\na(", "class\rB", "", *LINES]


def by_line(content, language):
    """One search per line and pattern, as with_definitions does."""
    finder, found = definitions.LineFinder(), []
    lines = content.split("\n")
    for order, (name, pattern, groups) in enumerate(fixed.DEFINITIONS.get(language, ())):
        for at, line in enumerate(lines):
            if any(part in line for part in definitions._NEEDED[language, name]) and (match := finder._pattern(pattern, line).search(line)):
                if named := next((match[group] for group in groups if match[group]), ""):
                    found.append((at + 1, order, name, named, sum(len(one) + 1 for one in lines[:at])))
    return sorted(found)


@pytest.mark.parametrize("language", [*fixed.DEFINITIONS, "rust", None])
def test_whole_text_as_line_by_line(language):
    finder = definitions.LineFinder()
    for content in [*TEXTS, *(one + "\né" for one in TEXTS)]:
        assert finder(content, language) == by_line(content, language)


def test_texts_of_ascii_are_not_searched_line_by_line(monkeypatch):
    monkeypatch.setattr(definitions, "_lines_with", lambda *_: pytest.fail("searched line by line"))
    assert [one[3] for one in definitions.LineFinder()("def a():\nclass B:\n", "python")] == ["a", "B"]


def test_no_collection_ends_as_it_began():
    for switch in (gc.enable, gc.disable, gc.enable):
        switch()
        was = gc.isenabled()
        with pytest.raises(ValueError), no_collection():
            assert not gc.isenabled()
            raise ValueError
        assert gc.isenabled() == was


def test_rows_pass_by_models_unchanged(spark):
    """Whole numbers beside nulls stay exact, as they do not become doubles on the way."""
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a"), (None, "b"), (3, None)], "k long, t string").coalesce(1)
    asked = batches.embed_queries(df, "t", lambda texts: {"a": [[1.0, 2.0]]}[texts[0]]).collect()
    assert sorted(asked, key=str) == sorted([(big, [1.0, 2.0]), (None, None), (3, None)], key=str)
    answered = reviews.generate_answers(df, lambda one: (one.upper(), 1, 2, 3), "t").collect()
    assert sorted(map(tuple, answered), key=str) == sorted([(big, "A", 1, 2, 3, None), (None, "B", 1, 2, 3, None), (3, None, None, None, None, "AttributeError")], key=str)
    empty = reviews.generate_answers(df.where("k = 0"), lambda one: (one, 1, 2, 3), "t")
    assert empty.collect() == []


def test_texts_of_chunks_are_not_sorted_for_their_matches(spark):
    """The matches are the side that is held, also those without a chunk, with nulls and with chunks that come twice."""
    files = spark.createDataFrame([("r", 0, "f"), ("r", 1, "g"), (None, 0, "h")], "repo string, query_idx int, file_path string")
    matches = spark.createDataFrame([("r", 0, 5, 0.5, 1), ("r", 0, 9, 0.4, 2), (None, 0, 5, 0.5, 1)], "repo string, query_idx int, chunk_idx int, score float, rank int")
    chunks = spark.createDataFrame(
        [("r", 5, 9, "f", 1, "n", "one"), ("r", 5, 9, "f", 1, "n", "two"), (None, 5, 9, "f", 1, "n", "three"), ("r", 6, 9, "f", 1, "n", "none")],
        "repo string, chunk_idx int, chunk_ord int, file_path string, start_line int, name string, content string",
    )
    made = context.gather(files, matches, chunks, ["repo"])
    found = {(x.repo, x.query_idx): [(s.rank, s.content) for s in x.similar] for x in made.collect()}
    assert found == {("r", 0): [(1, "one"), (1, "two"), (2, None)], ("r", 1): [], (None, 0): [(1, "three")]}
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildLeft" in plan
