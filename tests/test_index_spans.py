"""The index of large groups by spans of batches: what it saves on the way."""

import os

import pytest

from checks.corpora import letter_counts
from patchlake.plans import indexing
from tests.test_index_ways import FILES, rows


@pytest.mark.parametrize("span", [1, 3])
def test_texts_of_large_groups_are_in_the_index_only(spark, tmp_path, monkeypatch, span):
    """Tables on the way hold no text, and spans of few batches give what a task gives that holds a group."""
    def made(folder):
        index = indexing.index_pull_requests(spark.createDataFrame(rows(), FILES), letter_counts, str(folder), 26)
        return sorted(map(repr, index.drop("embed_seconds").collect()))

    want = made(tmp_path / "whole")
    monkeypatch.setattr(indexing, "WHOLE_GROUP_CHARS", 0)
    monkeypatch.setattr(indexing, "SPAN", span)
    assert made(tmp_path / "parted") == want
    tables = {name: set(spark.read.parquet(f"{tmp_path}/parted/{name}").columns) for name in os.listdir(tmp_path / "parted")}
    assert {name for name, columns in tables.items() if "content" in columns} == {"index"}
