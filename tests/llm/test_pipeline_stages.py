"""Every stage of the pipeline on rows that are odd: null ids and texts, repeated rows, empty tables, columns with names used inside."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _quality string, _matches int, _entities string, _text_hash long, key string"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(4)
    words = lambda n: " ".join(f"{r.choice(['lorem', 'ipsum', 'dolor', 'sit', 'amet'])}{r.randrange(5000)}" for _ in range(n))
    long = words(5000)
    copy = words(80)
    texts = [None, "", " \n", "one word", long, copy, copy, "Mail anna@example.com now. " + words(40), words(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, copy), (4, long), (None, words(50)), (None, None), (None, words(50))]
    made = [(i, t, "en", "s", None if t is None else len(t), "q", 7, "e", 9, "k") for i, t in rows]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("k", range(4))
def test_filtering_stages(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    made = stage(spark, odd, SF)
    assert made.columns == odd.columns
    rows = made.collect()
    assert {(x._quality, x._matches, x._entities, x._text_hash, x.key) for x in rows} <= {("q", 7, "e", 9, "k")}
    ids = sorted((x.doc_id if x.doc_id is not None else -1) for x in rows)
    if k == 0:
        assert not any(x.text is None or len(x.text.split()) < 20 for x in rows)
    if k == 1:  # one of each group, one of repeated rows, all without an id
        assert ids == [-1, -1, -1, 0, 1, 2, 3, 4, 5, 7, 8]
    if k in (2, 3):
        assert len(rows) == odd.count()
    if k == 3:
        changed = [x for x in rows if x.doc_id == 7]
        assert "anna@example.com" not in changed[0].text and changed[0].n_chars == len(changed[0].text)
        assert sum(x.text is None for x in rows) == 2
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_packing_stage(spark, odd):
    made = corpus_pipeline.STAGES[4][1](spark, odd, SF)
    assert made.select(F.countDistinct("sequence_id", "offset")).first()[0] == made.count()
    assert made.where("piece = 0").count() == odd.count()
    assert corpus_pipeline.STAGES[4][1](spark, odd.limit(0), SF).count() == 0
