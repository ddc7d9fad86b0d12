"""The stages of the corpus pipeline one after the other, each held against plain Python on what it was given."""

import os
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from patchlake.llm import decontamination, quality_rules
from patchlake.llm.queries import QUERIES
from patchlake.llm.sql import SQL
from tests.llm.test_operators import crc, plain_groups, plain_ids
from tests.test_queries import rows as sorted_rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(QUERIES)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline") == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    made, wanted = QUERIES[name](spark, DATA), con.execute(SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted_rows(made.columns, made.collect()) == sorted_rows(names, wanted.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, given, kept = docs.columns, {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given[name] = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            kept[name] = {r.doc_id: r for r in docs.collect()}
            assert len(kept[name]) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    base = {d: quality_rules.statistics(r.text) for d, r in given["quality rules"].items()}
    passed = {d for d, s in base.items() if s[0] >= 20 and 100 * s[4] <= 30 * s[0]}
    stay = set(kept["quality rules"])
    assert stay <= passed and {d for d in passed if labels.get(d) == 1} <= stay and not {d for d in stay if labels.get(d) == 0}

    before = given["n-gram Jaccard join"]
    groups = plain_groups([(d, r.text) for d, r in before.items()], 5, 80)
    assert set(kept["n-gram Jaccard join"]) == {d for d, _, c in groups if d == c}

    items = [decontamination.normal_form(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = {d for d, r in given["benchmark decontamination"].items() if any(i in decontamination.normal_form(r.text) for i in items)}
    assert set(kept["benchmark decontamination"]) == set(given["benchmark decontamination"]) - holds and holds

    private = re.compile(r"[\w.]+@[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+|[0-9a-f]{40}")
    found = 0
    for d, r in given["PII"].items():
        after = kept["PII"][d]
        for value in private.findall(r.text):
            found += 1
            assert value not in after.text
        if not re.search(r"[0-9@=]", r.text):
            assert after == r
        assert after.n_chars == len(after.text)
    assert found

    pieces, places = defaultdict(list), defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(given["best-fit packing"])
    for d, own in pieces.items():
        ids = [*plain_ids(given["best-fit packing"][d].text), 0]
        own.sort(key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for at in range(0, len(ids), 2048)]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
