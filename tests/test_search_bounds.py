"""Search that passes over parts of blocks by their bounds, against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.operators import nearest


def clustered(n, d, centres, spread, seed):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((centres, d))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    return middle[r.integers(0, centres, n)] + spread * r.standard_normal((n, d))


@pytest.mark.parametrize(("centres", "spread", "least"), [(40, 0.02, 0.5), (1, 1.0, 0.0)])
def test_exact_and_sparing(spark, centres, spread, least):
    vectors = clustered(3000, 16, centres, spread, 1)
    vectors[100] = vectors[2000] = vectors[7]  # ties go to the lower number
    rows = [(i, f"f{i % 7}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_idx long, file_path string, embedding array<double>")
    queries = chunks.where("chunk_idx % 20 = 0 or chunk_idx = 7").withColumnRenamed("chunk_idx", "query_idx")
    counted = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    made = nearest.nearest(queries, chunks, [], k=5, chunk_block=1024, counted=counted).orderBy("query_idx", "rank").collect()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    found = {}
    for row in made:
        found.setdefault(row.query_idx, []).append(row.chunk_idx)
    for q, got in found.items():
        score = (unit[q] @ unit.T).astype(np.float32)
        want = sorted(range(len(score)), key=lambda i: (-score[i], i))[:5]
        assert np.allclose(score[got], score[want], atol=1e-6)
    assert found[7][:3] == [7, 100, 2000]
    pairs, skipped = (a.value for a in counted)
    assert pairs and skipped / pairs >= least


def test_bounds_hold():
    r = np.random.default_rng(3)
    for _ in range(50):
        block = r.standard_normal((r.integers(1, 400), 6)) * r.choice([0.0, 0.1, 5.0])
        parts = nearest._parts(block)
        assert sorted(np.concatenate(parts).tolist()) == list(range(len(block)))
        q = r.standard_normal(6)
        for rows in parts:
            centre = block[rows].mean(0)
            radius = np.sqrt(((block[rows] - centre) ** 2).sum(1).max())
            assert (block[rows] @ q).max() <= q @ centre + np.linalg.norm(q) * radius + 1e-9


def test_later_blocks_are_not_ordered_whole(monkeypatch):
    """Once every query has k chunks, a block's scores are not ordered again, unless many reach the worst of them, as copies do."""
    r = np.random.default_rng(4)
    vectors = r.standard_normal((900, 24))
    vectors[[5, 400, 850]] = vectors[1]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ordered = []
    best = nearest._best
    monkeypatch.setattr(nearest, "_best", lambda scores, k: ordered.append(scores.shape) or best(scores, k))
    ids, files = np.arange(900), np.array([None, "a", "b"] * 300, dtype=object)
    cell = nearest._Cell((), 4)
    cell.add_queries(vectors[:50], ids[:50], files[:50])
    for at in range(0, 900, 300):
        cell.add_chunks(vectors[at : at + 300], ids[at : at + 300], files[at : at + 300])
    query, chunk, own, score = cell.result()
    product = (vectors[:50] @ vectors.T).astype(np.float32)
    want = [(q, c) for q in range(50) for c in sorted(range(900), key=lambda c: (-product[q, c], c))[:4]]
    assert list(zip(query.tolist(), chunk.tolist())) == want and len(ordered) == 1
    assert own.tolist() == [files[q] is not None and files[q] == files[c] for q, c in want]


def test_vectors_meet_no_sizes_of_small_groups(spark):
    """Where every group fits into a cell, vectors are shuffled to their cell and not joined before it."""
    rows = [(g, i, f"f{i % 3}", [float(i % 5 + 1), float(g or 7)]) for g in (1, 2, None) for i in range(12)]
    df = spark.createDataFrame(rows, "g long, chunk_idx long, file_path string, embedding array<float>")
    queries = df.withColumnRenamed("chunk_idx", "query_idx")
    found = nearest.nearest(queries, df, ["g"], 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    parted = nearest.nearest(queries, df, ["g"], 4, cell_size=(5, 5))
    assert "Join" in parted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, parted.collect())) and found.count() == 144


def test_many_queries_copy_chunks_less(spark, monkeypatch):
    """Up to 64 rows of cells each holds as many queries as set; then they hold more, up to four times. Blocks get shorter with them, and nothing else changes."""
    df = spark.createDataFrame([(i, f"f{i % 3}", [float(i % 17 + 1), float(i % 5), 1.0]) for i in range(400)], "chunk_idx long, file_path string, embedding array<float>")
    queries = df.withColumnRenamed("chunk_idx", "query_idx")
    rows = {size: nearest._with_grid(queries, df, [], (size, 500))[0].first()._rows for size in (50, 4, 1)}
    assert rows == {50: 8, 4: 64, 1: 100}
    monkeypatch.setattr(nearest, "MOST_PAIRS", 40)
    small = nearest.nearest(queries, df, [], 4, exclude_own_file=True, cell_size=(4, 60)).collect()
    monkeypatch.undo()
    assert sorted(small) == sorted(nearest.nearest(queries, df, [], 4, exclude_own_file=True).collect()) and len(small) > 800
