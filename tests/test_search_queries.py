"""The searches of the named queries: every vector asks, and all vectors are searched."""

import numpy as np
from pyspark.sql import functions as F

from checks import queries


def test_every_vector_asks_all(spark, tmp_path):
    made = np.random.default_rng(2).standard_normal((63, 8)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(made)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = made / np.linalg.norm(made, axis=1)[:, None]
    for query, other in ((queries.nearest_vectors, False), (queries.nearest_vectors_other_file, True)):
        found = {r.query_idx: r.found for r in query(spark, str(tmp_path)).groupBy("query_idx").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_idx"))).alias("found")).collect()}
        assert found.keys() == set(range(63))
        for q, got in found.items():
            best = sorted(range(63), key=lambda c: -float(unit[q] @ unit[c]))
            best = [c for c in best[:15] if c % 3 != q % 3] if other else best
            assert [r.chunk_idx for r in got] == best[:5]
