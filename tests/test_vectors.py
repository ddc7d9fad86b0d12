import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.corpora import letter_counts
from patchlake.functions.numbers import round_half_even
from patchlake.operators import batches, context, nearest, skew
from patchlake.operators.chunks import number_chunks
from patchlake.plans import indexing
from tests import models

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=150), min_size=1, max_size=3), st.integers(2, 9), st.integers(20, 60))
def test_batches_over_many_blocks(spark, groups, max_items, max_tokens):
    rows = [(g, i, n) for g, counts in enumerate(groups) for i, n in enumerate(counts)]
    df = spark.createDataFrame(rows, "g int, pos long, n long")
    got = {(r.g, r.pos): r.batch for r in batches.token_batches(df, ["g"], "pos", "n", max_tokens, max_items, block=10).collect()}
    for g, counts in enumerate(groups):
        assert [got[g, i] for i in range(len(counts))] == models.batch_numbers(counts, max_tokens, max_items)


def test_batches_chained_over_families(spark, monkeypatch):
    monkeypatch.setattr(batches, "FAN", 3)
    counts = [int(n) for n in np.random.default_rng(5).integers(0, 30, 400)]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(counts)], "g int, pos long, n long")
    rows = batches.token_batches(df, ["g"], "pos", "n", 50, 6, block=8).orderBy("pos").collect()
    assert [r.batch for r in rows] == models.batch_numbers(counts, 50, 6)


def test_null_groups_are_kept(spark):
    rows = [(g, i, 10) for g in (None, "a") for i in range(30)]
    df = spark.createDataFrame(rows, "g string, pos long, n long")
    got = batches.token_batches(df, ["g"], "pos", "n", 50, 6, block=8).collect()
    assert sorted((r.g or "", r.pos, r.batch) for r in got) == sorted((g or "", i, i // 5) for g, i, _ in rows)
    placed = skew.with_position(spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, o long"), ["g"], "o", "at").collect()
    assert sorted((r.g or "", r.o, r["at"]) for r in placed) == [("", 1, 0), ("", 2, 1), ("a", 3, 0)]
    texts = df.withColumn("t", F.lit("x" * 40))
    made = batches.embed_texts(texts, ["g"], "pos", "t", letter_counts, size=26, max_tokens=50, max_items=6).collect()
    assert len(made) == 60 and {(r.g, r.batch) for r in made} == {(g, b) for g in (None, "a") for b in range(6)}
    cut = spark.createDataFrame([(g, f, k) for g in (None, "a") for f in (0, None) for k in range(2)], "g string, file_ord long, chunk_ord int")
    assert number_chunks(cut, ["g"]).count() == 8


def test_embedding_failure_gives_zeros(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return letter_counts(texts)

    df = spark.createDataFrame([("g", 0, "a" * 40), ("g", 1, "bad" * 20), ("g", 2, "c" * 40)], "g string, pos long, t string")
    out = batches.embed_texts(df, ["g"], "pos", "t", embed, size=26, max_tokens=12, max_items=2)
    rows = out.orderBy("pos").collect()
    assert [(r.batch, r.embed_ok, sum(r.embedding)) for r in rows] == [(0, True, 40.0), (1, False, 0.0), (2, True, 40.0)]
    calls = batches.embedding_calls(out, ["g"]).orderBy("batch").collect()
    assert [(c.batch_size, c.success) for c in calls] == [(1, True), (1, False), (1, True)]


def brute(queries, chunks, k, exclude):
    out = {}
    for qi, (qv, qf) in enumerate(queries):
        unit = lambda v: np.asarray(v, np.float64) / (np.linalg.norm(v) or 1)
        scored = sorted((-float(np.float32(unit(qv) @ unit(cv))), ci, cf) for ci, (cv, cf) in enumerate(chunks))
        if exclude:
            scored = [s for s in scored[: 3 * k] if s[2] != qf]
        out[qi] = [(ci, -score) for score, ci, _ in scored[:k]]
    return out


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    data = [(rng.integers(-3, 4, 8).astype(float).tolist(), f"f{i % 3}") for i in range(60)]
    data[7] = ([0.0] * 8, "f1")
    df = spark.createDataFrame([("g", i, i, f, v) for i, (v, f) in enumerate(data)], "g string, query_idx long, chunk_idx long, file_path string, embedding array<float>")
    for exclude in (False, True):
        rows = nearest.nearest(df, df, ["g"], 4, exclude, chunk_block=16, grid=(3, 2)).orderBy("query_idx", "rank").collect()
        wanted = brute(data, data, 4, exclude)
        for q in range(60):
            got = [(r.chunk_idx, r.score) for r in rows if r.query_idx == q]
            assert [c for c, _ in got] == [c for c, _ in wanted[q]]
            assert np.allclose([s for _, s in got], [s for _, s in wanted[q]], atol=1e-6)


def test_overfetch_can_leave_fewer(spark):
    chunks = [("g", i, "own" if i < 15 else "other", [1.0, 0.01 * i]) for i in range(20)]
    df = spark.createDataFrame(chunks, "g string, chunk_idx long, file_path string, embedding array<float>")
    query = spark.createDataFrame([("g", 0, "own", [1.0, 0.0])], "g string, query_idx long, file_path string, embedding array<float>")
    assert nearest.nearest(query, df, ["g"], 5, exclude_own_file=True).count() == 0


def test_find_by_name(spark):
    chunks = [("g", 0, "f", "getUser", "ab"), ("g", 1, "f", "other", "function zz"), ("g", 2, "h", "USERS", "x"), ("h", 0, "f", "z", "zz")]
    df = spark.createDataFrame(chunks, "g string, chunk_idx long, file_path string, name string, content string")
    df = df.withColumn("embedding", F.array(*[F.length(F.regexp_replace("content", f"[^{chr(c)}]", "")).cast("float") for c in range(97, 123)]))
    rows = nearest.find_by_name(df, ["g"], ["user", "zz"], 1, embed=letter_counts).orderBy("g", "query").collect()
    assert [(r.g, r.query, r.chunk_idx) for r in rows] == [("g", "user", 0), ("g", "zz", 1), ("h", "user", 0), ("h", "zz", 0)]


def test_a_name_is_embedded_once(spark, tmp_path):
    calls = str(tmp_path)

    def embed(texts):
        import os
        import uuid

        open(os.path.join(calls, uuid.uuid4().hex), "w").close()
        return [[1.0, 0.0] for _ in texts]

    df = spark.createDataFrame([(f"g{g}", c, "f", "abc", [1.0, float(c)]) for g in range(6) for c in range(3)], "g string, chunk_idx long, file_path string, name string, embedding array<float>")
    rows = nearest.find_by_name(df, ["g"], ["nowhere"], 1, embed=embed).collect()
    assert len(rows) == 6 and len(list(tmp_path.iterdir())) == 1


CHUNK = st.fixed_dictionaries({
    "file_path": st.sampled_from(["a.py", "dir/b.js"]), "start_line": st.integers(1, 99), "name": st.sampled_from(["", "f", "Klass"]),
    "content": st.integers(0, 900).map(lambda n: "é" * n),
})
SCORED = st.tuples(CHUNK, st.floats(0, 1, width=32)).map(lambda p: {**p[0], "score": p[1]})


@QUICK
@given(st.lists(st.tuples(st.lists(SCORED, max_size=5), st.lists(CHUNK, max_size=3)), min_size=20, max_size=30))
def test_context_text(spark, cases):
    fields = "file_path:string,start_line:int,name:string,content:string"
    rows = [(i, similar, related) for i, (similar, related) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"id int, similar array<struct<{fields},score:float>>, related array<struct<{fields}>>")
    got = context.with_context_text(df, max_tokens=250).orderBy("id").collect()
    for row, (similar, related) in zip(got, cases):
        assert row.context == models.context_text(similar, related, 1000)


@QUICK
@given(st.lists(st.one_of(st.floats(0, 2), st.integers(0, 10**6).map(lambda n: n / 1000 * 0.00125), st.integers(0, 999).map(lambda n: n / 1000 + 0.0005)), min_size=50, max_size=200))
def test_rounding_like_python(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    rows = df.select("id", *[round_half_even(F.col("x"), d).alias(f"r{d}") for d in (2, 3, 6)]).orderBy("id").collect()
    assert [(r.r2, r.r3, r.r6) for r in rows] == [(round(v, 2), round(v, 3), round(v, 6)) for v in values]


def test_index_repositories(spark, tmp_path):
    files = [("r", 0, "a.py", "x = 1"), ("r", 1, "b.py", " \n"), ("r", 2, "c.md", "text"), ("r", 3, "d.go", "\n" * 31 + "func Run() {")]
    df = spark.createDataFrame(files, "repo string, file_ord long, file_path string, content string")
    rows = indexing.index_repositories(df, letter_counts, str(tmp_path), 26).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.file_path, r.language, r.chunk_type, r.name) for r in rows] == [
        (0, "a.py", "python", "file", "a.py"), (1, "d.go", "go", "function", "Run")]
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)
