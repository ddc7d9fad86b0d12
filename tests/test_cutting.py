"""Files cut by the places of their definitions, against the definitions that expressions find line by line."""

import random

import numpy as np
from pyspark.sql import functions as F

from checks.corpora import letter_counts
from patchlake.functions import text
from patchlake.operators import batches, chunks, definitions

PIECES = [
    "def ", "class ", "async ", "function ", "const ", "= (", "(", " ", "\t", "\x1c", "\x85", "\xa0", "　", "\r", "name", "é", "ก็", "²", "Ⓐ", "‍", "‿", "_x9",
    "func ", "type ", " struct", "interface ", "public ", "int ", "\n", "\n", "\n", "𝒳", "字", "٣", "Ⅷ", "ͅ",
]
LANGUAGES = ["python", "javascript", "typescript", "java", "go", "ruby", None]


def test_lines_of_all_languages(spark):
    r = random.Random(4)
    rows = [(i, "src/a.x" if i % 9 else None, r.choice(LANGUAGES), None if i % 40 == 1 else "".join(r.choices(PIECES, k=r.choice([0, 5, 200, 500])))) for i in range(600)]
    files = spark.createDataFrame(rows, "id long, file_path string, language string, content string")
    found = {}
    for x in definitions.definition_rows(files, ["id"]).collect():
        found.setdefault(x.id, []).append((x.line, x.type, x.name))
    finder = definitions.LineFinder()
    for i, _, language, content in rows:
        if content is not None:
            assert sorted((line, kind, name) for line, _, kind, name, _ in finder(content, language)) == sorted(found.get(i, []))
    cut = chunks.function_chunks(files, ["id"]).withColumn("file_path", F.lit("p")).withColumns({
        "made": text.tokens(text.truncate(chunks.embedding_text())), "counted": chunks.embedding_tokens()}).collect()
    assert all(x.made == x.counted for x in cut)
    source = {i: (language, content) for i, _, language, content in rows}
    for x in cut:
        language, content = source[x.id]
        if content is None:
            assert language not in definitions.LineFinder().rows and x.end_line is None
        elif x.chunk_type != "file":
            assert x.content == "\n".join(content.split("\n")[x.start_line - 1 : x.end_line])[:5000]
            assert x.name == "imports" or (x.start_line, x.chunk_type, x.name) in found[x.id]
    assert len({x.id for x in cut}) == sum(1 for language, content in source.values() if content is not None or language not in finder.rows)


def test_a_model_may_give_a_matrix(spark):
    rows = [(g, i, i // 3, "abz" * i + "Ée") for g in ("x", None) for i in range(8)]
    df = spark.createDataFrame(rows, "g string, pos long, batch long, _text string")
    assert isinstance(letter_counts(["a"]), np.ndarray)
    assert letter_counts(["az{`", "", "éb"]).tolist() == [[float(c in have) for c in "abcdefghijklmnopqrstuvwxyz"] for have in ("az", "", "b")]
    for unit in (False, True):
        as_lists, as_matrix = (
            {(x.g, x.pos): (x.batch, x.embedding, x.embed_ok) for x in batches.embed_batches(df, ["g"], "pos", model, 26, unit=unit).collect()}
            for model in (lambda texts: letter_counts(texts).tolist(), letter_counts)
        )
        assert as_lists == as_matrix and len(as_lists) == 16
