"""Removal of repeated spans against a plain version that holds every window."""

import random

import pytest

from patchlake.llm import substring_dedup as dedup

SCHEMA = "doc_id long, text string, rid int, words int, doc string"


def plain(rows, window):
    texts = [(dedup.LAST if k is None else k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in texts:
        for i in range(len(w) - window + 1):
            first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), (k, i)), (k, i))
    out = []
    for (k, w), (key, _) in zip(texts, rows):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (k, i):
                gone[i : i + window] = [True] * window
        out.append((key, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def made_up(seed):
    r = random.Random(seed)
    words = ["a", "b", "é", "ç"] + [f"w{i}" for i in range(r.choice([3, 30, 300]))]
    passages = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(8)]
    rows = []
    for i in range(70):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.6 else [r.choice(words) for _ in range(r.randint(0, 30))]
            if r.random() < 0.2 and w:
                w[r.randrange(len(w))] = f"z{r.randint(0, 3)}"
        rows.append((r.choice([i, i, i, 3, None]), r.choice([" ", "\n", "\x0b \t", "   "]).join(w)))
    # null and empty texts, repeated rows, copies, one word over and over
    return rows + [(5, None), (None, None), (7, ""), (8, " \n"), rows[0], rows[0], (200, rows[3][1]), (201, rows[3][1]), (1, "x " * 500), (2, "x " * 90)]


@pytest.mark.parametrize(("seed", "window", "short"), [(0, 6, 2), (1, 4, 1), (2, 20, 8)])
def test_against_every_window(spark, seed, window, short):
    rows = made_up(seed)
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)
    made = dedup.deduplicated(df, "doc_id", "text", window, short)
    assert made.columns == ["key", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, made.collect()), key=str) == plain(rows, window)


def test_empty_table_and_one_very_long_text(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup.deduplicated(df, "doc_id", "text").count() == 0
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, "y " + " ".join(words[150_000:150_100])), (3, "x" * 1_000_000)]
    df = spark.createDataFrame([(*x, 1, 2, "z") for x in rows], SCHEMA)
    made = {x.key: (x.n_words, x.n_removed, len(x.kept)) for x in dedup.deduplicated(df, "doc_id", "text").collect()}
    assert made == {1: (300_000, 0, len(rows[0][1])), 2: (101, 100, 1), 3: (1, 0, 1_000_000)}
