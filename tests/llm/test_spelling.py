"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from patchlake.llm import spelling
from patchlake.llm.queries import slips


def plain_variants(words, ratio=10):
    close = {w: [v for v in words if spelling.near(w, v)] for w in words}
    best = {w: min(near, key=lambda v: (-words[v], v), default=None) for w, near in close.items()}
    form = {w: f if f is not None and words[f] >= ratio * words[w] else None for w, f in best.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("chunk", [512, 7])
def test_variants(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    r = random.Random(chunk)
    words = {"".join(r.choice("abcdeéÿ") for _ in range(r.randint(3, 6))): r.choice([2, 3, 20, 30, 250, 3000, 40000]) for _ in range(500)}
    words |= {"x" * 300: 5, "x" * 301: 60, "x" * 150 + "y" + "x" * 149: 700, "z" * 3000: 2}
    df = spark.createDataFrame([*words.items(), (None, 7)], "word string, n long")
    made = spelling.variants(df)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, made.collect())) == plain_variants(words)
    assert spelling.variants(df.limit(0)).count() == 0


def test_edits():
    assert [spelling.near("abc", x) for x in ("abc", "abd", "ab", "abcd", "xabc", "bca", "abcde", "", "ac")] == [False, True, True, True, True, False, False, False, True]


def plain_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            seen[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return sorted((w, n) for w, n in seen.items() if len(w) >= 7 and n >= 2)


def test_counts(spark):
    r = random.Random(2)
    words = ["Straßenbahn", "ÀÉÎõüÿabc", "telephone", "Telephone", "teleĀphonetic", "division÷sign", "short", "x" * 2000]
    rows = [(r.choice([None, *range(300)]), r.choice([" ", ".", "1"]).join(r.choice(words) for _ in range(30))) for _ in range(200)]
    rows += [(1, None), (2, ""), (None, None), rows[0], rows[0]]
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, text string, n int, word string")
    made = spelling.word_counts(df, "doc_id", "text", change=slips)
    assert sorted(map(tuple, made.collect())) == plain_counts(rows)
    plain = Counter(w for _, t in rows for w in spelling.words_of(t or "", 9))
    assert dict(map(tuple, spelling.word_counts(df, "doc_id", "text", least_length=9, least_count=1).collect())) == plain
    assert spelling.word_counts(df.limit(0), "doc_id", "text").count() == 0
