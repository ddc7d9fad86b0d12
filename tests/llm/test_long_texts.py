"""No text may kill a job or make it stall: long texts of one broken thing over and over."""

import random
import time

import pytest

from patchlake.llm import html_extraction, pii

PAGES = {
    "tags without end": "<a " * 330_000, "declarations": "<!" * 500_000, "ends of a script": "<script>" + "</script " * 100_000, "depth": "<div>x" * 150_000,
    "depth by name": "<div class='ad'>x" * 50_000, "unmatched ends": "<div>" * 100_000 + "</p>x" * 100_000, "quotes": "<a \"" * 250_000, "both quotes": "<a '\"" * 200_000,
    "one line": "<p>x</p>\n" * 100_000, "pictures": "<svg>" * 200_000, "references": "&amp" * 200_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    began = time.process_time()
    html_extraction.lines(PAGES[name])
    assert time.process_time() - began < 5


def test_alignment_of_repeated_lines():
    began = time.process_time()
    n = 15_000
    a, b = html_extraction.common_lines([1] * n + [3] + [1, 2] * n, [1] * n + [2] + [1] * n)
    assert len(a) == len(b) == 2 * n
    assert time.process_time() - began < 5


def test_alignment_is_longest():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, r.choice([1, 3, 9])) for _ in range(r.randint(0, 25))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        i, j = html_extraction.common_lines(a, b)
        assert len(i) == table[-1][-1] and [a[k] for k in i] == [b[k] for k in j] and i == sorted(set(i)) and j == sorted(set(j))


def test_personal_data(spark):
    n = 50_000
    texts = {
        "domain": "x a@" + "a." * n + "1 ", "domain with an end": "x a@" + "a." * n + "com ", "ats": "a@" * n, "dots": "." * n, "hyphens": "-" * n, "digits": "1" * n, "digits apart": "1 " * n,
        "blanks": " " * n, "quotes": "\"'" * n, "plus": "+1 " * n, "capitals": "A" * n, "brackets": "(0" * n, "token": "token=" * (n // 3), "labels": "a.b." * n,
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    made = {x.name: x for x in pii.pseudonymised(df, "text", "key").collect()}
    assert {k for k, x in made.items() if x.entities} == {"domain with an end"}
    assert all(len(made[k].text) == len(t) for k, t in texts.items())
    small = spark.createDataFrame([(x,) for x in ("mail a.b@example.com.", "x@y.co9 z", "a@b..com", "a@b", "a.b@c-d.e-f.org, q")], "text string")
    assert [len(x.entities) for x in pii.pseudonymised(small, "text", "key").collect()] == [1, 1, 0, 0, 1]
