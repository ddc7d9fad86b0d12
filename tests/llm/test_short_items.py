"""Short test items, looked for between word borders, against all ranges of words; blocks of items."""

import random

from patchlake.llm import decontamination as dec
from patchlake.llm.decontamination import normal_form


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain(item, body, budget):
    """The least (distance, end, start) of all ranges of words within the budget."""
    words, ends, at = body.split(), [], 0
    for w in words:
        ends.append((at, at + len(w)))
        at += len(w) + 1
    found = []
    for i in range(len(words)):
        for j in range(i, min(len(words), i + len(item.split()) + budget + 1)):
            s, e = ends[i][0], ends[j][1]
            if abs(e - s - len(item)) <= budget and (d := distance(item, body[s:e])) <= budget:
                found.append((d, e, s))
    return min(found, default=None)


def test_items_of_3_to_40_characters():
    r = random.Random(6)
    letters = "abcdé"
    hits = 0
    for _ in range(150):
        items = [(k, " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 7)))) for k in range(8)]
        items = [(k, t) for k, t in items if 3 <= len(t) < 40]
        matcher = dec.Matcher(items, 0.1, 40)
        parts = []
        for _ in range(6):
            text = list(r.choice(items)[1]) if items and r.random() < 0.7 else list("".join(r.choice(letters + "  ") for _ in range(r.randint(1, 30))))
            if r.random() < 0.5 and text:
                text[r.randrange(len(text))] = r.choice(["", "x", " ", "aa"])
            parts.append("".join(text))
        body = normal_form(r.choice([" ", ""]).join(parts) + " tail")
        got = {m["item_id"]: m for m in matcher.matches(body)}
        for k, text in items:
            text = normal_form(text)
            want = plain(text, body, int(0.1 * len(text)))
            assert (k in got) == (want is not None), (text, body, want)
            if want:
                hits += 1
                d, end, start = want
                assert (got[k]["distance"], got[k]["start_word"], got[k]["end_word"]) == (d, body.count(" ", 0, start), body.count(" ", 0, end) + 1)
    assert hits > 200


def test_a_question_in_a_text(spark):
    benchmark = spark.createDataFrame([(1, "What is the capital of France?"), (2, "yes"), (3, "?!"), (4, "")], "item_id long, text string")
    texts = ["Quiz. What is the  capital of FRANCE? Paris.", "What is the capitol of France", "yesterday", "say yes", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: [(m.item_id, m.distance) for m in x.matches] for x in dec.matched(df, "text", benchmark).collect()}
    assert found == {0: [(1, 0)], 1: [(1, 1)], 2: [], 3: [(2, 0)], 4: [], 5: []}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(r.choice([2, 12])))) for k in range(12)]
    rows = [(i, " ".join([word(), r.choice(items)[1], word(), r.choice(items)[1]])) for i in range(20)] + [(20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return {x.doc_id: sorted(m.item_id for m in x.matches) for x in dec.matched(df, "text", benchmark).collect()}

    whole = found()
    assert all(whole[i] for i in range(20))
    monkeypatch.setattr(dec, "CHARS_PER_PASS", 250)
    assert found() == whole
