from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlake.operators import answers, diffs, reviews
from patchlake.plans import review
from tests import models

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PIECES = ["@@ -1,2 +3,4 @@", "@@ -1 +9 @@ def f", "x @@ -1 +2 @@", "+a", "-b", " c", "", "+++ b/f", "--- a/f", "\\ No newline", "@@ -a +b @@", "@@ -1,1 +10,1 @@"]


@QUICK
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("\n".join), min_size=40, max_size=80))
def test_diff_lines(spark, patches):
    df = spark.createDataFrame(list(enumerate(patches)), "id int, patch string")
    got = {i: set() for i in range(len(patches))}
    for row in diffs.diff_lines(df, ["id"]).collect():
        assert row.line not in got[row.id]
        got[row.id].add(row.line)
    assert got == {i: models.diff_lines(p) for i, p in enumerate(patches)}


def test_answers(spark):
    patch = "@@ -1,1 +5,2 @@\n+a\n b"
    texts = ["5 : one\n\n  6: two \n7 : off\n0 : zero\nnote", "LGTM\n5 : x", "This looks good overall", "", None, "\n5x\n"]
    df = spark.createDataFrame([(i, t, patch, "f.py") for i, t in enumerate(texts)], "id int, text string, patch string, filename string")
    rows = answers.comment_rows(answers.with_comments(df), ["id"]).orderBy("id", "pos").collect()
    assert [(r.id, r.path, r.line, r.body, r.side) for r in rows] == [
        (0, "f.py", 5, "5 : one", "RIGHT"), (0, "f.py", 6, "6: two", "RIGHT"), (5, "f.py", 5, "5x", "RIGHT")]
    free = answers.comment_rows(answers.with_comments(df, patch=None), ["id"]).where("id = 0").orderBy("pos").collect()
    assert [r.line for r in free] == [5, 6, 7]
    every = answers.answer_lines(df, ["id"]).where("id = 0").orderBy("pos").collect()
    assert [r.line for r in every] == [5, 6, 7, 0, None]


def pull_request(spark):
    rows = [
        ("o/r", 1, 0, "a.py", "@@ -1 +1 @@\n+x", 2, "x"), ("o/r", 1, 1, "b.md", "@@ -1 +1 @@\n+x", 3, None),
        ("o/r", 1, 2, "c.py", "", 4, "x"), ("o/r", 1, 130, "d.py", "@@ -1 +1 @@\n+a@b.co", 5, "y"), ("o/r", 2, 0, "e.PY", "+x", 7, "z"),
    ]
    return spark.createDataFrame(rows, "repo string, pr long, file_ord long, filename string, patch string, changes long, content string")


def test_rollup_and_bodies(spark):
    files = pull_request(spark)
    assert sorted(r.filename for r in reviews.eligible_files(files).collect()) == ["a.py", "d.py"]
    answered = [("o/r", 1, 0, "a.py", "@@ -1 +1 @@\n+x", "1 : bug", 1000, 100, 1150), ("o/r", 1, 130, "d.py", "@@ -1 +1 @@\n+x", "1 : two\n1 : three", 3000, 200, 3200)]
    reviewed = spark.createDataFrame(answered, "repo string, pr long, file_ord long, filename string, patch string, text string, prompt_tokens long, completion_tokens long, total_tokens long")
    one, two = reviews.pr_rollup(files, reviewed).orderBy("pr").collect()
    assert (one.files_changed, one.total_changes, one.files_reviewed) == (4, 14, 2)
    assert (one.prompt_tokens, one.completion_tokens, one.total_tokens) == (4000, 350, 4350)
    assert abs(one.cost - 0.0065) < 1e-12 and abs(one.context_utilization - 2.34375) < 1e-12
    assert (two.files_changed, two.files_reviewed, two.total_tokens, two.cost) == (1, 0, 0, 0.0)
    commented = answers.with_comments(reviewed)
    heads = {r.pr: (r.n_comments, r.body) for r in reviews.review_headlines(files, commented).collect()}
    assert heads == {1: (3, "AI Code Review - 3 issue(s) found"), 2: (0, "✅ **AI Code Review**: No critical issues found. LGTM!")}
    parts = reviews.fallback_bodies(commented).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2]
    assert "".join(p.body for p in parts) == "## 🤖 AI Code Review\n\n**a.py**: 1 : bug\n\n**d.py**: 1 : two\n\n**d.py**: 1 : three\n\n"


def test_security_events_and_errors(spark):
    events = review.security_events(pull_request(spark)).collect()
    assert [(e.repo, e.pr, e.filename, e.type) for e in events] == [("o/r", 1, "d.py", "pii_email")]

    def generate(prompt):
        if "bad" in prompt:
            raise TimeoutError
        return prompt.upper(), 1, 2, 3

    asked = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    rows = reviews.generate_answers(asked, generate).orderBy("id").collect()
    assert [(r.text, r.total_tokens, r.error_type) for r in rows] == [("GOOD", 3, None), (None, None, "TimeoutError")]


def test_request_records(spark):
    rows = [("o/r", 1, "a@b.co", 1, 2, 3, "fine", 2, 0, 2, 0.25, "t"), ("o/r", 2, "x", -1, 2, 3, "", 1, 1, 2, 0.1, "t"), ("o/r", 3, "x", None, 2, 3, "", 1, 1, 2, 0.1, "t")]
    names = "repo string, pr_id long, diff string, files_changed long, lines_added long, lines_deleted long, text string, prompt_tokens long, completion_tokens long, total_tokens long, duration double, answered_at string"
    (row,) = reviews.request_records(reviews.valid_requests(spark.createDataFrame(rows, names))).collect()
    assert row.cost_usd == round(2 / 1000 * 0.00125, 6) and row.duration_ms == 250 and row.pr_complexity == 5
    assert [i.type for i in row.security_issues] == ["pii_email"]


def test_prompts(spark):
    df = pull_request(spark).where("filename = 'a.py'").withColumn("content", F.repeat(F.lit("z"), 60000))
    own = reviews.Headings("# context", "# file", "# content", "# patch", "# diff")
    with_context = df.withColumn("context", F.lit("CTX")).select(reviews.file_prompt("SYS", own)).collect()[0][0]
    assert with_context == f"SYS\n\n# context\nCTX\n\n\n# file\na.py\n\n# content\n{'z' * 50000}\n\n# patch\n@@ -1 +1 @@\n+x\n"
    without = df.withColumn("context", F.lit("")).select(reviews.file_prompt("SYS")).collect()[0][0]
    assert without.startswith(f"SYS\n\n{reviews.HEADINGS.file}\na.py")
