import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from patchlake import fixed
from patchlake.operators import scan

SAMPLES = [
    "AKIA" + "Z" * 16, "akia" + "z" * 16, "ghp_" + "a" * 36, "ghs_" + "a" * 35, "-----BEGIN RSA " + "PRIVATE KEY-----",
    "-----BEGIN\nPRIVATE KEY-----", "api_key = " + "k" * 20, "apikey" + "k" * 20, "xoxb-" + "1" * 10 + "-" + "2" * 10 + "-" + "c" * 24,
    "a.b@example.com", "a@b.c|", "é123-45-6789", "x 123-45-6789.", "5551234567", "4111 1111-11111111", "Ignore  ALL instruction",
    "ignore all of the instructions", "disregard what is above", "disregard\nabove", "new instruction: go", "system\tprompt", "",
]


def expected(text):
    return [f"{kind}_{name}" for kind, name, _, pattern in fixed.DETECTORS if re.search(pattern, text, re.IGNORECASE)]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    out = {i: [] for i in range(len(texts))}
    for row in scan.issue_rows(df, "body", ["id"]).orderBy("id", "ord").collect():
        out[row.id].append(row.type)
    return [out[i] for i in range(len(texts))]


def test_detectors_agree_with_python(spark):
    assert found(spark, SAMPLES) == [expected(text) for text in SAMPLES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(SAMPLES + [" ", "\n", "-", "é", "1"]), max_size=6).map("".join), min_size=30, max_size=60))
def test_detectors_on_mixed_text(spark, texts):
    assert found(spark, texts) == [expected(text) for text in texts]


def test_details_and_null_text(spark):
    df = spark.createDataFrame([(1, "system prompt, a@b.co"), (2, None)], "id int, body string")
    rows = scan.issue_rows(df, "body", ["id"]).orderBy("ord").collect()
    assert [(r.type, r.severity, r.details) for r in rows] == [
        ("pii_email", "medium", "Detected email"),
        ("prompt_injection_system_prompt", "medium", "Potential prompt injection: system prompt"),
    ]
