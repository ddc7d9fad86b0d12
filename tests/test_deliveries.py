import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from patchlake.operators import deliveries
from patchlake.sources import landed
from patchlake.streaming import deliveries as stream

SECRET = "s3cr3t"
SCHEMA = "id int, event string, signature string, body binary"


def sign(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def payload(**changes):
    full = {"action": "opened", "number": 5, "pull_request": {"head": {"sha": "abc", "ref": "f"}, "base": {}},
            "repository": {"name": "r", "full_name": "o/r", "owner": {"login": "o"}}, "sender": {"login": "u"}}
    full.update(changes)
    return json.dumps({k: v for k, v in full.items() if v is not None}).encode()


CASES = [
    ("pull_request", payload(), True, ("processing", 200, "PR review started", 5)),
    ("pull_request", payload(action="closed"), True, ("skipped", 200, "Action 'closed' not handled", 5)),
    ("push", payload(), True, ("skipped", 200, "Event type 'push' not handled", None)),
    (None, payload(), True, ("skipped", 200, "Event type 'None' not handled", None)),
    ("ping", b"{}", True, ("ok", 200, "Pong! Webhook configured successfully", None)),
    ("pull_request", b"", False, ("ok", 200, "Empty body received", None)),
    ("pull_request", payload(), "sha256=invalid", ("rejected", 401, "Invalid signature", None)),
    ("pull_request", payload(), False, ("rejected", 401, "Invalid signature", None)),
    ("pull_request", payload(number=None), True, ("rejected", 400, "Invalid payload", None)),
    ("pull_request", payload(sender="x"), True, ("rejected", 400, "Invalid payload", None)),
    ("pull_request", payload(action=3), True, ("rejected", 400, "Invalid payload", None)),
    ("pull_request", b'{"action": "closed", ' + payload()[1:-1] + b', "sender": {}}', True, ("processing", 200, "PR review started", 5)),  # the last of two counts
    ("pull_request", b"{nope", True, ("rejected", 400, "Invalid payload", None)),
]


def frame(spark):
    rows = []
    for i, (event, body, signed, _) in enumerate(CASES):
        signature = sign(body) if signed is True else (signed or None)
        rows.append((i, event, signature, bytearray(body)))
    return spark.createDataFrame(rows, SCHEMA)


def test_routes(spark):
    rows = deliveries.route(frame(spark), SECRET).orderBy("id").collect()
    assert [(r.status, r.code, r.message, r.pr_number) for r in rows] == [case[3] for case in CASES]


def test_projection_fills_missing_fields(spark):
    rows = deliveries.project(deliveries.with_payload(frame(spark)), ["id"]).orderBy("id").collect()
    first = rows[0]
    assert (first.owner, first.repo_name, first.full_repo, first.head_sha, first.head_ref, first.base_ref) == ("o", "r", "o/r", "abc", "f", "")


def test_hmac_like_python(spark):
    bodies = [b"", b"abc", bytes(range(256)), "é".encode() * 100]
    for secret in ("k", "x" * 64, "long" * 40):
        df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "id int, body binary")
        rows = df.select("id", deliveries.hmac_sha256(F.col("body"), secret).alias("h")).orderBy("id").collect()
        assert ["sha256=" + r.h for r in rows] == [sign(b, secret) for b in bodies]
    assert not df.select(deliveries.signature_ok(F.col("body"), F.lit("x"), "")).first()[0]


def test_landed_sources(spark):
    listing = json.dumps([{"filename": "a.py", "patch": "+x", "changes": 2}, {"filename": "b.png"}])
    rows = landed.changed_files(spark.createDataFrame([("o/r", listing)], "repo string, body string"), ["repo"]).orderBy("file_ord").collect()
    assert [(r.file_ord, r.filename, r.patch, r.changes) for r in rows] == [(0, "a.py", "+x", 2), (1, "b.png", None, 0)]
    encoded = base64.encodebytes("é = 1\n".encode() * 30).decode()
    bodies = [("a.py", json.dumps({"content": encoded})), ("b.py", '{"message": "Not Found"}')]
    found = landed.file_contents(spark.createDataFrame(bodies, "filename string, body string"), []).orderBy("filename").collect()
    assert [(r.content, r.error_type) for r in found] == [("é = 1\n" * 30, None), (None, None)]
    odd = [(base64.b64encode(b"caf\xe9").decode(), "UnicodeDecodeError"), ("YWJjZ", "binascii.Error"), (base64.b64encode(bytes(range(256))).decode(), "UnicodeDecodeError"), ("", None)]
    frame_ = spark.createDataFrame([(str(i), json.dumps({"content": c})) for i, (c, _) in enumerate(odd)], "filename string, body string")
    found = landed.file_contents(frame_, []).orderBy("filename").collect()
    assert [r.error_type for r in found] == [e for _, e in odd] and [r.content for r in found] == [None, None, None, ""]


def test_stream_equals_batch(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "in"))
    arriving = stream.read_landing(spark, str(tmp_path / "in"), frame(spark).schema, files_per_batch=1)
    stream.write_routed(arriving, str(tmp_path / "out"), str(tmp_path / "check"), SECRET, once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.status, r.code, r.message, r.pr_number) for r in rows] == [case[3] for case in CASES]
