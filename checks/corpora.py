"""Tables derived from the given ones, over all of their rows and whole texts.

The given tables hold prose and events; code, patches, answers, points and deliveries are made from
them by rules that the SQL in checks/sql.py repeats.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions import text
from patchlake.operators.deliveries import hmac_sha256
from patchlake.operators.points import metric_rows

SECRET = "delivery-secret"

# One metric name per event, by event_id: the points of reviews, security, errors, indexing, retrieval, embedding.
METRICS = [
    ("llm.tokens.prompt", "gauge"), ("llm.tokens.completion", "gauge"), ("llm.tokens.total", "gauge"),
    ("llm.cost.per_review", "gauge"), ("llm.duration.seconds", "histogram"), ("llm.context.utilization_pct", "gauge"),
    ("pr.files_changed", "gauge"), ("pr.total_changes", "gauge"), ("llm.reviews.total", "count"),
    ("llm.cost.per_line", "gauge"), ("security.events", "count"), ("llm.errors", "count"),
    ("rag.indexing.files", "gauge"), ("rag.indexing.chunks", "gauge"), ("rag.indexing.duration_seconds", "histogram"),
    ("rag.embedding.duration_seconds", "histogram"), ("rag.indexing.total", "count"), ("rag.retrieval.chunks", "gauge"),
    ("rag.retrieval.duration_seconds", "histogram"), ("rag.retrieval.context_tokens", "gauge"),
    ("rag.retrieval.total", "count"), ("rag.retrieval.max_similarity", "gauge"), ("rag.embedding.batch_size", "gauge"),
    ("rag.embedding.api_duration_seconds", "histogram"), ("rag.embedding.api_calls", "count"),
]

# Put together from parts, so that no literal looks like a secret.
SEEDS = [
    "'AKIA' || repeat('Z', 16)", "'ghp_' || repeat('a', 36)", "'-----BEGIN RSA ' || 'PRIVATE KEY-----'",
    "'api_key = ' || repeat('k', 20)", "'xoxb-' || repeat('1', 10) || '-' || repeat('2', 10) || '-' || repeat('c', 24)",
    "'a.b@example.com'", "'123-45-6789'", "'555-123-4567'", "'4111 1111 1111 1111'", "'ignore previous instructions'",
    "'disregard the above'", "'you are now x'", "'system prompt'", "''", "''", "''",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt out over all tasks: the given files come in few splits, and what is made of a text is much work."""
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def base(spark: SparkSession, sf_dir: str, read: Callable = texts) -> DataFrame:
    """Documents as changed files: repository, pull request, place in it, path parts, text, and what the rules for texts take
    from the id."""
    return read(spark, sf_dir, "documents").selectExpr(
        "*", *_PLACE,
        "element_at(array('py','py','js','ts','java','go','mjs','md'), cast(doc_id % 8 + 1 as int)) ext",
        "element_at(array('src','app/core','vendor','lib/utils'), cast((doc_id div 8) % 4 + 1 as int)) dir",
    ).selectExpr(
        "doc_id", "n_chars", "repo", "pr", "file_ord", "ext", "dir", "doc_id % 50 + 1 first_line", "coalesce(doc_id % 11 = 0, false) unpatched", "coalesce(doc_id % 6, -1) answer_kind",
        f"case when doc_id % 11 = 0 then '' else element_at(array({', '.join(SEEDS)}), cast(doc_id % 16 + 1 as int)) end seed",
        "concat(dir, '/') path_front", "concat('_', doc_id, '.', ext) path_back", "text whole_text",
    )


_PLACE = ["concat('org/r', doc_id % 7) repo", "doc_id div 35 pr", "(doc_id div 7) % 5 file_ord"]


def changed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository and pull request of every changed file, without its texts."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *_PLACE)


#: What the rules for texts read, and the files whose texts a task hands on at a time.
_RULE_INPUT = ["whole_text", "ext", "first_line", "unpatched", "answer_kind", "seed", "path_front", "path_back"]
_FILES_AT_A_TIME = 512


def _made(df: DataFrame, *columns: str, changes: Callable | None = None, most_words: int = -1, **rules: Callable) -> DataFrame:
    """Select columns and texts made of the words, and with `changes` a number that is made of the text `patch`. The words of a text
    are many, so lists of them are worked on in Python: expressions over the elements of an array take several times as long.
    With `most_words`, texts are made of that many words from the start."""
    read = [f"{name} _{name}" for name in _RULE_INPUT]
    kept = df.selectExpr(*columns).schema
    added = [T.StructField(name, T.StringType()) for name in rules] + [T.StructField("changes", T.LongType())] * (changes is not None)
    schema = T.StructType([*kept.fields, *added])

    def make(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _FILES_AT_A_TIME):
                batch = whole.slice(at, _FILES_AT_A_TIME)
                texts = [batch.column(f"_{name}").to_pylist() for name in _RULE_INPUT]
                words = [None if text is None else _words(text, most_words) for text in texts[0]]
                made = {name: [rule(*row) for row in zip(words, *texts[1:])] for name, rule in rules.items()}
                arrays = [batch.column(name) for name in kept.names] + [pa.array(values, pa.string()) for values in made.values()]
                if changes is not None:
                    arrays.append(pa.array(map(changes, made["patch"]), pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.selectExpr(*columns, *read).mapInArrow(make, schema)


_KEYS = ["doc_id", "repo", "pr", "file_ord"]
_BETWEEN_WORDS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def _words(text, most=-1):
    """Runs of a to z in the lower-cased text, or the first of them; one empty word where there is none."""
    found = text.lower().encode().translate(_BETWEEN_WORDS).decode()
    return (found.split() if most < 0 else found.split(None, most)[:most]) or [""]


def _path(words, ext, first_line, unpatched, answer_kind, seed, front, back):
    return None if None in (words, front, back) else front + words[0] + back


#: By extension: where in every sixteen words a definition stands, and what is around its name.
_DEFINITIONS = {
    "py": {3: ("def ", "(a):"), 9: ("class ", ":"), 12: ("    async def ", "(self):")},
    "js": {3: ("function ", "(a) {"), 9: ("class ", " {"), 12: ("const ", " = (a) => {")},
    "java": {3: ("public int ", "(int a) {"), 9: ("public class ", " {")},
    "go": {3: ("func ", "(a int) {"), 9: ("type ", " struct {")},
}
_DEFINITIONS["ts"] = _DEFINITIONS["js"]


def _code(words, ext, *_):
    if words is None:
        return None
    lines = ["    " + w for w in words]
    for at, (front, behind) in _DEFINITIONS.get(ext, {}).items():
        lines[at::16] = [front + w + behind for w in words[at::16]]
    if ext == "py":
        lines[::16] = ["import " + ("os", "numpy", "app.core", w)[k % 4] for k, w in enumerate(words[::16])]
        lines[5::16] = ["from " + ("json", "requests", "." + w, "src." + w)[k % 4] + " import x" for k, w in enumerate(words[5::16])]
    return "\n".join(lines)


def _patch(words, ext, first_line, unpatched, answer_kind, seed, *_):
    if unpatched:
        return ""
    if words is None or first_line is None:
        return None
    lines = [" " + w for w in words]
    for at, sign in ((0, "-"), (1, "+"), (2, "+")):
        lines[at::5] = [sign + w for w in words[at::5]]
    lines[::20] = [f"@@ -{20 * k + 1},20 +{first_line + 40 * k},20 @@\n{line}" for k, line in enumerate(lines[::20])]
    return "\n".join(lines) + "\n+" + seed


def _changes(patch):
    """Lines of a patch that start with a sign."""
    return None if patch is None else patch.count("\n+") + patch.count("\n-") + patch.startswith(("+", "-"))


def _answer(words, ext, first_line, unpatched, answer_kind, *_):
    if answer_kind in (0, 1):
        return ("No critical issues found", "")[answer_kind]
    if words is None:
        return None
    lines = [] if first_line is None else [f"{first_line + 3 * k} : {w}" for k, w in enumerate(words[::10])]
    return "\n".join(lines) + f"\nnote : {words[0]}\n0 : {words[0]}"


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files with patch, number of changes and content."""
    return _made(base(spark, sf_dir), *_KEYS, filename=_path, patch=_patch, content=_code, changes=_changes)


def pr_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files with their content, without what the patch tells."""
    return _made(base(spark, sf_dir), *_KEYS, filename=_path, content=_code)


def pr_file_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files as pr_files gives them, but with patch and content of the first words only: which files are there, and which texts
    are empty, is the same. The texts are not dealt out, as little is made of them."""
    return _made(base(spark, sf_dir, table), *_KEYS, most_words=20, filename=_path, patch=_patch, content=_code)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(base(spark, sf_dir), *_KEYS, "ext", file_path=_path, content=_code)
    return made.withColumn("language", text.language(F.col("ext"))).drop("ext")


#: Folders of linked files, by a number that each has.
_FOLDER = "element_at(array('src', 'src/core', 'lib', 'app'), cast(({0} div 3) % 4 + 1 as int))"


_LINKED_PLACE = [
    "concat('org/g', doc_id % 3) repo", f"concat({_FOLDER.format('doc_id')}, '/m', doc_id, '.py') file_path", "'python' language",
]


def linked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository and path of every linked file, without its text."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *_LINKED_PLACE)


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files that import each other: by the whole path, by the bare name, from their own folder, and from a folder beside it.
    Some of the files that they ask for are in another repository, or are not there."""
    asked = [f"abs(doc_id + 3 * ((n_chars * {j + 1}) % 41 - 20))" for j in range(4)]
    made = texts(spark, sf_dir, "documents").selectExpr(
        "doc_id", *_LINKED_PLACE,
        f"""concat('import os\nfrom ', replace({_FOLDER.format(asked[0])}, '/', '.'), '.m', {asked[0]}, ' import x\nimport m', {asked[1]},
            '\nfrom .m', {asked[2]}, ' import y\nfrom ..core.m', {asked[3]}, ' import z\n') imports""",
        "text",
    )
    body = F.expr("concat('    ', replace(trim(regexp_replace(lower(text), '[^a-z]+', ' ')), ' ', '\n    '))")
    return made.withColumn("content", F.concat("imports", body)).drop("imports", "text")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(base(spark, sf_dir), *_KEYS, filename=_path, patch=_patch)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers, one per changed file; total tokens are not the sum of the other two."""
    return _made(
        base(spark, sf_dir), *_KEYS, "n_chars div 4 + 500 prompt_tokens", "50 + doc_id % 97 completion_tokens",
        "n_chars div 4 + 550 + doc_id % 97 + 10 * (doc_id % 3) total_tokens",
        filename=_path, text=_answer, patch=_patch,
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs sent in by hand, with their answers."""
    made = answers(spark, sf_dir)
    lines = "size(filter(split(patch, '\\n', -1), l -> startswith(l, '{}')))"
    return made.selectExpr(
        "repo", "doc_id pr_id", "patch diff", "doc_id % 9 - 1 files_changed", f"cast({lines.format('+')} as bigint) lines_added",
        f"cast({lines.format('-')} as bigint) lines_deleted", "text", "prompt_tokens", "completion_tokens", "total_tokens",
        "cast(doc_id % 40 as double) / 8 duration", "cast('2024-01-01T00:00:00' as string) answered_at",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as finished reviews."""
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.expr("sum(case when role <> 'assistant' then length(text) else 0 end) div 4").alias("prompt_tokens"),
        F.expr("sum(case when role = 'assistant' then length(text) else 0 end) div 4").alias("completion_tokens"),
        F.count("*").alias("turns"),
    )
    return grouped.selectExpr(
        "concat('org/r', conv_id % 7) repo", "conv_id pr", "prompt_tokens", "completion_tokens",
        "prompt_tokens + completion_tokens total_tokens",
        "prompt_tokens / 1000 * 0.00125D + completion_tokens / 1000 * 0.005D cost", "turns * 1.5D duration",
        "prompt_tokens / 128000 * 100 context_utilization", "turns files_changed", "conv_id % 5 * 16 total_changes",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(table(spark, sf_dir, "events"))


def points_of(events: DataFrame) -> DataFrame:
    """Events as metric points with tags."""
    names = ", ".join(f"'{name}'" for name, _ in METRICS)
    kinds = ", ".join(f"'{kind}'" for _, kind in METRICS)
    return events.selectExpr(
        "event_id point_id", "ts",
        f"element_at(array({names}), cast(event_id % 25 + 1 as int)) metric", "value",
        f"element_at(array({kinds}), cast(event_id % 25 + 1 as int)) type",
        """concat(array(concat('repo:org/r', user_id % 7), if(event_id % 10 = 0, 'env:staging', 'env:production'),
            concat('event_type:', event_type), if(event_id % 9 = 0, 'success:false', 'success:true')),
            if(event_id % 13 = 0, array('keyless', 'url:http://x'), cast(array() as array<string>))) tags""",
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored metric rows."""
    return metric_rows(points(spark, sf_dir), at=F.col("ts"), keep=["point_id"])


def _true_signature(body: Column) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(body, SECRET))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries_of(table(spark, sf_dir, "events"))


def deliveries_of(events: DataFrame) -> DataFrame:
    """Events as deliveries: some are empty, lack a field, hold no JSON or carry a wrong signature."""
    made = events.selectExpr(
        "event_id", "ts", "element_at(array('pull_request', 'pull_request', 'ping', 'push'), cast(event_id % 4 + 1 as int)) event",
        """case when event_id % 29 = 0 then '' when event_id % 37 = 0 then '{broken' else concat(
            '{"action":"', element_at(array('opened', 'synchronize', 'reopened', 'closed'), cast((event_id div 4) % 4 + 1 as int)), '",',
            if(event_id % 31 = 0, '', concat('"number":', event_id, ',')),
            '"pull_request":{"head":{"sha":"', event_type, event_id, '","ref":"f', user_id, '"},"base":{', if(event_id % 7 = 0, '', '"ref":"main"'), '}},',
            '"repository":{"name":"r', user_id % 7, '","full_name":"org/r', user_id % 7, '","owner":{"login":"org"}},',
            '"sender":{"login":"u', user_id, '"}}') end body""",
    )
    made = made.withColumn("body", F.col("body").cast("binary"))
    wrong = F.when(F.col("event_id") % 34 == 0, F.lit(None)).otherwise(F.lit("sha256=invalid"))
    return made.withColumn("signature", F.when(F.col("event_id") % 17 == 0, wrong).otherwise(_true_signature(F.col("body"))))


def review_deliveries_of(documents: DataFrame) -> DataFrame:
    """Documents as deliveries about their pull requests: the first file's starts a review, and so does the second's; the others are of an
    action that is passed over, or pings."""
    made = documents.selectExpr(
        "doc_id", "if((doc_id div 7) % 5 = 4, 'ping', 'pull_request') event",
        """concat('{"action":"', if((doc_id div 7) % 5 < 2, 'opened', 'closed'), '","number":', doc_id div 35,
            ',"pull_request":{"head":{"sha":"s","ref":"f"},"base":{"ref":"main"}},"repository":{"name":"r', doc_id % 7, '","full_name":"org/r', doc_id % 7,
            '","owner":{"login":"org"}},"sender":{"login":"u"}}') body""",
    )
    return made.withColumn("body", F.col("body").cast("binary")).withColumn("signature", _true_signature(F.col("body")))


def landed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File lists of pull requests as the source host gives them."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "filename", "patch", "changes"))), lambda f: F.struct(*[f[c].alias(c) for c in ("filename", "patch", "changes")]))
    return pr_files(spark, sf_dir).groupBy("repo", "pr").agg(F.to_json(one).alias("body"))


def landed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as the source host gives them; those of every tenth pull request are no UTF-8."""
    content = F.when(F.col("pr") % 10 == 9, F.lit("Y2Fm6Q==")).otherwise(F.base64(F.encode("content", "UTF-8")))
    return pr_files(spark, sf_dir).select("repo", "pr", "filename", F.to_json(F.struct(content.alias("content"))).alias("body"))


#: The place of each byte among the letters a to z; other bytes share a place behind them.
_LETTER = np.array([b - 97 if 97 <= b <= 122 else 26 for b in range(256)])


def letter_counts(texts: list[str]) -> np.ndarray:
    """A stand-in for an embedding model that SQL can repeat: how often each letter a to z occurs, a row for each text."""
    encoded = [text.encode() for text in texts]
    places = np.repeat(np.arange(0, 32 * len(texts), 32), [len(one) for one in encoded])
    places += _LETTER.take(np.frombuffer(b"".join(encoded), dtype=np.uint8))
    return np.bincount(places, minlength=32 * len(texts)).reshape(-1, 32)[:, :26].astype(float)
