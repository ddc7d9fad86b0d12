"""Named queries over the given tables, one or more per operator."""

import os
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import checks
import patchlake
from checks import corpora
from patchlake.functions import tags, text
from patchlake.functions.frames import saved
from patchlake.operators import (
    answers, batches, chunks, context, definitions, deliveries, diffs, import_graph, imports, nearest, partials, points, reviews, rollups,
    scan, skew,
)
from patchlake.plans import dashboard, indexing, review
from patchlake.sources import files, landed, points_table, windows_table
from patchlake.streaming import deliveries as delivery_stream
from patchlake.streaming import reviews as review_stream
from patchlake.streaming import rollup as rollup_stream

# Functions that run in Python workers travel with their code, so the packages need not be installed there.
cloudpickle.register_pickle_by_value(patchlake)
cloudpickle.register_pickle_by_value(checks)

FILE = ["doc_id"]
PR = ["repo", "pr"]
LETTERS = 26
SYSTEM = "Review this change. Answer with one issue per line."
MODEL = "model-1"
NAMES = ["Imports", "the", "ation", "zq"]


# Security scan

def _document_issues(spark, sf, kinds=scan.KINDS):
    return scan.issue_rows(corpora.texts(spark, sf, "documents"), "text", FILE, kinds)


def security_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return scan.count_issues(_document_issues(spark, sf))


def security_issues_documents(spark, sf):
    return _document_issues(spark, sf)


def security_issues_pages(spark, sf):
    return scan.issue_rows(corpora.texts(spark, sf, "pages"), "html", ["page_id"])


def security_issues_conversations(spark, sf):
    return scan.issue_rows(corpora.texts(spark, sf, "conversations"), "text", ["conv_id", "turn"])


def security_issues_patches(spark, sf):
    return scan.issue_rows(corpora.patches(spark, sf), "patch", FILE)


def secrets(spark, sf):
    return scan.issue_rows(corpora.patches(spark, sf), "patch", FILE, ("secret",))


def personal_data(spark, sf):
    return scan.issue_rows(corpora.patches(spark, sf), "patch", FILE, ("pii",))


def prompt_injection(spark, sf):
    return scan.issue_rows(corpora.patches(spark, sf), "patch", FILE, ("prompt_injection",))


def security_events(spark, sf):
    return review.security_events(corpora.pr_files(spark, sf)).drop("ord")


def request_security_events(spark, sf):
    return review.request_security_events(reviews.valid_requests(corpora.requests(spark, sf))).drop("ord")


# Metric points

def _stable(made: DataFrame) -> DataFrame:
    """Doubles to twelve significant digits, as sums of doubles differ in the last ones with the order of rows."""
    rounded = {c: F.when(F.col(c).isNotNull(), F.format_string("%.11e", c).cast("double")) for c, kind in made.dtypes if kind == "double"}
    return made.withColumns(rounded)


def _flat(made: DataFrame) -> DataFrame:
    return made.withColumn("tags", F.array_join("tags", "|"))


def points_review(spark, sf):
    return _flat(points.review_points(corpora.reviews(spark, sf), MODEL, "webhook"))


def points_security(spark, sf):
    return _flat(points.security_points(review.security_events(corpora.pr_files(spark, sf)), "webhook"))


def points_error(spark, sf):
    errors = corpora.table(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "event_id", "concat('E', user_id % 5) error_type", "concat('org/r', user_id % 7) repo", "user_id pr"
    )
    return _flat(points.error_points(errors, "_experiment", keep=["event_id"]))


def points_indexing(spark, sf):
    changed = _changed(spark, sf)
    runs = indexing.index_runs(changed, _chunk_table(spark, changed))
    return _flat(points.indexing_points(runs.withColumn("duration", F.col("chunks_created") * 0.25)))


def points_retrieval(spark, sf):
    found = _retrieved(spark, sf).where("has_index").withColumns(context.retrieval_stats())
    found = found.withColumns({"duration": F.lit(0.25), "max_similarity": F.round("max_similarity", 4)})
    return _flat(points.retrieval_points(found))


def points_embedding(spark, sf):
    calls = batches.embedding_calls(_embedded(spark, sf), PR)
    return _flat(points.embedding_points(calls.withColumn("duration", F.col("batch_size") * 0.25), keep=[*PR, "batch"]))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit("="), t["value"])), "|"))


def metric_rows(spark, sf):
    return _pairs(corpora.rows(spark, sf))


def metric_rows_selected(spark, sf):
    return _pairs(rollups.select_rows(corpora.rows(spark, sf), repo="org/r3", env="production")).drop("service", "env")


def metric_rows_with_tag(spark, sf):
    return _pairs(rollups.rows_with_tag(corpora.rows(spark, sf), "success", "false")).drop("service", "env")


def stored_points_by_day(spark, sf):
    """Rows appended to the table, and read back for ten days and one repository."""
    path = f"{scratch(spark)}/points"
    points_table.append(corpora.rows(spark, sf), path)
    found = rollups.select_rows(points_table.read(spark, path, "2024-01-10", "2024-01-19"), repo="org/r3")
    counted = found.groupBy(F.col("event_date").cast("string").alias("event_date"), "metric_name")
    return _stable(counted.agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def _states(spark, sf):
    """States of all points by the hour, appended to a table as points are."""
    path = f"{scratch(spark)}/states"
    points_table.append(partials.hourly(corpora.rows(spark, sf)), path)
    return path


def rollup_from_states(spark, sf):
    """The rollup by type from stored states, without the percentiles, which are checked by state_percentiles."""
    states = points_table.read(spark, _states(spark, sf)).withColumn("repo", tags.value_of(F.col("tags"), "repo"))
    return _stable(partials.by_type(states, ["repo"], "1 day").drop("p50", "p95"))


def state_percentiles(spark, sf):
    """Whether the percentiles of the sketches are within the stated share of ranks of the points, by metric and day."""
    states = points_table.read(spark, _states(spark, sf)).where("metric_type = 'histogram'")
    made = partials.by_type(states, [], "1 day").select("metric_name", "bucket", "p50", "p95")
    rows = corpora.rows(spark, sf).where("metric_type = 'histogram'").withColumn("bucket", F.window("timestamp", "1 day")["start"])

    def fits(name, share):
        below, upto = (F.avg(F.when(x, 1).otherwise(0)) for x in (F.col("value") < F.col(name), F.col("value") <= F.col(name)))
        return ((below <= share + partials.RANK_ERROR) & (upto >= share - partials.RANK_ERROR)).alias(f"{name}_fits")

    return rows.join(made, ["metric_name", "bucket"]).groupBy("metric_name", "bucket").agg(F.count("*").alias("n"), fits("p50", 0.5), fits("p95", 0.95))


RANGE = ("2024-01-10", "2024-01-19")


def _stored_widget(name, **chosen):
    def query(spark, sf):
        return _stable(dashboard.stored_widget(name, spark, _states(spark, sf), *RANGE, **chosen))

    return query


def rollup_by_type(spark, sf):
    rows = corpora.rows(spark, sf).withColumn("repo", tags.value_of(F.col("tags"), "repo"))
    return _stable(rollups.by_type(rows, ["repo"], "1 day"))


def _widget(name):
    def query(spark, sf):
        return _stable(dashboard.WIDGETS[name](corpora.rows(spark, sf)))

    return query


# Code files

def file_filter(spark, sf):
    path = F.col("filename")
    return corpora.pr_files(spark, sf).select(
        "doc_id", "filename", text.extension(path).alias("extension"), text.is_skipped_path(path).alias("skipped"),
        text.is_indexed_path(path).alias("indexed"), text.is_reviewed_path(path).alias("reviewed"),
        text.language(text.extension(path)).alias("language"),
    )


def decoded_files(spark, sf):
    """Every second document arrives as Latin-1, and all with carriage returns."""
    raw = corpora.table(spark, sf, "documents").selectExpr(
        "doc_id",
        """case when doc_id % 2 = 0 then encode(replace(text, '\\n', '\\r\\n'), 'UTF-8')
            else encode(replace(regexp_replace(text, '[^\\\\x00-\\\\xff]', '?'), '\\n', '\\r'), 'ISO-8859-1') end content""",
    )
    return files.decode_files(raw)


def tree_files(spark, sf):
    """Code files written as a tree of files, and read back without going into skipped folders."""
    path = scratch(spark)
    local = path.removeprefix("file://").removeprefix("file:")

    def write(batches):
        for batch in batches:
            for name, content in zip(batch["file_path"], batch["content"]):
                os.makedirs(os.path.dirname(f"{local}/tree/{name}"), exist_ok=True)
                with open(f"{local}/tree/{name}", "w", newline="") as file:
                    file.write(content)
            yield batch[["file_path"]]

    written = corpora.code_files(spark, sf).select("file_path", "content").mapInPandas(write, "file_path string")
    saved(written, f"{path}/written")
    return files.read_pruned_tree(spark, path + "/tree", "org/tree", f"{path}/levels")


def local_modules(spark, sf):
    return imports.local_modules(corpora.code_files(spark, sf), ["repo"])


def _imports(spark, sf):
    found = imports.import_rows(corpora.code_files(spark, sf), ["doc_id", "repo"])
    return imports.classify(found, local_modules(spark, sf), ["repo"])


def classified_imports(spark, sf):
    return _imports(spark, sf)


def _by_type(spark, sf):
    return imports.imports_by_type(_imports(spark, sf), FILE)


def imports_by_type(spark, sf):
    joined = {
        kind: F.array_join(F.transform(kind, lambda i: i["raw_import"]), ",") for kind in ("local", "stdlib", "third_party")
    }
    return _by_type(spark, sf).withColumns(joined)


def import_edges(spark, sf):
    return import_graph.import_edges(corpora.linked_files(spark, sf), ["repo"], folder=scratch(spark))


def reverse_imports(spark, sf):
    return import_graph.importers(import_edges(spark, sf), ["repo"])


def affected_files(spark, sf):
    """What a change of every fiftieth file reaches."""
    changed = corpora.linked_paths(spark, sf).where("doc_id % 50 = 0").select("repo", "file_path")
    return import_graph.affected_files(import_edges(spark, sf), changed, ["repo"], scratch(spark))


def definition_rows(spark, sf):
    return definitions.definition_rows(corpora.code_files(spark, sf), FILE)


def file_summaries(spark, sf):
    facts = definitions.file_facts(corpora.code_files(spark, sf), [*FILE, "repo", "file_path"])
    facts = saved(facts, f"{scratch(spark)}/facts")
    found = imports.import_rows(facts, ["doc_id", "repo"], F.col("imports"))
    classified = imports.classify(found, imports.local_modules(facts, ["repo"]), ["repo"])
    return definitions.file_summaries(facts, imports.imports_by_type(classified, FILE), FILE)


def chunks_function(spark, sf):
    return chunks.function_chunks(corpora.code_files(spark, sf), FILE)


def chunks_code(spark, sf):
    return chunks.code_chunks(corpora.code_files(spark, sf), FILE, max_lines=12, overlap=3)


def chunks_fixed(spark, sf):
    return chunks.fixed_chunks(corpora.code_files(spark, sf), FILE)


def _changed(spark, sf):
    """Changed files as a table, for queries that read them more than once."""
    return saved(corpora.pr_files(spark, sf), f"{scratch(spark)}/changed")


def _chunk_table(spark, changed):
    files = changed.withColumn("file_path", F.col("filename"))
    return indexing.chunk_table(indexing.fetched_files(files), PR, scratch(spark))


def chunk_numbers(spark, sf):
    numbered = _chunk_table(spark, corpora.pr_files(spark, sf))
    return numbered.select(*PR, "file_path", "chunk_ord", "chunk_idx", "chunk_type", "name", "language")


def file_to_chunks(spark, sf):
    return chunks.file_to_chunks(_chunk_table(spark, corpora.pr_files(spark, sf)), PR)


def embedding_texts(spark, sf):
    numbered = _chunk_table(spark, corpora.pr_files(spark, sf))
    return numbered.select(*PR, "chunk_idx", chunks.embedding_text().alias("embedding_text"))


# Vectors and context

def token_estimates(spark, sf):
    return corpora.table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("n_tokens"))


def truncated_texts(spark, sf):
    return corpora.table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text")).alias("text"))


def token_batches(spark, sf):
    cut = corpora.table(spark, sf, "documents").select("lang", "doc_id", text.tokens(text.truncate(F.col("text"))).alias("n_tokens"))
    numbered = saved(skew.with_position(cut, ["lang"], "doc_id", "pos"), f"{scratch(spark)}/numbered")
    return batches.token_batches(numbered, ["lang"], "pos", "n_tokens")


def normalized_vectors(spark, sf):
    vectors = nearest.normalized(corpora.table(spark, sf, "embeddings"))
    return vectors.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def _vectors(spark, sf):
    return corpora.table(spark, sf, "embeddings").selectExpr(
        "vec_id query_idx", "vec_id chunk_idx", "concat('file', label) file_path", "embedding"
    )


def _scored(found):
    return found.withColumn("score", F.round(F.col("score").cast("double"), 4))


def nearest_vectors(spark, sf):
    both = _vectors(spark, sf)
    return _scored(nearest.nearest(both, both, [], k=5))


def nearest_vectors_other_file(spark, sf):
    both = _vectors(spark, sf)
    return _scored(nearest.nearest(both, both, [], k=5, exclude_own_file=True))


def _embedded(spark, sf, changed=None):
    """The index of changed files, which come as a table, as it reads them twice."""
    changed = saved(corpora.pr_contents(spark, sf), f"{scratch(spark)}/contents") if changed is None else changed
    return indexing.index_pull_requests(changed, corpora.letter_counts, scratch(spark), LETTERS)


def embedded_chunks(spark, sf):
    top = F.array_position("embedding", F.array_max("embedding"))
    return _embedded(spark, sf).select(*PR, "chunk_idx", "batch", "embed_ok", F.size("embedding").alias("size"), top.alias("top_letter"))


def _review_files(spark, sf, changed=None):
    changed = corpora.pr_files(spark, sf) if changed is None else changed
    return reviews.eligible_files(changed).withColumn("file_path", F.col("filename"))


def _retrieved(spark, sf):
    changed = _changed(spark, sf)
    return review.retrieve(_review_files(spark, sf, changed), _embedded(spark, sf, changed), corpora.letter_counts, scratch(spark))


def similar_chunks(spark, sf):
    found = _retrieved(spark, sf).select(*PR, "file_ord", F.inline("similar"))
    return _scored(found.select(*PR, "file_ord", "rank", "chunk_idx", "score"))


def related_chunks(spark, sf):
    return context.related_chunks(_chunk_table(spark, corpora.pr_files(spark, sf))).select(*PR, "file_path", "chunk_idx", "name")


def query_texts(spark, sf):
    return corpora.pr_files(spark, sf).select("doc_id", context.query_text(F.col("patch"), F.col("content")).alias("query"))


def context_texts(spark, sf):
    return _retrieved(spark, sf).select("doc_id", "context")


def retrieval_stats(spark, sf):
    found = _retrieved(spark, sf).withColumns(context.retrieval_stats())
    return found.select("doc_id", "chunks_retrieved", "context_tokens", F.round("max_similarity", 4).alias("max_similarity"))


def chunks_by_name(spark, sf):
    found = nearest.find_by_name(_embedded(spark, sf), ["repo", "pr"], NAMES, embed=corpora.letter_counts)
    return _scored(found)


# Reviews

def diff_lines(spark, sf):
    return diffs.diff_lines(corpora.patches(spark, sf), FILE)


def answer_lines(spark, sf):
    return answers.answer_lines(corpora.answers(spark, sf), FILE)


def comments_on_diff(spark, sf):
    return answers.comment_rows(answers.with_comments(corpora.answers(spark, sf)), FILE)


def comments_without_diff(spark, sf):
    return answers.comment_rows(answers.with_comments(corpora.answers(spark, sf), patch=None), FILE)


def eligible_files(spark, sf):
    return reviews.eligible_files(corpora.pr_files(spark, sf)).select("doc_id", "filename", "changes")


def files_with_contents(spark, sf):
    changed = corpora.pr_files(spark, sf)
    contents = changed.where("doc_id % 3 <> 0").select(*PR, "filename", "content")
    return reviews.attach_contents(changed.drop("content"), contents, PR).select("doc_id", "filename", "content")


def review_costs(spark, sf):
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    return corpora.answers(spark, sf).select(
        "doc_id", reviews.cost(prompt, completion).alias("cost"), reviews.utilization(prompt).alias("context_utilization")
    )


def _reviewed(spark, sf):
    eligible = reviews.eligible_files(corpora.pr_file_starts(spark, sf)).select(*PR, "file_ord")
    return corpora.answers(spark, sf).join(eligible, [*PR, "file_ord"])


def pr_rollup(spark, sf):
    return _stable(reviews.pr_rollup(corpora.pr_files(spark, sf), _reviewed(spark, sf)))


def review_headlines(spark, sf):
    return reviews.review_headlines(corpora.pr_files(spark, sf), answers.with_comments(_reviewed(spark, sf)))


def fallback_bodies(spark, sf):
    return reviews.fallback_bodies(answers.with_comments(_reviewed(spark, sf)))


def file_prompts(spark, sf):
    plain = _review_files(spark, sf).withColumn("context", F.when(F.col("doc_id") % 2 == 0, "some context"))
    return plain.select("doc_id", reviews.file_prompt(SYSTEM).alias("prompt"))


def request_prompts(spark, sf):
    asked = reviews.valid_requests(corpora.requests(spark, sf))
    return asked.select("pr_id", reviews.request_prompt(SYSTEM).alias("prompt"))


def request_records(spark, sf):
    found = reviews.request_records(reviews.valid_requests(corpora.requests(spark, sf)))
    return found.withColumn("security_issues", F.array_join(F.transform("security_issues", lambda i: i["type"]), ","))


def _count_words(prompt: str) -> tuple[str, int, int, int]:
    """A stand-in for the model: fails on very short prompts, else answers with the number of lines."""
    lines = prompt.count("\n")
    if lines < 40:
        raise ValueError("too short")
    return f"{lines} : lines", lines, 1, lines + 1


def generated_answers(spark, sf):
    prompts = _review_files(spark, sf).withColumn("context", F.lit("")).select("doc_id", reviews.file_prompt(SYSTEM).alias("prompt"))
    return reviews.generate_answers(prompts, _count_words)


def pr_review_points(spark, sf):
    """All steps of a review, from changed files to points, with stand-in models."""
    changed = _changed(spark, sf)
    folder = scratch(spark)
    index = indexing.index_pull_requests(changed, corpora.letter_counts, folder, LETTERS)
    prompted = review.prompts(changed, index, corpora.letter_counts, SYSTEM, folder)
    answered = review.answered_files(prompted, _count_words, folder)
    durations = changed.groupBy(*PR).agg(F.count("*").cast("double").alias("duration"))
    return _stable(_flat(review.review_points(changed, answered, durations, MODEL)))


def _three_lines(prompt: str) -> tuple[str, int, int, int]:
    """A stand-in like the one above, whose answer has comments on three lines."""
    _, lines, completion, total = _count_words(prompt)
    return "\n".join(f"{n} : lines" for n in (1 + lines % 7, 20 + lines % 30, lines)), lines, completion, total


def _run(spark, sf):
    """One whole run. The contents of every tenth pull request can't be read."""
    places = corpora.changed_places(spark, sf)
    failed = places.where("pr % 10 = 9").select(*PR, F.lit("UnicodeDecodeError").alias("error_type")).distinct()
    return _review(corpora.pr_files(spark, sf), failed, scratch(spark), places)


def _review(changed, failed, folder, places=None):
    """`places` are (repo, pr) of the changed files, where these are no table from which to read them alone."""
    seconds = F.count("*").cast("double")
    durations = (changed if places is None else places).groupBy(*PR).agg(
        seconds.alias("duration"), (seconds * 0.25).alias("indexing_duration"), F.lit(0.25).alias("retrieval_duration")
    )
    return review.review_pull_requests(changed, durations, failed, corpora.letter_counts, _three_lines, SYSTEM, MODEL, folder, LETTERS)


def pr_review_all_points(spark, sf):
    """All points of a run but the measured seconds of embedding calls."""
    return _comparable(_run(spark, sf).points)


def _comparable(made):
    made = made.where("metric <> 'rag.embedding.api_duration_seconds'")
    rounded = F.when(F.col("metric") == "rag.retrieval.max_similarity", F.round("value", 4)).otherwise(F.col("value"))
    return _stable(_flat(made.withColumn("value", rounded)))


def pr_review_comments(spark, sf):
    return _run(spark, sf).comments


def pr_review_bodies(spark, sf):
    return _run(spark, sf).headlines


def request_points(spark, sf):
    """Points of requests that were sent in by hand; their records are request_records."""
    return _stable(_flat(review.review_requests(corpora.requests(spark, sf), MODEL)[1]))


def repository_index(spark, sf):
    """The index of whole repositories, with files in the order of doc_id."""
    files = saved(corpora.code_files(spark, sf), f"{scratch(spark)}/files").withColumn("file_ord", F.col("doc_id"))
    index = indexing.index_repositories(files, corpora.letter_counts, scratch(spark), LETTERS)
    return index.select("repo", "file_path", "chunk_ord", "chunk_idx", "embed_ok")


# Deliveries

def deliveries_routed(spark, sf):
    routed = deliveries.route(corpora.deliveries(spark, sf), corpora.SECRET)
    return routed.select("event_id", "status", "code", "message", "pr_number")


def deliveries_routed_unsigned(spark, sf):
    return deliveries.route(corpora.deliveries(spark, sf)).select("event_id", "status", "code", "message", "pr_number")


def deliveries_projected(spark, sf):
    return deliveries.project(deliveries.with_payload(corpora.deliveries(spark, sf)), ["event_id"])


def signatures(spark, sf):
    found = corpora.deliveries(spark, sf)
    return found.select(
        "event_id", deliveries.hmac_sha256(F.col("body"), corpora.SECRET).alias("digest"),
        deliveries.signature_ok(F.col("body"), F.col("signature"), corpora.SECRET).alias("ok"),
    )


def landed_file_lists(spark, sf):
    """File lists of pull requests as JSON; the files of a request are five. Every third one has no patch."""
    listed = F.array_sort(F.collect_list(F.struct("file_ord", "doc_id", "filename", "patch")))
    one = F.transform(listed, lambda f: F.struct(
        f["filename"].alias("filename"), F.when(f["doc_id"] % 3 != 0, f["patch"]).alias("patch"), f["doc_id"].alias("changes")
    ))
    bodies = corpora.patches(spark, sf).groupBy(*PR).agg(F.to_json(one).alias("body"))
    return landed.changed_files(bodies, PR)


def landed_contents(spark, sf):
    """Some are missing, some are no UTF-8, some no base64."""
    bad = {1: "Y2Fm6Q==", 2: "Y2Fm6"}
    encoded = corpora.code_files(spark, sf).select(
        "doc_id", F.col("file_path").alias("filename"),
        F.when(F.col("doc_id") % 10 == 0, F.lit('{"message":"Not Found"}'))
        .when(F.col("doc_id") % 10 == 1, F.lit(f'{{"content":"{bad[1]}"}}'))
        .when(F.col("doc_id") % 10 == 2, F.lit(f'{{"content":"{bad[2]}"}}')).otherwise(
            F.to_json(F.struct(F.base64(F.encode("content", "UTF-8")).alias("content")))
        ).alias("body"),
    )
    return landed.file_contents(encoded, FILE)


# Streams

def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one that the cluster names. In local mode, where the driver is also the
    only executor, a temporary folder does where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/run-{os.urandom(8).hex()}"


def _event_stream(spark, sf):
    schema = corpora.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_rollup(spark, sf):
    path = scratch(spark)
    rows = points.metric_rows(corpora.points_of(_event_stream(spark, sf)), at=F.col("ts"))
    rolled = rollup_stream.windowed(rows, "1 day", "2 days", by="repo")
    rollup_stream.write_final(rolled, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return _stable(spark.read.schema(rolled.schema).parquet(f"{path}/out")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def stream_rollup_current(spark, sf):
    """All windows as they stand, final or not."""
    path, keys = scratch(spark), ["bucket", "metric_name", "repo"]
    rows = points.metric_rows(corpora.points_of(_event_stream(spark, sf)), at=F.col("ts"))
    rolled = rollup_stream.windowed(rows, "1 day", "2 days", by="repo")
    rollup_stream.write_current(rolled, f"{path}/out", f"{path}/checkpoint", keys, merge_every=1, once=True).awaitTermination()
    made = windows_table.current(spark, f"{path}/out", keys).drop("day")
    return _stable(made).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def stream_rollup_by_type(spark, sf):
    """The rollup by type of all windows as they stand, from one pass over the stream; without percentiles, as rollup_from_states."""
    path, keys = scratch(spark), ["bucket", "metric_name", "metric_type", "repo"]
    rows = points.metric_rows(corpora.points_of(_event_stream(spark, sf)), at=F.col("ts"), keep=["point_id"])
    rolled = rollup_stream.windowed_by_type(rows, "1 day", "2 days", by=["repo"])
    rollup_stream.write_current(rolled, f"{path}/out", f"{path}/checkpoint", keys, once=True).awaitTermination()
    made = partials.shown(windows_table.current(spark, f"{path}/out", keys), ["repo"]).drop("p50", "p95")
    return _stable(made).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def stream_deliveries(spark, sf):
    path = scratch(spark)
    arriving = corpora.deliveries_of(_event_stream(spark, sf))
    delivery_stream.write_routed(arriving, f"{path}/out", f"{path}/checkpoint", corpora.SECRET, once=True).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "status", "code", "message", "pr_number")


def stream_delivery_counts(spark, sf):
    """Deliveries, of which every fifth arrives twice, in sinks that a batch fills together."""
    path = scratch(spark)
    arriving = _event_stream(spark, sf).withColumn("time", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    arriving = delivery_stream.distinct_deliveries(arriving.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", "1 hour")
    delivery_stream.write_sinks(corpora.deliveries_of(arriving), path, f"{path}/checkpoint", corpora.SECRET, once=True).awaitTermination()
    counts = delivery_stream.read_sink(spark, path, "counts").groupBy("status", "code").agg(F.sum("n").alias("n"))
    logged = delivery_stream.read_sink(spark, path, "log").groupBy("status").agg(F.count("*").alias("logged"))
    return counts.join(logged, "status")


def _reviews_by_deliveries(spark, sf):
    path = scratch(spark)
    schema = corpora.table(spark, sf, "documents").select("doc_id").schema
    arriving = corpora.review_deliveries_of(spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parquet"))
    lists, contents = (saved(made, f"{path}/{name}") for made, name in ((corpora.landed_lists(spark, sf), "lists"), (corpora.landed_bodies(spark, sf), "contents")))
    review_stream.write_reviews(arriving, lists, contents, _review, path, f"{path}/checkpoint", corpora.SECRET, once=True).awaitTermination()
    return path


def stream_review_points(spark, sf):
    """The points of reviews that deliveries have started, from landed lists and contents."""
    return _comparable(delivery_stream.read_sink(spark, _reviews_by_deliveries(spark, sf), "points").drop("batch"))


def stream_review_comments(spark, sf):
    return delivery_stream.read_sink(spark, _reviews_by_deliveries(spark, sf), "comments").drop("batch")


QUERIES = {
    function.__name__: function
    for function in (
        security_by_type, security_issues_documents, security_issues_pages, security_issues_conversations,
        security_issues_patches, secrets, personal_data, prompt_injection, security_events, request_security_events,
        points_review, points_security, points_error, points_indexing, points_retrieval, points_embedding, metric_rows,
        metric_rows_selected, metric_rows_with_tag, stored_points_by_day, rollup_by_type, rollup_from_states, state_percentiles, file_filter, decoded_files, tree_files, local_modules,
        classified_imports, imports_by_type, import_edges, reverse_imports,
        affected_files, definition_rows, file_summaries, chunks_function, chunks_code, chunks_fixed,
        chunk_numbers, file_to_chunks, embedding_texts, token_estimates, truncated_texts, token_batches,
        normalized_vectors, nearest_vectors, nearest_vectors_other_file, embedded_chunks, similar_chunks, related_chunks,
        query_texts, context_texts, retrieval_stats, chunks_by_name, diff_lines, answer_lines, comments_on_diff,
        comments_without_diff, eligible_files, files_with_contents, review_costs, pr_rollup, review_headlines,
        fallback_bodies, file_prompts, request_prompts, request_records, generated_answers, pr_review_points,
        pr_review_all_points, pr_review_comments, pr_review_bodies, request_points, repository_index,
        deliveries_routed, deliveries_routed_unsigned, deliveries_projected, signatures, landed_file_lists,
        landed_contents, stream_rollup, stream_rollup_current, stream_rollup_by_type, stream_deliveries, stream_delivery_counts,
        stream_review_points, stream_review_comments,
    )
} | {f"dash_{name}": _widget(name) for name in dashboard.WIDGETS}

#: Widgets over the stored states of ten days: a number, a series, one by a tag, a running total, and one of a repository.
STORED = {"avg_cost": {}, "error_rate": {}, "security_by_type": {}, "cumulative_cost_by_repo": {}, "generation_time": {"repo": "org/r3", "env": "production"}}
QUERIES |= {f"stored_{name}": _stored_widget(name, **chosen) for name, chosen in STORED.items()}
