"""The named queries in DuckDB SQL, written on rows (unnest, joins, windows) rather than on arrays."""

from checks.corpora import METRICS, SECRET, SEEDS
from checks.queries import MODEL, NAMES, SYSTEM
from patchlake import fixed
from patchlake.operators.reviews import HEADINGS


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_quote(v) for v in values) + ")"


# Common table expressions by name, in the order in which they may use each other.
CTE = {
    "base": """select doc_id, n_chars, 'org/r' || (doc_id % 7) repo, doc_id // 35 pr, (doc_id // 7) % 5 file_ord,
        (['py','py','js','ts','java','go','mjs','md'])[doc_id % 8 + 1] ext,
        (['src','app/core','vendor','lib/utils'])[(doc_id // 8) % 4 + 1] dir,
        string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') ws from documents""",
    "words": """select doc_id, repo, pr, file_ord, ext, dir || '/' || ws[1] || '_' || doc_id || '.' || ext file_path,
        ws[1] first_word, unnest(ws) w, generate_subscripts(ws, 1) - 1 i from base""",
    "code_lines": """select *, case
        when ext = 'py' and i % 16 = 0 then 'import ' || (['os', 'numpy', 'app.core', w])[(i // 16) % 4 + 1]
        when ext = 'py' and i % 16 = 3 then 'def ' || w || '(a):'
        when ext = 'py' and i % 16 = 5 then 'from ' || (['json', 'requests', '.' || w, 'src.' || w])[(i // 16) % 4 + 1] || ' import x'
        when ext = 'py' and i % 16 = 9 then 'class ' || w || ':'
        when ext = 'py' and i % 16 = 12 then '    async def ' || w || '(self):'
        when ext in ('js', 'ts') and i % 16 = 3 then 'function ' || w || '(a) {'
        when ext in ('js', 'ts') and i % 16 = 9 then 'class ' || w || ' {'
        when ext in ('js', 'ts') and i % 16 = 12 then 'const ' || w || ' = (a) => {'
        when ext = 'java' and i % 16 = 3 then 'public int ' || w || '(int a) {'
        when ext = 'java' and i % 16 = 9 then 'public class ' || w || ' {'
        when ext = 'go' and i % 16 = 3 then 'func ' || w || '(a int) {'
        when ext = 'go' and i % 16 = 9 then 'type ' || w || ' struct {'
        else '    ' || w end line from words""",
    "code_files": """select doc_id, repo, pr, file_ord, ext, file_path, string_agg(line, chr(10) order by i) content,
        case ext when 'py' then 'python' when 'js' then 'javascript' when 'ts' then 'typescript' when 'java' then 'java'
            when 'go' then 'go' else 'unknown' end "language"
        from code_lines group by all""",
    "patches": f"""select doc_id, repo, pr, file_ord, file_path filename, case when doc_id % 11 = 0 then '' else
        string_agg(case when i % 20 = 0 then '@@ -' || (i + 1) || ',20 +' || (doc_id % 50 + 1 + 2 * i) || ',20 @@' || chr(10) else '' end
            || case i % 5 when 0 then '-' when 1 then '+' when 2 then '+' else ' ' end || w, chr(10) order by i)
        || chr(10) || '+' || ([{", ".join(SEEDS)}])[doc_id % 16 + 1] end patch from words group by doc_id, repo, pr, file_ord, file_path""",
    "patch_lines": """select doc_id, unnest(string_split(patch, chr(10))) line, generate_subscripts(string_split(patch, chr(10)), 1) pos
        from patches""",
    "pr_files": """select p.*, c.content, c.ext, coalesce(n.changes, 0) changes from patches p join code_files c using (doc_id)
        left join (select doc_id, count(*) changes from patch_lines where line like '+%' or line like '-%' group by 1) n using (doc_id)""",
    "eligible": f"""select * from pr_files where patch <> '' and content <> '' and ext in {_in(fixed.REVIEWED_EXTENSIONS)}""",
    "answers": """select b.doc_id, b.repo, b.pr, b.file_ord, p.filename, p.patch, case b.doc_id % 6 when 0 then 'No critical issues found' when 1 then '' else
        (select string_agg(b.doc_id % 50 + 1 + 3 * (w.i // 10) || ' : ' || w.w, chr(10) order by w.i) from words w where w.doc_id = b.doc_id and w.i % 10 = 0)
        || chr(10) || 'note : ' || b.ws[1] || chr(10) || '0 : ' || b.ws[1] end text,
        n_chars // 4 + 500 prompt_tokens, 50 + b.doc_id % 97 completion_tokens,
        n_chars // 4 + 550 + b.doc_id % 97 + 10 * (b.doc_id % 3) total_tokens from base b join patches p using (doc_id)""",
    "requests": """select a.repo, a.doc_id pr_id, a.patch diff, a.doc_id % 9 - 1 files_changed,
        (select count(*) from patch_lines l where l.doc_id = a.doc_id and line like '+%') lines_added,
        (select count(*) from patch_lines l where l.doc_id = a.doc_id and line like '-%') lines_deleted,
        text, prompt_tokens, completion_tokens, total_tokens, (a.doc_id % 40) / 8 duration, '2024-01-01T00:00:00' answered_at
        from answers a where a.doc_id % 9 >= 1""",
    "reviews": """select 'org/r' || (conv_id % 7) repo, conv_id pr, prompt_tokens, completion_tokens,
        prompt_tokens + completion_tokens total_tokens, prompt_tokens / 1000 * 0.00125::double + completion_tokens / 1000 * 0.005::double "cost",
        turns * 1.5::double duration, prompt_tokens / 128000 * 100 context_utilization, turns files_changed, conv_id % 5 * 16 total_changes
        from (select conv_id, sum(case when role <> 'assistant' then length(text) else 0 end)::bigint // 4 prompt_tokens,
            sum(case when role = 'assistant' then length(text) else 0 end)::bigint // 4 completion_tokens, count(*) turns
            from conversations group by conv_id)""",
    "points": f"""select event_id point_id, ts, ({_list(n for n, _ in METRICS)})[event_id % 25 + 1] metric, value,
        ({_list(k for _, k in METRICS)})[event_id % 25 + 1] "type",
        ['repo:org/r' || (user_id % 7), case when event_id % 10 = 0 then 'env:staging' else 'env:production' end,
            'event_type:' || event_type, case when event_id % 9 = 0 then 'success:false' else 'success:true' end]
        || case when event_id % 13 = 0 then ['keyless', 'url:http://x'] else [] end tags,
        'org/r' || (user_id % 7) repo, event_type, event_id % 9 <> 0 success, event_id % 10 <> 0 production, user_id, event_id from events""",
    # Definitions: every pattern over every line of its language.
    "defs": " union all ".join(
        f"""select doc_id, i + 1 line, {order} type_ord, '{kind}' "type", """
        + ("coalesce(nullif(regexp_extract(line, {0}, 1), ''), regexp_extract(line, {0}, 2))" if groups == [1, 2] else f"regexp_extract(line, {{0}}, {groups[0]})").format(_quote(pattern))
        + f' "name" from code_lines join code_files using (doc_id) where "language" = \'{language}\' and regexp_matches(line, {_quote(pattern)})'
        for language, patterns in fixed.DEFINITIONS.items()
        for order, (kind, pattern, groups) in enumerate(patterns)
    ).replace("from code_lines join code_files using (doc_id)", "from coded"),
    "sized": """select doc_id, repo, pr, file_ord, file_path, "language", content, string_split(content, chr(10)) lines,
        len(string_split(content, chr(10))) n_lines, (select count(*) from defs d where d.doc_id = c.doc_id) n_defs from code_files c""",
    "spans": """select s.doc_id, d.line start_line, coalesce(lead(d.line) over w - 1, s.n_lines) end_line, "type", "name",
        row_number() over w k, s.lines from sized s join defs d using (doc_id) window w as (partition by s.doc_id order by d.line, d.type_ord)""",
    "headers": """select s.doc_id, 1 start_line, f.start_line - 1 end_line, array_to_string(s.lines[1:f.start_line - 1], chr(10)) content
        from sized s join spans f on f.doc_id = s.doc_id and f.k = 1
        where f.start_line > 1 and regexp_matches(array_to_string(s.lines[1:f.start_line - 1], chr(10)), '\\S')""",
    "chunks": """select doc_id, row_number() over (partition by doc_id order by k) - 1 chunk_ord, * exclude (doc_id, k) from (
        select doc_id, 0 k, 1 start_line, n_lines end_line, 'file' chunk_type, regexp_extract(file_path, '[^/]*$') "name", content
            from sized where n_lines <= 30 or n_defs = 0
        union all select doc_id, 0, start_line, end_line, 'imports', 'imports', content from headers where doc_id in (select doc_id from sized where n_lines > 30)
        union all select doc_id, k, start_line, end_line, "type", "name",
            substring(case when end_line < start_line then '' else array_to_string(lines[start_line:end_line], chr(10)) end, 1, 5000)
            from spans where doc_id in (select doc_id from sized where n_lines > 30))""",
    "indexed": f"""select *, row_number() over (partition by repo, pr order by file_ord, chunk_ord) - 1 chunk_idx from (
        select c.*, f.repo, f.pr, f.file_ord, f.file_path, f."language" from chunks c join code_files f using (doc_id)
        where not list_has_any(string_split(f.file_path, '/'), {_list(fixed.SKIPPED_DIRS)}) and f.ext in {_in(fixed.INDEXED_EXTENSIONS)}
            and f.ext in {_in(fixed.REVIEWED_EXTENSIONS)} and f.content <> '')""",
    "chunk_texts": """select *, 'File: ' || file_path || chr(10) || case when "name" <> '' then chunk_type || ': ' || "name" || chr(10) else '' end
        || content embedding_text from indexed""",
}
_LETTERS = "list_transform(range(97, 123), lambda c: (length({0}) - length(replace({0}, chr(c::int), '')))::double)"
_UNIT = """(case when sqrt(list_dot_product({0}, {0})) > 0 then list_transform({0}, lambda x: (x / sqrt(list_dot_product({0}, {0})))::float) else {0}::float[] end)"""
CTE |= {
    "counted": f"select *, {_LETTERS.format('substring(embedding_text, 1, 8192)')} raw from chunk_texts",
    "vectors": f"select * exclude (raw), {_UNIT.format('raw')}::double[] v from counted",
    "asked": f"select doc_id, repo, pr, file_ord, filename, {_LETTERS.format('substring(patch, 1, 8192)')} raw from eligible",
    "queries": f"select * exclude (raw), {_UNIT.format('raw')}::double[] v from asked",
    "near": """select *, row_number() over w r from (select q.doc_id, q.repo, q.pr, q.file_ord, q.filename, c.chunk_idx, c.file_path,
            list_dot_product(q.v, c.v)::float score from queries q join vectors c using (repo, pr))
        window w as (partition by repo, pr, file_ord order by score desc, chunk_idx) qualify r <= 15""",
    "matches": """select *, row_number() over w "rank" from near where file_path <> filename
        window w as (partition by repo, pr, file_ord order by score desc, chunk_idx) qualify "rank" <= 5""",
    "related": "select * from indexed where chunk_ord < 3",
    "similar_pieces": """select s.doc_id, s."rank", '### ' || c.file_path || ':' || c.start_line || ' (' || c."name" || ') [similarity: '
            || printf('%.2f', s.score::double) || ']' || chr(10) || '```' || chr(10)
            || case when length(c.content) > 400 then substring(c.content, 1, 400) || chr(10) || '# ... (truncated)' else c.content end
            || chr(10) || '```' || chr(10) piece
        from matches s join indexed c using (repo, pr, chunk_idx) where s."rank" <= 3 and s.score >= 0.5""",
    "similar_fill": """select doc_id, coalesce(sum(length(piece)), 0) used, coalesce(string_agg(piece, '' order by "rank"), '') body from (
        select *, sum(length(piece)) over (partition by doc_id order by "rank") upto from similar_pieces) where upto <= 4200 group by doc_id""",
    "related_pieces": """select q.doc_id, c.chunk_ord, '### ' || c.file_path || ':' || c.start_line || ' (' || c."name" || ')' || chr(10) || '```' || chr(10)
            || case when length(c.content) > 300 then substring(c.content, 1, 300) || chr(10) || '# ... (truncated)' else c.content end
            || chr(10) || '```' || chr(10) piece, coalesce(f.used, 0) used
        from eligible q join indexed c on c.repo = q.repo and c.pr = q.pr and c.file_path = q.filename and c.chunk_ord < 2
        left join similar_fill f on f.doc_id = q.doc_id where coalesce(f.used, 0) < 5400""",
    "related_fill": """select doc_id, string_agg(piece, '' order by chunk_ord) body from (
        select *, used + sum(length(piece)) over (partition by doc_id order by chunk_ord) upto from related_pieces) where upto <= 6000 group by doc_id""",
    "contexts": """select e.doc_id, e.repo, e.pr, e.file_ord, coalesce(case when s.body is not null then '## Similar Code in Codebase' || chr(10) || s.body end
            || case when r.body is not null then chr(10) || '## Related Code' || chr(10) || r.body else '' end,
            '## Related Code' || chr(10) || r.body, '') context
        from eligible e left join similar_fill s using (doc_id) left join related_fill r using (doc_id)""",
    "stats": """select c.*, (select count(*) from matches s where s.doc_id = c.doc_id) + (select count(*) from related r join eligible e
                on e.repo = r.repo and e.pr = r.pr and e.filename = r.file_path where e.doc_id = c.doc_id) chunks_retrieved,
            length(context) // 4 context_tokens, coalesce((select max(score) from matches s where s.doc_id = c.doc_id), 0)::double max_similarity
        from contexts c""",
    "prompted": f"""select e.*, c.context, len(string_split({{prompt}}, chr(10))) - 1 n from eligible e join contexts c using (doc_id)""",
    # Commentable lines: number of lines that stay, counted from the hunk's start.
    "hunked": """select *, regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 1) start,
        not starts_with(line, '-') or starts_with(line, '---') stays from patch_lines""",
    "hunk_ids": "select *, count(*) filter (where start <> '') over (partition by doc_id order by pos) hunk from hunked",
    "diff_lines": """select distinct doc_id, line from (select doc_id, start, stays, max(case when start <> '' then start::bigint end) over (partition by doc_id, hunk)
            + count(*) filter (where stays and start = '') over (partition by doc_id, hunk order by pos) - 1 line, hunk from hunk_ids)
        where hunk > 0 and start = '' and stays""",
    "answer_rows": """select doc_id, pos - 1 pos, trim(body) body, try_cast(nullif(regexp_extract(trim(body), '^\\d+'), '') as bigint) line from (
        select doc_id, unnest(string_split(trim(text, ' ' || chr(10)), chr(10))) body, generate_subscripts(string_split(trim(text, ' ' || chr(10)), chr(10)), 1) pos
        from answers where text <> '' and not regexp_matches(text, 'no critical issues|lgtm|looks good', 'i')) where trim(body) <> ''""",
    "kept": "select r.* from answer_rows r semi join diff_lines d using (doc_id, line) where r.line <> 0",
    "reviewed": "select a.* from answers a semi join eligible e using (doc_id)",
    "index_batches": """select repo, pr, chunk_idx, length(substring(embedding_text, 1, 8192)) // 4 n from chunk_texts""",
    "walk": """select repo, pr, chunk_idx, 0::bigint batch, 1::bigint items, n from index_batches where chunk_idx = 0
        union all select b.repo, b.pr, b.chunk_idx, w.batch + (w.n + b.n > 12000 or w.items >= 250)::bigint,
            case when w.n + b.n > 12000 or w.items >= 250 then 1 else w.items + 1 end,
            case when w.n + b.n > 12000 or w.items >= 250 then b.n else w.n + b.n end
        from walk w join index_batches b on b.repo = w.repo and b.pr = w.pr and b.chunk_idx = w.chunk_idx + 1""",
    "embedding": """select v.repo, v.pr, v.chunk_idx, w.batch, len(v.v) size, list_position(v.v, list_max(v.v)) top_letter
        from vectors v join walk w using (repo, pr, chunk_idx)""",
    # Imports: one row per distinct path with its first place, pattern by pattern.
    "raw_imports": """select doc_id, repo, raw_import, row_number() over (partition by doc_id order by min(place)) - 1 pos from (
        select doc_id, repo, unnest(found) raw_import, generate_subscripts(found, 1) place from (select doc_id, repo,
            """ + " || ".join(f"regexp_extract_all(content, {_quote('(?m)' + p)}, 1)" for p in fixed.IMPORTS) + """ found
            from code_files where "language" = 'python')) group by doc_id, repo, raw_import""",
    "dotted": """select distinct repo, string_split(replace(replace(replace(file_path, '/', '.'), '\\', '.'), '.py', ''), '.') parts
        from code_files where file_path like '%.py'""",
    "modules": """select distinct repo, array_to_string(parts[i:], '.') module from (
        select repo, parts, unnest(range(1, len(parts) + 1)) i from dotted)""",
    "imports": f"""select *, case when is_relative then 'local' when module_name in {_in(fixed.STDLIB)} then 'stdlib'
            when lower(module_name) in {_in(fixed.KNOWN_PACKAGES)} then 'third_party'
            when exists (select 1 from modules m where m.repo = r.repo and m.module in (r.raw_import, r.module_name)) then 'local'
            else 'third_party' end import_type
        from (select *, ltrim(raw_import, '.') full_path, string_split(ltrim(raw_import, '.'), '.')[1] module_name,
            starts_with(raw_import, '.') is_relative from raw_imports) r""",
    "bodies": """select event_id, ts, event_type, user_id, (['pull_request', 'pull_request', 'ping', 'push'])[event_id % 4 + 1] event,
        case when event_id % 29 = 0 then '' when event_id % 37 = 0 then '{broken' else '{"action":"' || (['opened', 'synchronize', 'reopened', 'closed'])[(event_id // 4) % 4 + 1] || '",'
            || case when event_id % 31 = 0 then '' else '"number":' || event_id || ',' end
            || '"pull_request":{"head":{"sha":"' || event_type || event_id || '","ref":"f' || user_id || '"},"base":{' || case when event_id % 7 = 0 then '' else '"ref":"main"' end || '}},'
            || '"repository":{"name":"r' || (user_id % 7) || '","full_name":"org/r' || (user_id % 7) || '","owner":{"login":"org"}},'
            || '"sender":{"login":"u' || user_id || '"}}' end body from events""",
    "routed": """select *, case when body = '' then 'empty' when event_id % 17 = 0 and signed then 'signature' when event = 'ping' then 'ping' when event <> 'pull_request' then 'event'
            when not valid then 'payload' when action = 'closed' then 'action' else 'go' end rule
        from (select *, (['opened', 'synchronize', 'reopened', 'closed'])[(event_id // 4) % 4 + 1] action,
            event_id % 37 <> 0 and event_id % 31 <> 0 valid from bodies), (values (true), (false)) s(signed)""",
    "outcomes": """select event_id, signed, case rule when 'empty' then 'ok' when 'ping' then 'ok' when 'signature' then 'rejected' when 'payload' then 'rejected'
            when 'go' then 'processing' else 'skipped' end status, case rule when 'signature' then 401 when 'payload' then 400 else 200 end code,
        case rule when 'empty' then 'Empty body received' when 'signature' then 'Invalid signature' when 'ping' then 'Pong! Webhook configured successfully'
            when 'event' then 'Event type ''' || event || ''' not handled' when 'payload' then 'Invalid payload'
            when 'action' then 'Action ''' || action || ''' not handled' else 'PR review started' end message,
        case when rule in ('action', 'go') then event_id end pr_number from routed""",
}
_FULL_PROMPT = f"""{_quote(SYSTEM)} || chr(10) || case when context <> '' then {_quote(chr(10) + HEADINGS.context + chr(10))} || context || chr(10) || chr(10) else '' end
    || {_quote(chr(10) + HEADINGS.file + chr(10))} || filename || {_quote(chr(10) * 2 + HEADINGS.content + chr(10))} || substring(content, 1, 50000)
    || {_quote(chr(10) * 2 + HEADINGS.patch + chr(10))} || patch || chr(10)"""
_BARE_PROMPT = _FULL_PROMPT.replace("context <> ''", "false").replace("|| context ||", "|| '' ||")
CTE["prompted"] = CTE["prompted"].replace("{prompt}", "e_prompt").replace("e_prompt", _FULL_PROMPT)
CTE["stand_in"] = """select f.repo, f.pr, files_changed, total_changes, files_changed::double duration, coalesce(prompt_tokens, 0) prompt_tokens,
        coalesce(total_tokens, 0) - coalesce(prompt_tokens, 0) completion_tokens, coalesce(total_tokens, 0) total_tokens,
        coalesce(spent, 0) "cost", coalesce(context_utilization, 0) context_utilization
    from (select repo, pr, count(*) files_changed, sum(changes)::bigint total_changes from pr_files group by all) f
    left join (select repo, pr, sum(n)::bigint prompt_tokens, sum(n + 1)::bigint total_tokens,
        sum((n / 1000 * 0.00125::double + 1 / 1000 * 0.005::double)::double) spent, max(n / 128000 * 100) context_utilization
        from prompted where n >= 40 group by all) u on u.repo = f.repo and u.pr = f.pr"""
CTE["coded"] = 'select l.doc_id, l.i, l.line, f."language" from code_lines l join code_files f using (doc_id)'
# Later tables may be used by earlier ones here: "stand_in" goes last, "coded" before its user.
_ORDER = [name for name in CTE if name != "coded"]
_ORDER.insert(_ORDER.index("defs"), "coded")


def _with(body: str) -> str:
    """The CTEs that a query needs, directly or through others, in front of it."""
    import re

    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in needed and re.search(rf"\b(from|join) {name}\b", text):
                needed.add(name)
                todo.append(CTE[name])
    if not needed:
        return body
    recursive = "recursive " if "walk" in needed else ""
    return f"with {recursive}" + ",\n".join(f"{name} as ({CTE[name]})" for name in _ORDER if name in needed) + "\n" + body


def _issues(source: str, text: str, keys: str, kinds=("secret", "pii", "prompt_injection")) -> str:
    return " union all ".join(
        f"""select {keys}, {order}::int ord, '{kind}_{name}' "type", '{severity}' severity,
            '{fixed.DETAILS_PREFIX[kind]}{name.replace("_", " ")}' details from {source} where regexp_matches({text}, {_quote(pattern)}, 'i')"""
        for order, (kind, name, severity, pattern) in enumerate(fixed.DETECTORS)
        if kind in kinds
    )


def _points(source: str, values: list[tuple[str, str, str]], tags: str, keep: str = "") -> str:
    return " union all ".join(
        f"""select {keep} '{metric}' metric, ({value})::double "value", '{kind}' "type", {tags} tags from {source} where ({value}) is not null"""
        for metric, value, kind in values
    )


_TAGS = "'repo:' || repo || '|pr:' || pr || '{}|service:code-review|env:production{}'"
_REVIEW_VALUES = [
    ("llm.tokens.prompt", "prompt_tokens", "gauge"), ("llm.tokens.completion", "completion_tokens", "gauge"),
    ("llm.tokens.total", "total_tokens", "gauge"), ("llm.cost.per_review", '"cost"', "gauge"),
    ("llm.duration.seconds", "duration", "histogram"), ("llm.context.utilization_pct", "context_utilization", "gauge"),
    ("pr.files_changed", "files_changed", "gauge"), ("pr.total_changes", "total_changes", "gauge"), ("llm.reviews.total", "1", "count"),
    ("llm.cost.per_line", 'case when total_changes > 0 then "cost" / total_changes end', "gauge"),
]
_SUM = "sum(case when {} then value end)"
_AVG = "avg(case when {0} then value end)"
_PAIRS = """(select string_agg(case when contains(t, ':') then regexp_replace(t, ':', '=') else t || '=' end, '|' order by n)
    from (select unnest(tags) t, generate_subscripts(tags, 1) n))"""
_ROWS = f"""select point_id, ts "timestamp", metric metric_name, value, "type" metric_type, {_PAIRS} tags"""


def _number(agg: str, metric: str, extra: str = "") -> str:
    return (_SUM if agg == "sum" else _AVG).format(f"metric = '{metric}'{extra}")


def _scalar(expression: str, *metrics: str) -> str:
    return f"select {expression} as value from points where metric in {_in(metrics)}"


def _series(metrics: list[str], by: str = "", **columns: str) -> str:
    names = ", ".join(f'{expression} as "{name}"' for name, expression in columns.items())
    key = f", {by}" if by else ""
    return f"select time_bucket(interval '1 day', ts) bucket{key}, {names} from points where metric in {_in(metrics)} group by 1{', 2' if by else ''}"


def _avg_series(metric: str, factor: str = "") -> str:
    return _series([metric], value=_number("avg", metric) + factor)


def _sum_series(metric: str, by: str = "") -> str:
    return _series([metric], by, value=_number("sum", metric))


_REV, _ERR = "llm.reviews.total", "llm.errors"
_RATE = "({0}) / nullif(" + _number("sum", _REV) + ", 0) * 100"
WIDGETS = {
    "total_reviews": _scalar(f"round({_number('sum', _REV)}, 0)", _REV),
    "avg_cost": _scalar(f"round({_number('avg', 'llm.cost.per_review')}, 4)", "llm.cost.per_review"),
    "success_rate": _scalar("round(" + _RATE.format(_number("sum", _REV) + " - " + _number("sum", _ERR)) + ", 1)", _REV, _ERR),
    "error_count": _scalar(f"round({_number('sum', _ERR)}, 0)", _ERR),
    "generation_time": _avg_series("llm.duration.seconds"),
    "retrieval_latency_ms": _avg_series("rag.retrieval.duration_seconds", " * 1000"),
    "avg_generation_time": _scalar(f"round({_number('avg', 'llm.duration.seconds')}, 2)", "llm.duration.seconds"),
    "avg_retrieval_ms": _scalar(f"round({_number('avg', 'rag.retrieval.duration_seconds')} * 1000, 0)", "rag.retrieval.duration_seconds"),
    "cost_by_repo": _series(["llm.cost.per_review"], "repo", value=_number("avg", "llm.cost.per_review")),
    "cumulative_cost_by_repo": """select bucket, repo, sum(s) over (partition by repo order by bucket)::double as value from (
        select time_bucket(interval '1 day', ts) bucket, repo, sum(value) s from points where metric = 'llm.cost.per_review' group by 1, 2)""",
    "prompt_and_completion": _series(
        ["llm.tokens.prompt", "llm.tokens.completion"], prompt=_number("avg", "llm.tokens.prompt"), completion=_number("avg", "llm.tokens.completion")),
    "context_utilization": _avg_series("llm.context.utilization_pct"),
    "retrieval_count": _sum_series("rag.retrieval.total"),
    "max_similarity": _avg_series("rag.retrieval.max_similarity"),
    "chunks_retrieved": _avg_series("rag.retrieval.chunks"),
    "context_tokens": _avg_series("rag.retrieval.context_tokens"),
    "indexing_events": _sum_series("rag.indexing.total"),
    "files_and_chunks": _series(
        ["rag.indexing.files", "rag.indexing.chunks"], files=_number("avg", "rag.indexing.files"), chunks=_number("avg", "rag.indexing.chunks")),
    "embedding_calls": _series(
        ["rag.embedding.api_calls"], success=_number("sum", "rag.embedding.api_calls", " and success"),
        failed=_number("sum", "rag.embedding.api_calls", " and not success")),
    "security_by_type": _sum_series("security.events", "event_type"),
    "error_rate": _series([_ERR, _REV], value=_RATE.format(_number("sum", _ERR))),
    "files_changed": _avg_series("pr.files_changed"),
    "lines_changed": _avg_series("pr.total_changes"),
}
_OUTCOME = "select event_id, status, code::int code, message, pr_number from outcomes where {}"
_COST = "prompt_tokens / 1000 * 0.00125::double + completion_tokens / 1000 * 0.005::double"


def _rounded(x: str, digits: int) -> str:
    """Correct rounding of the binary value: printf rounds exactly, ties to even."""
    return f"printf('%.{digits}f', {x})::double"


_ROLLUP = f"""select r.*, completion from (select f.repo, f.pr, files_changed, total_changes, coalesce(files_reviewed, 0) files_reviewed,
        coalesce(total_tokens, 0) total_tokens, coalesce(prompt_tokens, 0) prompt_tokens, coalesce(spent, 0) "cost",
        coalesce(context_utilization, 0) context_utilization
    from (select repo, pr, count(*) files_changed, sum(changes)::bigint total_changes from pr_files group by all) f
    left join (select repo, pr, count(*) files_reviewed, sum(total_tokens)::bigint total_tokens, sum(prompt_tokens)::bigint prompt_tokens,
        sum(({_COST})::double) spent, max(prompt_tokens / 128000 * 100) context_utilization from reviewed group by all) u
        on u.repo = f.repo and u.pr = f.pr) r"""
_VECTOR_PAIRS = f"""with unit as (select vec_id, label, {_UNIT.format('embedding::double[]')}::double[] v from embeddings),
    pairs as (select a.vec_id query_idx, b.vec_id chunk_idx, a.label own, b.label, list_dot_product(a.v, b.v)::float score from unit a, unit b)"""
_PROMPT = f"""{_quote(SYSTEM)} || chr(10) || case when doc_id % 2 = 0 then {_quote(chr(10) + HEADINGS.context + chr(10))} || 'some context' || chr(10) || chr(10) else '' end
    || {_quote(chr(10) + HEADINGS.file + chr(10))} || filename || {_quote(chr(10) * 2 + HEADINGS.content + chr(10))} || substring(content, 1, 50000)
    || {_quote(chr(10) * 2 + HEADINGS.patch + chr(10))} || patch || chr(10)"""

_BODIES = {
    "security_by_type": f'select "type", severity, count(*) n from ({_issues("documents", "text", "doc_id")}) group by all',
    "security_issues_documents": _issues("documents", "text", "doc_id"),
    "security_issues_pages": _issues("pages", "html", "page_id"),
    "security_issues_conversations": _issues("conversations", "text", "conv_id, turn"),
    "security_issues_patches": _issues("patches", "patch", "doc_id"),
    "secrets": _issues("patches", "patch", "doc_id", ("secret",)),
    "personal_data": _issues("patches", "patch", "doc_id", ("pii",)),
    "prompt_injection": _issues("patches", "patch", "doc_id", ("prompt_injection",)),
    "security_events": f'select * exclude (ord) from ({_issues("eligible", "patch", "repo, pr, filename")})',
    "request_security_events": f'select * exclude (ord) from ({_issues("requests", "diff", "repo, pr_id pr")})',
    "points_review": _points("reviews", _REVIEW_VALUES, _TAGS.format("|model:" + MODEL, "|source:webhook")),
    "points_security": f"""select 'security.events' metric, 1::double "value", 'count' "type", 'event_type:' || "type" || '|severity:' || severity || '|'
        || {_TAGS.format('', '|source:webhook')} tags from ({_issues("eligible", "patch", "repo, pr, filename")})""",
    "points_error": f"""select event_id, 'llm.errors' metric, 1::double "value", 'count' "type", 'error_type:E' || (user_id % 5) || '|' || {_TAGS.format('', '|source:_experiment')} tags
        from (select *, 'org/r' || (user_id % 7) repo, user_id pr from events where event_type = 'error')""",
    "points_indexing": _points(
        f"""(select repo, pr, n, (select count(*) from code_files f where f.repo = i.repo and f.pr = i.pr and f.content <> '' and f.ext in {_in(fixed.REVIEWED_EXTENSIONS)}) files
            from (select repo, pr, count(*) n from indexed group by all) i)""",
        [("rag.indexing.files", "files", "gauge"), ("rag.indexing.chunks", "n", "gauge"), ("rag.indexing.duration_seconds", "n * 0.25", "histogram"),
         ("rag.embedding.duration_seconds", "(n * 0.25)::double * 0.8::double", "histogram"), ("rag.indexing.total", "1", "count")], _TAGS.format("", "")),
    "points_retrieval": _points(
        "(select s.* from stats s where exists (select 1 from indexed i where i.repo = s.repo and i.pr = s.pr))",
        [("rag.retrieval.chunks", "chunks_retrieved", "gauge"), ("rag.retrieval.duration_seconds", "0.25", "histogram"),
         ("rag.retrieval.context_tokens", "context_tokens", "gauge"), ("rag.retrieval.total", "1", "count"),
         ("rag.retrieval.max_similarity", "round(max_similarity, 4)", "gauge")], _TAGS.format("", "")),
    "points_embedding": _points(
        "(select repo, pr, batch, count(*) n from walk group by all)",
        [("rag.embedding.batch_size", "n", "gauge"), ("rag.embedding.api_duration_seconds", "n * 0.25", "histogram"), ("rag.embedding.api_calls", "1", "count")],
        "'service:code-review|env:production|success:true'", "repo, pr, batch,"),
    "metric_rows": f"{_ROWS}, 'code-review' service, 'production' env from points",
    "metric_rows_selected": f"{_ROWS} from points where repo = 'org/r3' and production",
    "metric_rows_with_tag": f"{_ROWS} from points where not success",
    "rollup_by_type": """select metric metric_name, "type" metric_type, repo, time_bucket(interval '1 day', ts) bucket,
        case when "type" = 'count' then sum(value) when "type" = 'gauge' then max_by(value, (ts, point_id)) end as value,
        case when "type" = 'histogram' then count(*) end n, case when "type" = 'histogram' then sum(value) / count(*) end "avg",
        case when "type" = 'histogram' then max(value) end "max", case when "type" = 'histogram' then quantile_disc(value, 0.5) end p50,
        case when "type" = 'histogram' then quantile_disc(value, 0.95) end p95 from points group by 1, 2, 3, 4""",
    "file_filter": f"""select doc_id, filename, ext extension, skipped, not skipped and ext in {_in(fixed.INDEXED_EXTENSIONS)} indexed,
        ext in {_in(fixed.REVIEWED_EXTENSIONS)} reviewed, "language" from (select f.*, c."language", list_has_any(string_split(filename, '/'), {_list(fixed.SKIPPED_DIRS)}) skipped
        from pr_files f join code_files c using (doc_id))""",
    "decoded_files": """select doc_id, case when doc_id % 2 = 0 then text else regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') end content from documents""",
    "local_modules": "select repo, module from modules",
    "classified_imports": "select * from imports",
    "imports_by_type": """select doc_id, coalesce(string_agg(raw_import, ',' order by pos) filter (where import_type = 'local'), '') "local",
        coalesce(string_agg(raw_import, ',' order by pos) filter (where import_type = 'stdlib'), '') stdlib,
        coalesce(string_agg(raw_import, ',' order by pos) filter (where import_type = 'third_party'), '') third_party from imports group by 1""",
    "definition_rows": """select doc_id, row_number() over (partition by doc_id order by type_ord, line) - 1 pos, "name", "type", line from defs""",
    "file_summaries": """select doc_id, coalesce(nullif(concat_ws('; ', 'Local: ' || l.names, 'Stdlib: ' || s.names, d.names), ''), 'No structure detected') summary
        from code_files
        left join (select doc_id, string_agg(module_name, ', ' order by pos) names from (select * from imports where import_type = 'local'
            qualify row_number() over (partition by doc_id order by pos) <= 3) group by 1) l using (doc_id)
        left join (select doc_id, string_agg(module_name, ', ' order by pos) names from (select * from imports where import_type = 'stdlib'
            qualify row_number() over (partition by doc_id order by pos) <= 3) group by 1) s using (doc_id)
        left join (select doc_id, string_agg(names, '; ' order by type_ord) names from (select doc_id, type_ord, "type" || ': ' || string_agg("name", ', ' order by line) names
            from (select * from defs qualify row_number() over (partition by doc_id, type_ord order by line) <= 3
                and dense_rank() over (partition by doc_id order by type_ord) <= 2) group by doc_id, type_ord, "type") group by 1) d using (doc_id)""",
    "chunks_function": "select * from chunks",
    "chunks_fixed": """select doc_id, k chunk_ord, k * 45 + 1 start_line, least(k * 45 + 50, n_lines) end_line, 'block' chunk_type, null::varchar "name",
        array_to_string(lines[k * 45 + 1:least(k * 45 + 50, n_lines)], chr(10)) content
        from (select doc_id, lines, n_lines, unnest(range(0, 1 + ceil(greatest(n_lines - 50, 0) / 45)::bigint)) k from sized)""",
    "chunks_code": """select doc_id, row_number() over (partition by doc_id order by k, part) - 1 chunk_ord, * exclude (doc_id, k, part) from (
        select doc_id, 0 k, 0 part, 1 start_line, n_lines end_line, 'file' chunk_type, null::varchar "name", content from sized where n_lines <= 12
        union all select doc_id, 0, 0, start_line, end_line, 'import', null, content from headers where doc_id in (select doc_id from sized where n_lines > 12)
        union all select doc_id, k, part, first + part * 9, least(first + part * 9 + 11, last), kind, label,
            case when last < first then '' else array_to_string(lines[first + part * 9:least(first + part * 9 + 11, last)], chr(10)) end from (
            select doc_id, k, start_line first, end_line last, "type" kind, "name" label, lines,
                unnest(range(0, 1 + ceil(greatest(end_line - start_line + 1 - 12, 0) / 9)::bigint)) part
            from spans where doc_id in (select doc_id from sized where n_lines > 12))
        union all select doc_id, 0, part, part * 9 + 1, least(part * 9 + 12, n_lines), 'block', null, array_to_string(lines[part * 9 + 1:least(part * 9 + 12, n_lines)], chr(10))
            from (select doc_id, lines, n_lines, unnest(range(0, 1 + ceil(greatest(n_lines - 12, 0) / 9)::bigint)) part from sized where n_lines > 12 and n_defs = 0))""",
    "chunk_numbers": 'select repo, pr, file_path, chunk_ord, chunk_idx, chunk_type, "name", "language" from indexed',
    "file_to_chunks": "select repo, pr, file_path, min(chunk_idx) first_idx, max(chunk_idx) last_idx, count(*) n_chunks from indexed group by all",
    "embedding_texts": "select repo, pr, chunk_idx, embedding_text from chunk_texts",
    "token_estimates": "select doc_id, length(text) // 4 n_tokens from documents",
    "truncated_texts": "select doc_id, substring(text, 1, 8192) text from documents",
    "token_batches": """with recursive numbered as (select lang, row_number() over (partition by lang order by doc_id) - 1 pos,
            length(substring(text, 1, 8192)) // 4 n from documents),
        steps as (select lang, pos, 0::bigint batch, 1::bigint items, n from numbered where pos = 0
            union all select b.lang, b.pos, s.batch + (s.n + b.n > 12000 or s.items >= 250)::bigint,
                case when s.n + b.n > 12000 or s.items >= 250 then 1 else s.items + 1 end, case when s.n + b.n > 12000 or s.items >= 250 then b.n else s.n + b.n end
            from steps s join numbered b on b.lang = s.lang and b.pos = s.pos + 1)
        select lang, pos, batch from steps""",
    "normalized_vectors": f"""select vec_id, i - 1 i, round(x, 6) x from (select vec_id, unnest(v) x, generate_subscripts(v, 1) i
        from (select vec_id, {_UNIT.format('embedding::double[]')}::double[] v from embeddings))""",
    "nearest_vectors": _VECTOR_PAIRS + """ select query_idx, chunk_idx, round(score::double, 4) score, row_number() over w "rank" from pairs
        window w as (partition by query_idx order by score desc, chunk_idx) qualify "rank" <= 5""",
    "nearest_vectors_other_file": _VECTOR_PAIRS + """, fetched as (select *, row_number() over w r from pairs
            window w as (partition by query_idx order by score desc, chunk_idx) qualify r <= 15)
        select query_idx, chunk_idx, round(score::double, 4) score, row_number() over w "rank" from fetched where own <> label
        window w as (partition by query_idx order by score desc, chunk_idx) qualify "rank" <= 5""",
    "embedded_chunks": "select repo, pr, chunk_idx, batch, true embed_ok, size, top_letter from embedding",
    "similar_chunks": 'select repo, pr, file_ord, "rank", chunk_idx, round(score::double, 4) score from matches',
    "related_chunks": 'select repo, pr, file_path, chunk_idx, "name" from related',
    "query_texts": "select doc_id, case when patch <> '' then patch else substring(content, 1, 2000) end query from pr_files",
    "context_texts": "select doc_id, context from contexts",
    "retrieval_stats": "select doc_id, chunks_retrieved, context_tokens, round(max_similarity, 4) max_similarity from stats",
    "chunks_by_name": f"""select repo, pr, query, chunk_idx, 1::double score, row_number() over (partition by repo, pr, query order by chunk_idx) "rank"
            from indexed, (select unnest({_list(NAMES)}) query) where contains(lower("name"), lower(query))
            qualify row_number() over (partition by repo, pr, query order by chunk_idx) <= 5
        union all select repo, pr, query, chunk_idx, round(score::double, 4), row_number() over w "rank" from (
            select v.repo, v.pr, query, chunk_idx, list_dot_product(q, v.v)::float score from vectors v,
                (select query, {_UNIT.format('raw')}::double[] q from (select query, {_LETTERS.format("('function ' || query)")} raw from (select unnest({_list(NAMES)}) query)))
            where not exists (select 1 from indexed i where i.repo = v.repo and i.pr = v.pr and contains(lower(i."name"), lower(query))))
            window w as (partition by repo, pr, query order by score desc, chunk_idx) qualify "rank" <= 5""",
    "diff_lines": "select doc_id, line from diff_lines",
    "answer_lines": "select doc_id, pos, line, body from answer_rows",
    "comments_on_diff": "select doc_id, filename path, pos, body, line, 'RIGHT' side from kept join patches using (doc_id)",
    "comments_without_diff": "select doc_id, filename path, pos, body, line, 'RIGHT' side from answer_rows join patches using (doc_id) where line <> 0",
    "eligible_files": "select doc_id, filename, changes from eligible",
    "files_with_contents": f"""select doc_id, filename, case when doc_id % 3 <> 0 and ext in {_in(fixed.REVIEWED_EXTENSIONS)} then content end content from pr_files""",
    "review_costs": f'select doc_id, {_COST} "cost", prompt_tokens / 128000 * 100 context_utilization from answers',
    "pr_rollup": _ROLLUP.replace("select r.*, completion from", "select *, total_tokens - prompt_tokens completion_tokens from"),
    "review_headlines": f"""select f.repo, f.pr, coalesce(n, 0) n_comments, case when coalesce(n, 0) = 0 then {_quote(fixed.APPROVED_BODY)}
            else 'AI Code Review - ' || n || ' issue(s) found' end body from (select distinct repo, pr from pr_files) f
        left join (select repo, pr, count(*) n from kept join reviewed using (doc_id) group by all) k on k.repo = f.repo and k.pr = f.pr""",
    "fallback_bodies": """select repo, pr, file_ord // 100 + 1 part, string_agg('**' || filename || '**: ' || body || chr(10) || chr(10), '' order by file_ord, pos) body
            from kept join reviewed using (doc_id) group by 1, 2, 3
        union all select distinct repo, pr, 0, '## 🤖 AI Code Review' || chr(10) || chr(10) from kept join reviewed using (doc_id)""",
    "file_prompts": f"select doc_id, {_PROMPT} prompt from eligible",
    "request_prompts": f"""select pr_id, {_quote(SYSTEM)} || chr(10) || chr(10) || 'Repository: ' || repo || chr(10) || 'Pull Request: #' || pr_id || chr(10) || 'Files changed: '
        || files_changed || chr(10) || 'Lines added: ' || lines_added || chr(10) || 'Lines deleted: ' || lines_deleted || chr(10) || chr(10)
        || {_quote(HEADINGS.diff)} || chr(10) || diff || chr(10) prompt from requests""",
    "request_records": f"""select r.repo, r.pr_id, r.text review, {_rounded(_COST, 6)} cost_usd, prompt_tokens tokens_prompt, completion_tokens tokens_completion,
        total_tokens tokens_total, trunc(duration * 1000)::bigint duration_ms, {_rounded('prompt_tokens / 128000 * 100', 2)} context_utilization_pct,
        lines_added + lines_deleted pr_complexity, coalesce(i.types, '') security_issues, answered_at "timestamp"
        from requests r left join (select pr_id, string_agg("type", ',' order by ord) types from ({_issues("requests", "diff", "pr_id")}) group by 1) i using (pr_id)""",
    "deliveries_routed": _OUTCOME.format("signed"),
    "deliveries_routed_unsigned": _OUTCOME.format("not signed"),
    "stream_deliveries": _OUTCOME.format("signed"),
    "deliveries_projected": """select event_id, action, event_id pr_number, 'org' "owner", 'r' || (user_id % 7) repo_name, 'org/r' || (user_id % 7) full_repo,
        event_type || event_id head_sha, 'f' || user_id head_ref, case when event_id % 7 = 0 then '' else 'main' end base_ref from routed where signed and valid and body <> ''""",
    "landed_file_lists": """select repo, pr, (row_number() over (partition by repo, pr order by file_ord, doc_id) - 1)::int file_ord, filename,
        case when doc_id % 3 <> 0 then patch end patch, doc_id changes from patches""",
    "landed_contents": """select doc_id, file_path filename, case when doc_id % 10 > 2 then content end content,
        case doc_id % 10 when 1 then 'UnicodeDecodeError' when 2 then 'binascii.Error' end error_type from code_files""",
    "stream_rollup": """select time_bucket(interval '1 day', ts) bucket, metric metric_name, repo, count(*) n, sum(value) total from points
        where time_bucket(interval '1 day', ts) + interval '1 day' <= (select date_trunc('millisecond', max(ts)) - interval '2 days' from points) group by 1, 2, 3""",
}
_BODIES["generated_answers"] = f"""select doc_id, case when n >= 40 then n || ' : lines' end text, case when n >= 40 then n end prompt_tokens,
    case when n >= 40 then 1 end completion_tokens, case when n >= 40 then n + 1 end total_tokens, case when n < 40 then 'ValueError' end error_type
    from (select doc_id, len(string_split({_BARE_PROMPT}, chr(10))) - 1 n from eligible)"""
_BODIES["pr_review_points"] = _points("stand_in", _REVIEW_VALUES, _TAGS.format("|model:" + MODEL, "|source:webhook"))


def _stable(body: str, *columns: str) -> str:
    """Twelve significant digits of these columns, as on the other side."""
    return f"select * replace ({', '.join(f'printf({_quote("%.11e")}, "{c}"::double)::double as "{c}"' for c in columns)}) from ({body})"


_BODIES["stored_points_by_day"] = _stable("""select strftime(ts, '%Y-%m-%d') event_date, metric metric_name, count(*) n, sum(value) total from points
    where repo = 'org/r3' and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' group by 1, 2""", "total")
_BODIES["rollup_from_states"] = "select * exclude (p50, p95) from (" + _BODIES["rollup_by_type"] + ")"
_BODIES["stream_rollup_by_type"] = _BODIES["rollup_from_states"]
_BODIES["tree_files"] = f"""select 'org/tree' repo, file_path, content from code_files
    where not list_has_any(string_split(file_path, '/'), {_list(fixed.SKIPPED_DIRS)}) and ext in {_in(fixed.INDEXED_EXTENSIONS)}"""
_BODIES["state_percentiles"] = """select metric metric_name, time_bucket(interval '1 day', ts) bucket, count(*) n, true p50_fits, true p95_fits
    from points where "type" = 'histogram' group by 1, 2"""
_BODIES["stream_rollup_current"] = "select time_bucket(interval '1 day', ts) bucket, metric metric_name, repo, count(*) n, sum(value) total from points group by 1, 2, 3"
_LINKED = """linked as (select doc_id, 'org/g' || (doc_id % 3) repo, ['src', 'src/core', 'lib', 'app'][(doc_id // 3) % 4 + 1] folder, n_chars from documents),
    asked as (select doc_id, repo, folder, j, abs(doc_id + 3 * ((n_chars * (j + 1)) % 41 - 20)) k from linked, range(4) r(j)),
    edges as (select distinct a.repo, a.folder || '/m' || a.doc_id || '.py' source, t.folder || '/m' || k || '.py' target,
        case j when 0 then replace(t.folder, '/', '.') || '.' when 1 then '' when 2 then '.' else '..core.' end || 'm' || k raw_import
        from asked a join linked t on t.doc_id = k and t.repo = a.repo
        where k <> a.doc_id and (j < 2 or j = 2 and t.folder = a.folder or j = 3 and a.folder = 'src/core' and t.folder = 'src/core'))"""
_GRAPH = {
    "import_edges": f"with {_LINKED} select * from edges",
    "reverse_imports": f"with {_LINKED} select repo, target, source, count(*) imports from edges group by 1, 2, 3",
    "affected_files": f"""with recursive {_LINKED},
        reached(repo, file_path, steps) using key (repo, file_path) as (
            select repo, folder || '/m' || doc_id || '.py', 0 from linked where doc_id % 50 = 0
            union
            select e.repo, e.source, min(r.steps) + 1 from reached r join edges e on e.repo = r.repo and e.target = r.file_path
                left join recurring.reached q on q.repo = e.repo and q.file_path = e.source where q.file_path is null group by 1, 2)
        select repo, file_path, steps from reached""",
}
_BODIES["repository_index"] = f"""select f.repo, f.file_path, c.chunk_ord, row_number() over (partition by f.repo order by doc_id, c.chunk_ord) - 1 chunk_idx, true embed_ok
    from chunks c join code_files f using (doc_id) where not list_has_any(string_split(f.file_path, '/'), {_list(fixed.SKIPPED_DIRS)})
        and f.ext in {_in(fixed.INDEXED_EXTENSIONS)} and trim(f.content) <> ''"""
_OK = "(select * from {} where pr % 10 <> 9)"
_SOURCE = "|source:webhook"
_RUN_VALUES = [
    (_OK.format("stand_in"), _REVIEW_VALUES, _TAGS.format("|model:" + MODEL, _SOURCE)),
    (f"(select repo, pr, n, files, (select count(*) from pr_files f where f.repo = i.repo and f.pr = i.pr) * 0.25::double secs from (select repo, pr, count(*) n, (select count(*) from code_files f where f.repo = x.repo and f.pr = x.pr and f.content <> '' and f.ext in {_in(fixed.REVIEWED_EXTENSIONS)}) files from indexed x where pr % 10 <> 9 group by repo, pr) i)",
     [("rag.indexing.files", "files", "gauge"), ("rag.indexing.chunks", "n", "gauge"), ("rag.indexing.duration_seconds", "secs", "histogram"),
      ("rag.embedding.duration_seconds", "secs * 0.8::double", "histogram"), ("rag.indexing.total", "1", "count")], _TAGS.format("", "")),
    ("(select s.* from stats s where pr % 10 <> 9 and exists (select 1 from indexed i where i.repo = s.repo and i.pr = s.pr))",
     [("rag.retrieval.chunks", "chunks_retrieved", "gauge"), ("rag.retrieval.duration_seconds", "0.25", "histogram"), ("rag.retrieval.context_tokens", "context_tokens", "gauge"),
      ("rag.retrieval.total", "1", "count"), ("rag.retrieval.max_similarity", "round(max_similarity, 4)", "gauge")], _TAGS.format("", "")),
    ("(select repo, pr, batch, count(*) n from walk where pr % 10 <> 9 group by all)",
     [("rag.embedding.batch_size", "n", "gauge"), ("rag.embedding.api_calls", "1", "count")], "'service:code-review|env:production|success:true'"),
    ("(select distinct repo, pr from pr_files where pr % 10 = 9)", [("llm.errors", "1", "count")], "'error_type:UnicodeDecodeError|' || " + _TAGS.format("", _SOURCE)),
    (f"({_issues(_OK.format('eligible'), 'patch', 'repo, pr, filename')})", [("security.events", "1", "count")],
     "'event_type:' || \"type\" || '|severity:' || severity || '|' || " + _TAGS.format("", _SOURCE)),
]
_BODIES["pr_review_all_points"] = _stable(" union all ".join(_points(source, values, tags, "repo, pr,") for source, values, tags in _RUN_VALUES), "value")
_RUN_COMMENTS = """select p.repo, p.pr, p.file_ord, p.filename path, pos, p.line || ' : lines' body, p.line, 'RIGHT' side
    from (select *, unnest([1 + n % 7, 20 + n % 30, n])::bigint line, unnest([0, 1, 2]) pos from prompted where n >= 40 and pr % 10 <> 9) p
        semi join diff_lines d on d.doc_id = p.doc_id and d.line = p.line"""
_BODIES["pr_review_comments"] = _RUN_COMMENTS
_BODIES["pr_review_bodies"] = f"""select f.repo, f.pr, coalesce(n, 0) n_comments, case when coalesce(n, 0) = 0 then {_quote(fixed.APPROVED_BODY)}
    else 'AI Code Review - ' || n || ' issue(s) found' end body from (select distinct repo, pr from pr_files where pr % 10 <> 9) f
    left join (select repo, pr, count(*) n from ({_RUN_COMMENTS}) group by all) k on k.repo = f.repo and k.pr = f.pr"""
_BODIES["stream_review_points"], _BODIES["stream_review_comments"] = _BODIES["pr_review_all_points"], _RUN_COMMENTS
_BODIES["stream_delivery_counts"] = f"select status, code, count(*) n, sum(count(*)) over (partition by status)::bigint logged from ({_BODIES['deliveries_routed']}) group by 1, 2"
_REQUESTS = f"(select *, pr_id pr, {_COST} \"cost\", prompt_tokens / 128000 * 100 context_utilization, lines_added + lines_deleted total_changes from requests)"
_BODIES["request_points"] = _stable(
    _points(_REQUESTS, _REVIEW_VALUES, _TAGS.format("|model:" + MODEL, "|source:_experiment"), "repo, pr,") + " union all "
    + _points(f"({_issues('requests', 'diff', 'repo, pr_id pr')})", [("security.events", "1", "count")],
              "'event_type:' || \"type\" || '|severity:' || severity || '|' || " + _TAGS.format("", "|source:_experiment"), "repo, pr,"), "value")
_KEY = SECRET.encode().ljust(64, b"\0")


def _blob(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


_DIGEST = f"sha256({_blob(bytes(b ^ 0x5C for b in _KEY))} || unhex(sha256({_blob(bytes(b ^ 0x36 for b in _KEY))} || encode(body))))"
_BODIES["signatures"] = f"select event_id, {_DIGEST} digest, event_id % 17 <> 0 ok from bodies"



for _name, _columns in {"rollup_by_type": ["value", "avg", "max", "p50", "p95"], "pr_rollup": ["cost", "context_utilization"], "pr_review_points": ["value"], "stream_rollup": ["total"], "stream_rollup_current": ["total"], "rollup_from_states": ["value", "avg", "max"], "stream_rollup_by_type": ["value", "avg", "max"]}.items():
    _BODIES[_name] = _stable(_BODIES[_name], *_columns)
_WIDGET_COLUMNS = {"prompt_and_completion": ["prompt", "completion"], "files_and_chunks": ["files", "chunks"], "embedding_calls": ["success", "failed"]}

SQL = {name: _with(body) for name, body in _BODIES.items()}
SQL |= {f"dash_{name}": _with(_stable(body, *_WIDGET_COLUMNS.get(name, ["value"]))) for name, body in WIDGETS.items()}
SQL |= _GRAPH
_DAYS = "from (select * from points where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'{}) points"
for _name, _chosen in {"avg_cost": "", "error_rate": "", "security_by_type": "", "cumulative_cost_by_repo": "", "generation_time": " and repo = 'org/r3' and production"}.items():
    SQL[f"stored_{_name}"] = _with(_stable(WIDGETS[_name].replace("from points", _DAYS.format(_chosen)), *_WIDGET_COLUMNS.get(_name, ["value"])))
