"""Results of the queries in DuckDB SQL, where SQL can express them on whole tables."""

from patchlake.llm.license_scans import known_sentences, licence_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_FILTERS = rf"""
with parts as (
  select row_number() over () as n, page_id,
    translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(rule_host, rule_path, verdict) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(r.verdict, length(rule_host || rule_path)) as verdict
  from parts p join rules r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)
  group by n)
select page_id, host, path, rule,
  coalesce(f.verdict, case when regexp_matches(host || path, '^([^/]*\.)?(casino-|adult-|cheap-pills\.|free-bets\.|spam-farm\.|ads-track\.)|/adserver/|/doorway/')
    then 'block' else 'allow' end) as verdict
from parts left join fits f using (n)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_scans() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i.replace(' ', '_'))})" for s, i in known_sentences().items())
    seq = "' ' || replace(ids, ' ', '  ') || ' '"
    steps = f"select n, {seq} as s, []::varchar[] as found from joined"
    for k, (sequence, licence) in enumerate(licence_rules()):
        wide = _quoted(" " + sequence.replace(" ", "  ") + " ")
        steps = f"select n, case when contains(s, {wide}) then replace(s, {wide}, ' | ') else s end as s, case when contains(s, {wide}) then list_append(found, {_quoted(licence)}) else found end as found from ({steps}) r{k}"
    lead = "^(this (work|software|file|project|document|program|code|text) is )?(licen[sc]ed|released|distributed|available|published|provided|made available) under (the terms of )?(the |a |an )?"
    norm = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({c}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9.]+', ' ', 'g'), '[. ]+$', ''), '^[. ]+', ''), '{lead}', 'under ')"
    return rf"""
with known(sentence, id) as (values {known}),
docs as (select row_number() over () as n, doc_id, text from documents),
cut as (
  select n, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?;:])[ \t\n\r\f\v]+', '\1' || chr(10) || chr(10), 'g'), '\n[ \t\r]*\n', chr(1), 'g'), chr(1))) as sentence,
    generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([.!?;:])[ \t\n\r\f\v]+', '\1' || chr(10) || chr(10), 'g'), '\n[ \t\r]*\n', chr(1), 'g'), chr(1)), 1) as place
  from docs),
whole as (
  select c.n, c.place, c.sentence, k.id from (select *, {norm("sentence")} as norm from cut) c left join known k on k.sentence = c.norm),
by_line as (
  select n, place, unnest(string_split(sentence, chr(10))) as line, generate_subscripts(string_split(sentence, chr(10)), 1) as line_place from whole where id is null and contains(sentence, chr(10))),
hits as (
  select n, place, 0 as line_place, id from whole where id is not null
  union all select l.n, l.place, l.line_place, k.id from by_line l join known k on k.sentence = {norm("l.line")}),
joined as (select n, string_agg(id, ' ' order by place, line_place) as ids from hits group by n),
licences as (select n, array_to_string(list_filter(list_transform(generate_series(1, len(found)), lambda i: case when list_position(found, found[i]) = i then found[i] end), lambda x: x is not null), ' ') as licenses from ({steps}) z)
select doc_id, coalesce(ids, '') as sentence_ids, coalesce(licenses, '') as licenses
from docs left join joined using (n) left join licences using (n)
"""


NGRAM_JACCARD_JOIN = rf"""
with recursive words as (
  select row_number() over () as n, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda v: v <> '') as w
  from documents),
sets as (
  select n, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s
  from words),
tokens as (select n, len(s) as size, unnest(s) as token from sets),
links as (
  select a.n as x, b.n as y from tokens a join tokens b on a.token = b.token and a.n <> b.n
    and 100 * a.size >= 85 * b.size and 100 * b.size >= 85 * a.size
  group by a.n, b.n having 100 * count(*) >= 85 * (any_value(a.size) + any_value(b.size) - count(*))),
reach(n, y) as (
  select n, n from sets
  union select r.n, l.y from reach r join links l on l.x = r.y)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(t.doc_id) as component_id
from sets s join reach r on r.n = s.n join sets t on t.n = r.y
group by s.n, s.doc_id, s.s
"""

SUBSTRING_DEDUP = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(0, len(w) - 19)) as start from texts where len(w) >= 20),
windows as (select doc_id, start, array_to_string(w[start + 1 : start + 20], ' ') as s from places),
judged as (select doc_id, start, min({'d': doc_id, 's': start}) over (partition by s) as source from windows),
covered as (select distinct doc_id, start + unnest(range(20)) as place from judged where {'d': doc_id, 's': start} > source),
words as (select doc_id, unnest(range(0, len(w))) as place, unnest(w) as word from texts),
left_over as (
  select doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n
  from words anti join covered using (doc_id, place) group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts t left join left_over l on l.doc_id = t.doc_id
"""

SQL = {
    "op1_url_filters": URL_FILTERS,
    "op4_license_scans": _license_scans(),
    "op8_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op13_substring_dedup": SUBSTRING_DEDUP,
}
