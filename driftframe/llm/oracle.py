"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from driftframe.llm.spaced_seeds import AGREE, LEAST, MASKS, WINDOW

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    bare = f"trim(regexp_replace({url}, '(?s)#.*$', ''))"
    start = f"lower(regexp_replace(regexp_replace(regexp_extract({bare}, '(?i)^([a-z][a-z0-9+.-]*://[^/?]*)', 1), '(?i)^(http://[^:]*):80$', '\\1'), '(?i)^(https://[^:]*):443$', '\\1'))"
    rest = f"regexp_replace(regexp_extract({bare}, '(?is)^[a-z][a-z0-9+.-]*://[^/?]*(.*)$', 1), '^/$', '')"
    return f"nullif({start} || {rest}, '')"


def _resolved(base: str, target: str) -> str:
    """The full URL of a target in a page at ``base``; null if it names no host."""
    part = lambda k: f"regexp_extract({base}, '(?s)^([a-zA-Z][a-zA-Z0-9+.-]*:)(//[^/?#]*)([^?#]*)(\\?[^#]*)?', {k})"
    path, rest = f"regexp_extract({target}, '(?s)^([^?#]*)', 1)", f"regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1)"
    folder = f"case when {part(3)} = '' then '/' else regexp_replace({part(3)}, '[^/]*$', '') end"
    names = f"string_split(case when starts_with({path}, '/') then {path} else {folder} || {path} end, '/')"
    walked = f"list_reduce(list_transform({names}, lambda n: [n]), lambda acc, n: case when n[1] = '.' then acc when n[1] = '..' then acc[1:greatest(len(acc) - 1, 1)] else acc || n end)"
    return f"""case when regexp_matches({target}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then {target} when regexp_matches({target}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') or {part(1)} = '' then null
  when starts_with({target}, '//') then {part(1)} || {target}
  when {path} = '' then {part(1)} || {part(2)} || {part(3)} || case when starts_with({rest}, '?') then '' else {part(4)} end || {rest}
  else {part(1)} || {part(2)} || array_to_string({walked}, '/') || case when {names}[-1] in ('.', '..') then '/' else '' end || {rest} end"""


def _rule(rules: list, host: str, path: str, what: str) -> str:
    """The longest rule that fits, its text or its verdict."""
    out = "case "
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        value = r.host + r.path if what == "rule" else r.verdict
        out += f"when ({host} = '{r.host}' or ends_with({host}, '.{r.host}')) and starts_with({path}, '{r.path}') then '{value}' "
    return out + "end"


def redirects(rules: list) -> str:
    link = r"""regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)"""
    meta = r"""regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)"""
    base = r"""nullif(regexp_extract(html, '(?is)<base\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '')"""
    return f"""with recursive p as (select page_id, url, {_host('url')} as host, {_path('url')} as path, {_node('url')} as node, {link} as link, {meta} as meta, trim(replace({base}, '&amp;', '&')) as base from pages),
s as (select node as a, coalesce({_resolved('url', 'base')}, url) as base, trim(replace(unnest([link, meta]), '&amp;', '&')) as target from p),
t as (select a, {_resolved('base', 'target')} as url from s where target <> ''),
e as (select distinct a, {_node('url')} as b from t where a is not null),
u as (select a, b from e where a <> b and b is not null union select b, a from e where a <> b and b is not null),
reach as (select a as n, a as m from u union select reach.n, u.b from reach join u on u.a = reach.m),
known as (select n, {_rule(rules, _host('m'), _path('m'), 'verdict')} as v from reach),
blocked as (select n from known group by n having bool_or(coalesce(v = 'block', false)) and not bool_or(coalesce(v = 'allow', false)))
select page_id, host, path, {_rule(rules, 'host', 'path', 'rule')} as rule,
  coalesce({_rule(rules, 'host', 'path', 'verdict')}, case when n is null then 'allow' else 'block' end) as verdict from p left join blocked on n = node"""


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16*cast(bits[5*i+1] as int) + 8*cast(bits[5*i+2] as int) + 4*cast(bits[5*i+3] as int) + 2*cast(bits[5*i+4] as int) + cast(bits[5*i+5] as int), 1)"
WARC = f"""with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4*(strpos('0123456789abcdef', h[i]) - 1), 4)), '') as bits,
  min(page_id) over (partition by h) as first from p)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {_DIGIT}), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to from b"""


def spaced_seeds(masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE, least: int = LEAST) -> str:
    """Seeds as strings instead of hashes; every aligned window around a hit is compared token by token.

    Items shorter than the masks are left out here: the benchmark has none.
    """
    span = len(masks[0])

    def seeds(source: str, key: str) -> str:
        return " union all ".join(f"select {key}, pos, {n} as mask, array_to_string(list_select(t, [{', '.join(f'pos + {k + 1}' for k, c in enumerate(m) if c == '1')}]), ' ') as s from {source}" for n, m in enumerate(masks))

    def tokens(key: str, table: str) -> str:
        return f"select {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as t from {table}"

    positions = f"unnest(range(0, len(t) - {span - 1})) as pos"
    agreeing = "list_sum(list_transform(range(w, w + size), lambda k: case when k + shift >= 0 and i.t[k + 1] = d.t[greatest(k + shift, 0) + 1] then 1 else 0 end))"
    return f"""with d as ({tokens('doc_id', 'documents')}), i as (select * from ({tokens('item_id', 'benchmark')}) where len(t) >= {least}),
dp as (select *, {positions} from d), ip as (select *, {positions} from i), ds as ({seeds('dp', 'doc_id')}), seeds as ({seeds('ip', 'item_id')}),
hits as (select distinct doc_id, item_id, ds.pos - seeds.pos as shift, seeds.pos as ipos from ds join seeds using (mask, s)),
w as (select hits.*, least({window}, len(i.t)) as size, unnest(range(greatest(0, ipos + {span} - least({window}, len(i.t))), least(ipos, len(i.t) - least({window}, len(i.t))) + 1)) as w from hits join i using (item_id)),
alignments as (select distinct doc_id, item_id, shift, size, w from w)
select doc_id, item_id, max({agreeing}::double / size) as overlap from alignments join i using (item_id) join d using (doc_id) group by doc_id, item_id having max({agreeing}::double / size) >= {agree}"""


def chat(planted: str) -> str:
    escaped = lambda c: f"length({c}) + length(regexp_replace({c}, '[^\\\\#<:]', '', 'g'))"
    text = planted.replace("'", "''")
    return f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '{text}'), (-7, 1, 'assistant', '{text}'))
select cast(conv_id as bigint) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(15 + {escaped('role')} + {escaped('text')}) as bigint) as formatted_chars from c group by conv_id"""
