"""SQL that gives the rows of the queries that SQL can express (DuckDB)."""

from .licenses import PERCENT, PHRASES, TEMPLATES
from .quality import BITS, FLOORS, MAX_REPEAT_PERCENT, MIN_WORDS, NOISE, PRIOR, SPREAD
from .urls import CANONICAL, HREF, REFRESH, RULES

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"


def lower(text: str) -> str:
    return f"translate({text}, {UPPER}, {LOWER})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(text: str) -> str:
    return "[" + ", ".join(quoted(x) for x in text.split()) + "]"


DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all({lower("text")}, {ALNUM}), []) as w from documents),
i as (select cast(item_id as varchar) as item, coalesce(regexp_extract_all({lower("text")}, {ALNUM}), []) as w from benchmark),
g as (select distinct item, k, w[p : p + k - 1] as gram from (select item, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from (select *, least(8, len(w)) as k from i where len(w) > 0))),
p as (select r, k, p, w[p : p + k - 1] as gram from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d cross join (select distinct k from g) where len(w) >= k)),
h as (select p.r, p.p, p.k, g.item from p join g on p.k = g.k and p.gram = g.gram),
c as (select r, count(distinct q) as n_hit from (select r, unnest(generate_series(p, p + k - 1)) as q from h) group by r),
n as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join c using (r) left join n using (r)"""


def license_sql() -> str:
    starts = [f"list_filter(generate_series(1, len(w)), lambda p: w[p : p + {len(p.split()) - 1}] = {listed(p)})" for p in PHRASES]
    base = ", ".join(f"case when len({x}) > 0 then {quoted(label)} end" for x, label in zip(starts, PHRASES.values(), strict=True))
    met, around = [], 1
    for text, label in TEMPLATES.items():
        tokens = sorted(set(text.split()))
        around = max(around, 2 * len(text.split()))
        met.append(f"select r, {quoted(label)} as label, len(list_intersect(b, {listed(' '.join(tokens))})) / {float(len(tokens))}::double as share, {max(1, -(-PERCENT * len(tokens) // 100))} / {float(len(tokens))}::double as least from b")
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all({lower("coalesce(text, '')")}, {ALNUM}) as w from documents),
l as (select r, unnest(generate_series(1, len(l))) as i, unnest(list_transform(l, lambda x: regexp_extract_all(x, {ALNUM}))) as w from (select r, string_split({lower("t")}, chr(10)) as l from d)),
p as (select *, count(*) filter (len(w) = 0) over (partition by r order by i) as p from l),
q as (select *, cast(sum(len(w)) over (partition by r, p order by i) as bigint) as stop from p where len(w) > 0),
g as (select r, p, flatten(list(w order by i)) as words from q group by r, p),
b as (select r, list_distinct(w) as b from l union all
  select r, list_distinct(words[stop - least(len(w), {around}) + 1 : stop + {around}]) from q join g using (r, p) where stop < len(words)),
m as (select r, list(distinct label) as more, max(share) as share from ({" union all ".join(met)}) where share >= least group by r),
x as (select r, doc_id, len(w) as n, list_concat({", ".join(starts)}) as starts, list_filter([{base}], lambda x: x is not null) as base from d)
select doc_id, cast(n as bigint) as n_words, cast(len(starts) as bigint) as n_base, list_min(starts) - 1 as first_word, list_max(starts) - 1 as last_word,
  array_to_string(list_sort(list_distinct(base)), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') as labels,
  case when len(starts) > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from x left join m using (r)"""


def url_sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = {quoted(h)} or ends_with(host, {quoted('.' + h)})) and starts_with(path, {quoted(p)})" for h, p, _ in order]
    rule = " ".join(f"when {f} then {quoted(h + p)}" for f, (h, p, _) in zip(fits, order, strict=True))
    verdict = " ".join(f"when {f} then {quoted(v)}" for f, (_, _, v) in zip(fits, order, strict=True))
    host = lambda u: f"coalesce({lower(f'''regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)''')}, '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = lambda u: f"trim(regexp_replace(regexp_replace('&' || regexp_extract({u}, '(?s)^[^?#]*\\?([^#]*)', 1), '&utm_[^&]*', '', 'g'), '&+', '&', 'g'), '&')"
    node = lambda u: f"case when contains({u}, '://') then {host(u)} || regexp_replace({path(u)}, '/+$', '') || case when {query(u)} = '' then '' else '?' || {query(u)} end end"
    whole = "case when contains(t, '://') then t when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then 'http://' || host || t end"
    return f"""
with recursive p as (select row_number() over () as r, page_id, {host("url")} as host, {path("url")} as path, {node("url")} as node, html from pages),
v as (select *, case {rule} end as rule, case {verdict} end as best from p),
t as (select node, host, regexp_extract(regexp_extract(html, {quoted(CANONICAL)}), {quoted(HREF)}, 1) as t from p union all select node, host, regexp_extract(html, {quoted(REFRESH)}, 1) from p),
e as (select node as a, {node(f"({whole})")} as b from t where t <> ''),
u as (select a, b from e where a <> b union select b, a from e where a <> b),
c as (select distinct node as a, node as b from v where node is not null union select c.a, u.b from c join u on c.b = u.a),
s as (select c.a as node, bool_or(v.best = 'block') as blocked, bool_or(v.best = 'allow') as allowed from c join v on v.node = c.b group by c.a)
select page_id, host, path, rule, coalesce(best, case when coalesce(blocked, false) and not coalesce(allowed, false) then 'block' else 'allow' end) as verdict
from v left join s using (node)"""


def quality_sql() -> str:
    share = lambda a, b, unit: f"case when {b} > 0 then {unit} * {a} // {b} else 0 end"
    pairs = " union all ".join(f"select l, s, {quoted(k)} as share, ({k} >> greatest(len(bin({k})) - {BITS}, 0)) << greatest(len(bin({k})) - {BITS}, 0) as value from x where not base_failed" for k in FLOORS)
    floor = " ".join(f"when {quoted(k)} then {v}" for k, v in FLOORS.items())

    noise = " ".join(f"when {quoted(k)} then {v}" for k, v in NOISE.items())

    def level(name: str, by: str) -> str:
        keys = f"{by}, share" if by else "share"
        return f"""{name}_c as (select {keys}, value, count(*) as n from k group by {keys}, value),
{name}_u as (select *, sum(n) over (partition by {keys} order by value) as upto, sum(n) over (partition by {keys}) as total from {name}_c),
{name} as (select {keys}, min(value) filter (upto * 4 >= total) as q1, min(value) filter (upto * 4 >= total * 3) as q3, max(total) as n from {name}_u group by {keys})"""

    def drawn(q: str, group: str, parent: str) -> str:
        return f"(coalesce({group}.n * {group}.{q}, 0) + {PRIOR} * {parent}) // (coalesce({group}.n, 0) + {PRIOR})"

    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as l, coalesce(source, '') as s, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {SPACED}) as w from documents),
ln as (select r, count(*) as n_lines, count(*) - count(distinct y) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as y from d) where regexp_matches(y, {SPACED}) group by r),
gr as (select r, p, w[p : p + 4] as g from (select r, w, unnest(generate_series(1, len(w) - 4)) as p from d where len(w) >= 5)),
tw as (select r, g from gr group by r, g having count(*) > 1),
rp as (select r, count(distinct q) as n_repeat_words from (select r, unnest(generate_series(p, p + 4)) as q from gr join tw using (r, g)) group by r),
m as (select r, doc_id, l, s, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from d left join ln using (r) left join rp using (r)),
x as (select *, {share("n_symbols", "n_words", 1000)} as symbol_share, {share("n_dup_lines", "n_lines", 1000)} as dup_line_share, {share("n_repeat_words", "n_words", 1000)} as repeat_share,
  {share("word_chars", "n_words", 100)} as word_length, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m),
k as ({pairs}),
{level("fo", "l, s")},
{level("fl", "l")},
{level("fa", "")},
f as (select x.r, y.share, {drawn("q1", "fo", drawn("q1", "fl", "fa.q1"))} as q1, {drawn("q3", "fo", drawn("q3", "fl", "fa.q3"))} as q3 from x cross join (select unnest([{", ".join(quoted(k) for k in FLOORS)}]) as share) y
  left join fo on fo.l = x.l and fo.s = x.s and fo.share = y.share left join fl on fl.l = x.l and fl.share = y.share left join fa on fa.share = y.share),
z as (select r, bool_or(coalesce((case share {" ".join(f"when {quoted(k)} then {k}" for k in FLOORS)} end - q3) * n_words > {SPREAD} * greatest(q3 - q1, case share {floor} end) * (n_words + case share {noise} else 0 end), false)) as beyond from x join f using (r) group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or beyond) as kept from x join z using (r)"""


NEAR = f"""
with recursive d as (select doc_id, regexp_extract_all({lower("coalesce(text, '')")}, {SPACED}) as w from documents),
s as (select distinct doc_id, array_to_string(w[p : p + 4], ' ') as g from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * m >= 75 * (na.n + nb.n - m)),
t as (select doc_id as a, doc_id as b from d union select t.a, e.b from t join e on t.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(t.b) as component_id, d.doc_id = min(t.b) as kept from d join t on t.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n"""

TURN = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"
CHAT = f"""
with raw as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
ro as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n from raw),
la as (select conv_id, max(n) as n from ro where role = 'assistant' group by conv_id),
en as (select x.conv_id, x.n, own.turn, other.text from la x join la y on y.conv_id = x.conv_id + 1 join ro own on own.conv_id = x.conv_id and own.n = x.n join ro other on other.conv_id = y.conv_id and other.n = y.n),
t as (select conv_id, false as made, turn, role, text from raw union select ro.conv_id, true, ro.turn, ro.role, ro.text from ro join en on en.conv_id = ro.conv_id and ro.n < en.n union select conv_id, true, turn, 'assistant', text from en),
o as (select *, row_number() over (partition by conv_id, made order by turn nulls first, role nulls first, text nulls first) as n from t),
p as (select distinct c.conv_id as c, c.conv_id + 1 as r, false as made from raw c join raw r on r.conv_id = c.conv_id + 1 where c.conv_id % 2 = 0 union select conv_id, conv_id, true from en),
z as (select p.c, p.r, p.made, greatest(a.n, 0) as n, a.role is not distinct from b.role and a.text is not distinct from b.text and b.n is not null as same from p join o a on a.conv_id = p.c and not a.made left join o b on b.conv_id = p.r and b.made = p.made and b.n = a.n),
k as (select c, r, made, coalesce(min(n) filter (not same) - 1, max(n)) as n from z group by c, r, made),
q as (select c, r, k.made, k.n as cut, side, o.n, role, text, {TURN} as shown, coalesce(sum(case when o.n > k.n then length({TURN}) else 0 end) over (partition by c, r, k.made, side order by o.n rows between unbounded preceding and 1 preceding), 0) as off
  from k join (values (0), (1)) s(side) on true join o on o.conv_id = case side when 0 then k.c else k.r end and o.made = (side = 1 and k.made)),
w as (select *, off + length('<|im_start|>' || coalesce(role, '') || chr(10)) as a from q),
g as (select c, r, made, cut, coalesce(string_agg(shown, '' order by n) filter (side = 0 and n <= cut), '') as prompt,
  coalesce(string_agg(shown, '' order by n) filter (side = 0 and n > cut), '') as chosen, coalesce(string_agg(shown, '' order by n) filter (side = 1 and n > cut), '') as rejected,
  coalesce(string_agg(cast(a as bigint) || '-' || cast(a + length(coalesce(text, '')) as bigint), ',' order by n) filter (side = 0 and n > cut and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg(cast(a as bigint) || '-' || cast(a + length(coalesce(text, '')) as bigint), ',' order by n) filter (side = 1 and n > cut and role = 'assistant'), '') as rejected_spans from w group by c, r, made, cut)
select c as chosen_id, r as rejected_id, made, cut as n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, chosen_spans <> '' and rejected_spans <> '' as usable from g"""

JACCARD = f"""
with recursive d as (select doc_id, regexp_extract_all({lower("coalesce(text, '')")}, {SPACED}) as w from documents),
s as (select distinct doc_id, array_to_string(w[p : p + 3], ' ') as g from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * m >= 85 * (na.n + nb.n - m)),
t as (select doc_id as a, doc_id as b from d union select t.a, e.b from t join e on t.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(t.b) as component_id from d join t on t.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n"""

MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || cast(doc_id as varchar)) as h from documents),
h as (select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
x as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(p) end as bigint) as prefix_chars, cast(case when form <> 'plain' then length(m) end as bigint) as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from x"""

NEGATIVES = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor order by score desc, other) <= 5),
n as (select anchor, positive_id, positive_score, other, score, row_number() over (partition by anchor, positive_id order by score desc, other) as rank from p join s using (anchor)
  where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor as anchor_id, positive_id, cast(rank as integer) as rank, other as negative_id, positive_score, score as negative_score from n where rank <= 5"""
ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op2_chat_formatting": CHAT,
    "op3_license_scan": license_sql(),
    "op4_url_filters": url_sql(),
    "op6_quality_rules": quality_sql(),
    "op8_near_dedup": NEAR,
    "op11_jaccard_join": JACCARD,
    "op12_fill_in_middle": MIDDLE,
    "op13_hard_negatives": NEGATIVES,
}
