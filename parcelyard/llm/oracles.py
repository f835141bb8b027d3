"""DuckDB SQL for the queries that SQL can say."""

from __future__ import annotations

from . import quality_rules, secret_ledger

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1() -> str:
    """Base statistics, then cutoffs by exact binomial tails, as in quality_rules."""
    strata_tests = len(quality_rules.RULES)
    grid = " union all ".join(f"select '{r}' as rule, {str(high).lower()} as high, unnest([{', '.join(map(repr, cs))}]::double[]) as c" for r, (_, high, cs) in quality_rules.RULES.items())

    def value(expr: str) -> str:
        return expr.replace("s_n_", "n_").replace("s_word_chars", "word_chars")

    values = " union all ".join(f"select doc_id, stratum, base_failed, '{r}' as rule, ({value(e)})::double as x from s" for r, (e, _, _) in quality_rules.RULES.items())
    chars = lambda c: f"strlen(regexp_replace(t, '[^{c}]', '', 'g'))"
    return rf"""
with recursive d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, {WORDS} as w, string_split(coalesce(text, ''), chr(10)) as lines from documents),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
win as (select doc_id, i, array_to_string(w[i : i + 4], ' ') as s from pos where i + 4 <= len(w)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from again) group by doc_id),
ln as (select doc_id, unnest(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as l from d),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n from ln group by doc_id),
s as (select d.doc_id, stratum, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  {chars("#*$%&|<>")}::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines,
  {chars("A-Z")} as n_upper, {chars("a-z")} as n_lower, {chars("0-9")} as n_digits, {chars("!")} as n_exclaim,
  len(w) < 10 or 100 * coalesce(rep.n, 0) > 20 * len(w) as base_failed
  from d left join rep using (doc_id) left join dup using (doc_id)),
v as ({values}),
grid as ({grid}),
lab as (select v.stratum, v.rule, v.x, l.quality as q from v join labels l using (doc_id) where not v.base_failed and l.quality in (0, 1)),
cnt as (select lab.stratum, grid.rule, high, c, sum(case when (high and x > c) or (not high and x < c) then q else 0 end) as good,
  sum(case when (high and x > c) or (not high and x < c) then 1 - q else 0 end) as bad, sum(q) as n from lab join grid using (rule) group by all),
par as (select {quality_rules.DELTA} / (count(distinct stratum) * {strata_tests}) as delta, {quality_rules.ALPHA} / {len(quality_rules.RULES)} as a from lab),
tails as (select good, n, case when good >= n then 1.0 else list_sum(list_transform(range(0, good::bigint + 1), lambda i: exp(lgamma(n + 1) - (case when i = 0 then 0 else lgamma(i + 1) end) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a)))) end as tail
  from (select distinct good, n from cnt where good <= n * {quality_rules.ALPHA}), par),
best as (select stratum, rule, high, c from cnt join tails using (good, n), par where tail <= delta and bad > 4.0 * good
  qualify row_number() over (partition by stratum, rule order by bad - 4.0 * good desc, case when high then -c else c end desc) = 1),
hit as (select distinct v.doc_id from v join best using (stratum, rule) where (best.high and x > best.c) or (not best.high and x < best.c))
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and hit.doc_id is null as kept
from s left join hit using (doc_id)"""


def op2() -> str:
    return rf"""
with recursive d as (select doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from sh group by doc_id),
links as (select a.doc_id as x, b.doc_id as y from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach as (select doc_id as x, doc_id as y from d union select reach.x, links.y from reach join links on reach.y = links.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.y as component_id from d left join n using (doc_id) join (select x, min(y) as y from reach group by x) c on c.x = d.doc_id"""


def op4() -> str:
    kinds = []
    for rank, r in enumerate(secret_ledger.RULES):
        p = r.pattern.replace("'", "''")
        kinds.append(f"select doc_id, {rank} as rank, '{r.kind}' as kind, {r.least} as least, {r.group} as grp, '{p}' as p, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as hits, {f"regexp_extract_all(t, '{p}', {r.group})"} as vals from t")
    base = "kind in ('assign', 'access', 'hex')"
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
k as ({" union all ".join(kinds)}),
m as (select *, unnest(range(1, len(hits) + 1)) as i from k),
sp as (select doc_id, rank, kind, s, s + length(hits[i]) as e from (select *, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0))::bigint as s from m where length(vals[i]) >= least)),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter ({base}) as b, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from sp group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from t left join g using (doc_id)"""


def op5() -> str:
    words = rf"regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select doc_id, {words} as w from documents), b as (select item_id, {words} as w from benchmark),
iw as (select distinct item_id, least(8, len(w)) as n, unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda i: array_to_string(w[i : i + least(8, len(w)) - 1], ' '))) as s from b where len(w) > 0),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from iw))),
hit as (select doc_id, item_id, dw.i, dw.n from dw join iw on dw.n = iw.n and dw.s = iw.s),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as l from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(cov.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(its.n, 0) >= 2 as contaminated
from d left join cov using (doc_id) left join its using (doc_id)"""


def op7() -> str:
    return """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d)),
m as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as f from w) where f < doc_id),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from m),
r as (select doc_id, min(i) as a, max(i) + 50 as b from (select *, sum(new) over (partition by doc_id order by i) as k from g) group by doc_id, k),
q as (select doc_id, count(*) as n_spans, sum(b - a) as gone, list(b order by a) as bs, list(a order by a) as as_ from r group by doc_id)
select d.doc_id, d.n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when q.doc_id is null then h else array_to_string(list_transform(range(1, len(bs) + 2), lambda k: substr(h, 2 * (case when k = 1 then 0 else bs[k - 1] end) + 1, 2 * ((case when k > len(bs) then d.n else as_[k] end) - (case when k = 1 then 0 else bs[k - 1] end)))), '') end)) as kept_sha256
from d left join q using (doc_id)"""


def op8() -> str:
    return """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as n, sha256(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as m from p where n >= 100 group by h)
select page_id, n as payload_bytes, p.h as payload_digest, case when m is null or m = page_id then 'response' else 'revisit' end as record_type, case when m <> page_id then m end as refers_to from p left join f using (h)"""


def op10() -> str:
    return f"""
with d as (select doc_id, {WORDS} as w from documents),
x as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
m as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as f from x) where f < doc_id),
c as (select distinct doc_id, unnest(range(i, i + 50)) as p from m),
k as (select doc_id, w[p] as v, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d) anti join c using (doc_id, p)),
o as (select doc_id, string_agg(v, ' ' order by p) as t from k group by doc_id), r as (select doc_id, count(*) as n from c group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(r.n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join o using (doc_id) left join r using (doc_id)"""
