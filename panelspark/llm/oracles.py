"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from panelspark.llm.quality_rules import BASE, POLICIES, RULES

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BITS = " + ".join(f"(case when {condition} then {1 << bit} else 0 end)" for bit, (_, condition) in RULES.items())

QUALITY_RULES = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{WORD}') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) as ls from d),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, (select unnest([0, 1, 2]) as k) group by 1),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(len(ls) as bigint) as n_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words, cast(len(regexp_extract_all(t, '[A-Z]{{2,}}')) as bigint) as n_capital_runs
  from w left join cov using (doc_id)),
f as (select *, cast({BITS} as bigint) as failed from m)
select *, (failed & {BASE}) <> 0 as base_failed, (failed & {POLICIES["v2"] | BASE}) = 0 as kept from f
"""

LINE_DEDUP = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos from documents),
n as (select *, row_number() over (partition by doc_id order by pos) as k, count(*) over (partition by doc_id) as c from l where regexp_matches(line, '{WORD}')),
g as (select a.doc_id, a.k, a.line || chr(10) || b.line || chr(10) || c.line as g from n a join n b on b.doc_id = a.doc_id and b.k = a.k + 1 join n c on c.doc_id = a.doc_id and c.k = a.k + 2),
later as (select doc_id, k from (select *, row_number() over (partition by g order by doc_id, k) as r from g) where r > 1),
gone as (select distinct doc_id, k + j as k from later, (select unnest([0, 1, 2]) as j)),
bad as (select doc_id, pos from n join gone using (doc_id, k)),
kept as (select doc_id, string_agg(line, chr(10) order by pos) as t from l anti join bad using (doc_id, pos) group by doc_id),
many as (select doc_id, count(*) as c from gone group by 1), lines as (select doc_id, count(*) as c from n group by 1)
select d.doc_id, cast(coalesce(lines.c, 0) as bigint) as n_lines, cast(coalesce(many.c, 0) as bigint) as n_removed, case when d.text is not null then sha256(coalesce(kept.t, '')) end as kept_sha256
from documents d left join kept using (doc_id) left join many using (doc_id) left join lines using (doc_id)
"""

SUBSTRING_DEDUP = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
g as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w)),
rep as (select doc_id, i from (select *, count(*) over (partition by g) as c from g) where c > 1),
gone as (select distinct doc_id, i + k as i from rep, (select unnest(range(0, 35)) as k)),
each as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from each anti join gone using (doc_id, i) group by doc_id),
many as (select doc_id, count(*) as c from gone group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(c, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id) left join many using (doc_id)
"""

DECONTAMINATION = rf"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
bw as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as g from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from t, lens)),
hits as (select doc_id, i, n, item_id from dw join bw using (n, g)),
cov as (select doc_id, count(distinct i + k) as n_hit from hits, lateral (select unnest(range(0, n)) as k) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by doc_id),
run as (select doc_id, item_id, max(c) as longest from (select doc_id, item_id, count(*) + min(n) - 1 as c from (select h.doc_id, h.item_id, h.n, h.i - x.j as diag, x.j - row_number() over (partition by h.doc_id, h.item_id, h.i - x.j order by x.j) as grp from (select distinct doc_id, item_id, i, n, g from dw join bw using (n, g)) h
  join (select item_id, n, j, array_to_string(ws[j:j + n - 1], ' ') as g from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as j from b where len(ws) > 0)) x on x.item_id = h.item_id and x.g = h.g) group by doc_id, item_id, diag, grp) group by doc_id, item_id),
top as (select doc_id, max(longest) as longest from run group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(longest, 0) as bigint) as longest_match
from t left join cov using (doc_id) left join its using (doc_id) left join top using (doc_id)
"""

JACCARD = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws from documents),
g as (select distinct doc_id, g from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as g from w)),
sizes as (select doc_id, count(*) as n from g group by 1),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as other from w union select reach.doc_id, links.b from reach join links on links.a = reach.other),
least as (select doc_id, min(other) as component_id from reach group by 1)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id from least left join sizes using (doc_id)
"""

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ws from documents),
s as (select count(*) as n_docs, cast(sum(len(ws)) as bigint) as n_terms from d where len(ws) > 0),
t as (select doc_id, w, count(*) as tf from (select doc_id, unnest(ws) as w from d) group by 1, 2),
b as (select item_id, w, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as w from benchmark) group by 1, 2),
weights as (select w, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight from t, s group by w, n_docs),
m as (select doc_id, 100 - 75 + (75 * len(ws) * n_docs) // n_terms as m from d, s where len(ws) > 0),
scores as (select item_id, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from b join t using (w) join weights using (w) join m using (doc_id) group by 1, 2),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 10
"""

ORACLE_SQL = {
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op7_line_dedup": LINE_DEDUP,
    "op8_quality_rules": QUALITY_RULES,
    "op10_benchmark_decontamination": DECONTAMINATION,
    "op11_ranked_lexical_search": LEXICAL_SEARCH,
    "op13_ngram_jaccard_join": JACCARD,
}
