"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8 = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), i as (
  select item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null
), iw as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0)
), dw as (
  select doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from iw) where len(w) >= k)
), m as (
  select distinct doc_id, item_id, p, dw.k as k from dw join iw using (k, g)
), hit as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from m) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item_id from m) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

OP9 = rf"""
with d as (
  select doc_id, coalesce(text, '') as text, coalesce('=' || source, '') as host,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), lines as (
  select doc_id, host, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as nth from d
), worded as (
  select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
), dup as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines from worded group by doc_id
), normal as (
  select host, len(lw) as words,
    regexp_replace(array_to_string(regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') as line,
    doc_id
  from worded
), common as (
  select host, line from normal group by host, line having count(distinct doc_id) > 10
), removed as (
  select doc_id, sum(words) as gone from normal semi join common using (host, line) group by doc_id
), grams as (
  select doc_id, p, array_to_string(w[p : p + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from d where len(w) >= 5)
), again as (
  select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as c from grams) where c > 1
), rep as (
  select doc_id, count(distinct q) as n_repeat_words from (select doc_id, unnest(range(p, p + 5)) as q from again) group by doc_id
), f as (
  select d.doc_id, d.host, d.text, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from d left join dup using (doc_id) left join rep using (doc_id)
)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and n_words - coalesce(gone, 0) >= 10 and n_words - coalesce(gone, 0) >= n_words * 0.2 as kept
from f left join removed using (doc_id)
"""

#: By query.
OP11 = rf"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p
), f as (
  select lang, g, k, count(*) as f
  from (select lang, k, unnest([w[i : i + k - 1] for i in range(1, len(w) - k + 2)]) as g from w, (select unnest(range(1, 6)) as k) where len(w) >= k)
  group by all
), t as (
  select lang, sum(f) as n from f where k = 1 group by lang
), c as (
  select lang, g, k, f as a from f where k > 1 and f >= 100
), cuts as (
  select c.lang, c.g, c.k, a, j, x.f as l, y.f as r, n, (1000 * a::hugeint * n::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from (select *, unnest(range(1, k)) as j from c) c
  join f x on x.lang = c.lang and x.g = c.g[1 : j] join f y on y.lang = c.lang and y.g = c.g[j + 1 : c.k] join t on t.lang = c.lang
), best as (
  select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1
), inner_parts as (
  select distinct lang, g[i : i + m - 1] as g, a from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c where k > 2))
), kept as (
  select * from best where not exists (select 1 from inner_parts h where h.lang = best.lang and h.g = best.g and 100 * h.a >= 100 * best.a)
)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase,
    a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
  from kept
) where rank <= 2000
"""

ORACLE = {"op8_decontamination": OP8, "op9_quality_rules": OP9, "op11_phrases": OP11}
