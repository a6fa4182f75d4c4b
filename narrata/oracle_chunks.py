"""DuckDB SQL of the packers: ends of sentences and paragraphs by place, then chunk after chunk in a recursive query."""

from __future__ import annotations

from narrata.oracle import _CLEAN, _LATIN, _PLAN, _SPANS, _count, _strip
from narrata.oracle_artifacts import _CLOSE as _CLOSERS
from narrata.oracle_artifacts import _WS, _abbreviates

_CLOSE = r"""["''’”\])]*"""


def _trimmed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{_WS}+', ''), '{_WS}+$', '')"


def _packed(cap: int) -> str:
    """Tables over ``pieces (id, text)``: ``taken (id, nth, a, b)``, the chunks of each text."""
    return rf"""
letters as (select id, text, unnest(regexp_extract_all(text, '(?s).')) as c, unnest(range(1, length(text) + 1)) as i from pieces),
marked as (select id, i, c, substring(text, i + 1) as after from letters where c in ('.', '!', '?', chr(10))),
stops as (
  select id, i + length(regexp_extract(after, '^{_CLOSE}{_WS}*')) as pos from marked where c <> chr(10) and regexp_matches(after, '^{_CLOSE}({_WS}|$)')
  union select id, i + length(regexp_extract(after, '^{_WS}*')) from marked where c = chr(10) and regexp_matches(after, '^{_WS}*\n({_WS}|$)')
  union select id, length(text) from pieces
), gaps as (select distinct id, i + length(regexp_extract(after, '^{_WS}*')) as pos from marked where c = chr(10) and regexp_matches(after, '^{_WS}*\n')),
lists as (
  select p.id, length(p.text) as n, coalesce((select list(pos order by pos) from stops s where s.id = p.id), []) as ends,
    coalesce((select list(g.pos order by g.pos) from gaps g join stops s on s.id = g.id and s.pos = g.pos where g.id = p.id), []) as marks from pieces p where p.text <> ''
), taken as (
  select id, 0 as nth, cast(0 as bigint) as a, cast(0 as bigint) as b, n, ends, marks from lists
  union all select id, nth + 1, b, coalesce(list_max(list_filter(marks, lambda x: x > b and x <= least(n, b + {cap}))), list_max(list_filter(ends, lambda x: x > b and x <= least(n, b + {cap}))),
    list_min(list_filter(ends, lambda x: x > least(n, b + {cap}))), n), n, ends, marks from taken where b < n
)"""


_CHAPTER_PIECES = f"""{_PLAN},
chapter_texts as (select book_id, index as chapter_index, start_offset, substring(text, start_offset + 1, end_offset - start_offset) as text, book_id || ':' || index as id from plan),
pieces as (select id, text from chapter_texts)"""
P03_SENTENCE_CHUNKS = f"""with recursive {_CHAPTER_PIECES}, {_packed(300)}
select book_id, chapter_index, row_number() over (partition by book_id order by chapter_index, nth) - 1 as global_index, nth - 1 as local_index, start_offset + a as source_start, start_offset + b as source_end,
  sha256(substring(text, a + 1, b - a)) as text_sha256 from taken join chapter_texts using (id) where nth > 0"""

P04_PARAGRAPH_CHUNKS = rf"""with recursive {_PLAN},
chapter_texts as (
  select book_id, index as chapter_index, start_offset, regexp_replace(substring(text, start_offset + 1, end_offset - start_offset), '\n+', chr(10) || chr(10), 'g') as text, book_id || ':' || index as id from plan
), parted as (select id, text, string_split(regexp_replace(text, '(\n{_WS}*\n{_WS}*)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from chapter_texts where text <> ''),
cuts as (
  select id, length(array_to_string(p[1:k], '')) as pos from (select id, p, unnest(range(2, len(p), 2)) as k from parted) where regexp_matches(regexp_extract(p[k - 1], '[^\n]*$'), '[\p{{L}}\p{{N}}]')
), lists as (
  select t.id, length(text) as n, case when regexp_matches(text, '[\p{{L}}\p{{N}}]') then length(text) - length(regexp_extract(text, '[^\p{{L}}\p{{N}}]*$')) else -1 end as spoken, coalesce((select list(pos order by pos) from cuts c where c.id = t.id), []) as l from parted t
), seqs as (select id, n, list_filter(l, lambda x: x < spoken) || [coalesce(list_min(list_filter(l, lambda x: x >= spoken)), 1000000000000)] as s from lists),
fold as (
  select id, 0 as k, cast(0 as bigint) as b, cast(0 as bigint) as last, cast(null as bigint) as e, s from seqs
  union all select id, k + 1, case when s[k + 1] - b > 300 and last > b then last else b end, s[k + 1], case when s[k + 1] - b > 300 and last > b then last end, s from fold where k < len(s)
), ends as (select id, e from fold where e is not null union all select id, n from seqs),
chunks as (select id, e, lag(e, 1, 0) over w as a, row_number() over w - 1 as nth from ends window w as (partition by id order by e))
select book_id, chapter_index, row_number() over (partition by book_id order by chapter_index, nth) - 1 as global_index, nth as local_index, start_offset + a as source_start, start_offset + e as source_end,
  sha256(substring(text, a + 1, e - a)) as text_sha256 from chunks join chapter_texts using (id)"""

_INTERACTIVE = f"""{_SPANS}, pieces as (select book_id || ':' || ordinal as id, text from spans), {_packed(200)},
spoken as (
  select book_id, chapter_index, row_number() over (partition by book_id order by chapter_index, source_start + a) - 1 as global_index, row_number() over (partition by book_id, chapter_index order by source_start + a) - 1 as local_index,
    source_start + a as source_start, source_start + b as source_end, span_id, speaker_id, case when speaker_id = 'narrator' or book_id % 4 = 1 then 'af_one' else 'am_two' end as voice_id, type as segment_type, substring(text, a + 1, b - a) as text
  from taken t join spans s on t.id = s.book_id || ':' || s.ordinal where nth > 0
)"""
P05_INTERACTIVE_CHUNKS = f"""with recursive {_INTERACTIVE}
select book_id, chapter_index, global_index, local_index, source_start, source_end, span_id, speaker_id, voice_id, segment_type, sha256(text) as text_sha256,
  sha256(cast(to_json(struct_pack(engine := 'fake', revision := 1, segment_type := segment_type, span_id := span_id, text := text, voice_id := voice_id)) as varchar)) as input_hash,
  sha256(cast(to_json(struct_pack(engine := 'fake', segment_type := segment_type, text := text, voice_id := voice_id)) as varchar)) as audio_input_hash from spoken"""
J18_PLAN_MATCHES = f"""with recursive {_INTERACTIVE}, r as (select book_id, ordinal as global_index, chapter_index, ordinal % 4 as local_index, sha256(text) as h from turns),
p as (select book_id, global_index, chapter_index, local_index, sha256(text) as h from spoken)
select book_id, bool_and(coalesce(r.h = p.h and r.chapter_index = p.chapter_index and r.local_index = p.local_index, false)) as matches from r full join p using (book_id, global_index) group by book_id"""

T19_FLOWED_PARAGRAPHS = rf"""with split as (select doc_id as book_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
paged as (
  select book_id, array_to_string(list_transform(range(0, (len(l) + 4) // 5), lambda k: case when k % 3 = 0 then 'Chapter ' || (k // 3 + 1) || chr(10) else '' end || array_to_string(l[k * 5 + 1 : k * 5 + 5], chr(10))),
    chr(10) || chr(10)) as text from split
), blocks as (select book_id, list_transform(string_split_regex(text, '\n{_WS}*\n+'), lambda x: string_split(x, chr(10))) as blocks from paged),
headed as (
  select book_id, list_transform(blocks, lambda b: struct_pack(b := b, heads := coalesce(list_position(list_transform(b[1 : len(b) - 1],
    lambda x: regexp_matches({_trimmed('x')}, '(?i)^(?:chapter|part|section)(?:{_WS}+.*)?$')), false) - 1, len(b) - 1))) as blocks from blocks
), flowed as (
  select book_id, list_filter(flatten(list_transform(blocks, lambda x: list_transform(x.b[1 : x.heads], lambda h: {_trimmed('h')})
    || [{_trimmed("array_to_string(list_transform(x.b[x.heads + 1 : len(x.b)], lambda y: trim(y, ' ' || chr(9))), ' ')")}])), lambda y: y <> '') as p from headed
) select book_id, cast(len(p) as integer) as n, sha256(array_to_string(p, chr(10))) as p_sha256 from flowed"""


P01_CUSTOM_PLAN = rf"""with {_CLEAN}, b as (select book_id, text, length(text) as n, {_count('text', _LATIN)} as total from whole where text <> ''),
stops as (
  select book_id, text, i, stop, substring(text, i + 1) as after from (select book_id, text, unnest(regexp_extract_all(text, '(?s).')) as stop, unnest(range(1, length(text) + 1)) as i from b) where stop in ('.', '!', '?')
), ended as (
  select book_id, i + length(regexp_extract(after, '^{_CLOSERS}{_WS}*')) as pos, stop, reverse(regexp_extract(reverse(left(text, i - 1)), '^[\p{{L}}.]*')) as token from stops where regexp_matches(after, '^{_CLOSERS}({_WS}|$)')
), blank as (
  select book_id, length(array_to_string(p[1:k], '')) as pos from (select book_id, p, unnest(range(2, len(p), 2)) as k from (select book_id, string_split(regexp_replace(text, '(\n{_WS}*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from b))
), lines as (select book_id, l, unnest(range(1, len(l) + 1)) as k from (select book_id, string_split(text, chr(10)) as l from b)),
heads as (
  select book_id, k - 1 + coalesce(list_sum(list_transform(l[1:k - 1], lambda x: length(x))), 0) + length(l[k]) - length(regexp_replace(l[k], '^{_WS}+', '')) as pos, {_strip('l[k]')} as title from lines
  where regexp_matches({_strip('l[k]')}, '(?i)^(?:chapter|part|section)\b(?:\s+.*)?$') or (upper(l[k]) = l[k] and lower(l[k]) <> l[k] and {_count('l[k]', _LATIN)} between 2 and 10)
), ranked as (
  select book_id, pos, min(rank) as rank, max(title) as title from (
    select book_id, pos, 2 as rank, null as title from ended where not (stop = '.' and {_abbreviates('token')}) union all select book_id, pos, 1, null from blank union all select book_id, cast(pos as bigint), 0, title from heads) group by book_id, pos
), places as (
  select r.book_id, pos, rank, title, total, {_count('left(text, pos)', _LATIN)} as words, row_number() over (partition by r.book_id order by pos) - 1 as i, count(*) over (partition by r.book_id) as np, greatest(10.0, least(total / 3 / 2, 40.0)) as near
  from ranked r join b using (book_id) where pos > 0 and pos < n
), one as (
  select *, abs(words - total * 1 / 3) as away from places where np >= 2 and i < np - 1
  qualify row_number() over (partition by book_id order by case when away <= near then case when rank = 0 then 0 else 1 end else 2 end, rank, away, pos) = 1
), two as (
  select p.*, abs(p.words - p.total * 2 / 3) as away from places p join one o on o.book_id = p.book_id and p.i > o.i
  qualify row_number() over (partition by p.book_id order by case when abs(p.words - p.total * 2 / 3) <= p.near then case when p.rank = 0 then 0 else 1 end else 2 end, p.rank, abs(p.words - p.total * 2 / 3), p.pos) = 1
), starts as (
  select book_id, cast(0 as bigint) as pos, (select title from heads h where h.book_id = o.book_id and h.pos = 0) as title, case when exists (select 1 from heads h where h.book_id = o.book_id and h.pos = 0) then 'heading' else 'custom' end as source_type from one o
  union all select book_id, pos, title, case when rank = 0 then 'heading' else 'custom' end from one union all select book_id, pos, title, case when rank = 0 then 'heading' else 'custom' end from two
)
select book_id, cast(row_number() over w as integer) as index, coalesce(title, printf('Chapter %02d', row_number() over w)) as title, pos as start_offset, coalesce(lead(pos) over w, n) as end_offset, source_type
from starts join b using (book_id) window w as (partition by book_id order by pos)"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name.lower(): sql for name, sql in globals().items() if name[0] != "_" and name.isupper() and isinstance(sql, str)}
