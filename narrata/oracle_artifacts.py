"""DuckDB SQL of the queries of artifacts."""

from __future__ import annotations

from narrata.oracle import _CLEAN, _LATIN, _PAGES, _PLAN, _SPANS, _count, _strip
from narrata.oracle import F03_PAGE_COVERAGE as _F03

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ANALYSES = f"""{_SPANS}, s as (
  select book_id, source_start, text, struct_pack(chapter_index := chapter_index,
    confidence := struct_pack(band := band, reasons := [band, left(text, 24)], score := length(text) / 1000.0::double),
    provenance := struct_pack(quote_id := case when type = 'dialogue' then 'q.' || span_id end, source := 'turns'),
    source_end := source_end, source_start := source_start, span_id := span_id, speaker_id := case when band <> 'low' then speaker_id end, type := type) as span from spans
), g as (
  select book_id, list(span order by source_start, span.source_end, span.span_id) as spans, arg_min(text, source_start) as title from s group by book_id
), artifacts as (
  select book_id, struct_pack(analyzer := struct_pack(id := 'rules', model_hash := null::varchar, version := '1'), artifact := 'speaker-analysis', revision := 3, schema_version := 1,
    spans := spans, title := title, warnings := ['«' || right(title, 9) || '» "' || chr(92)]) as a from g
), hashed as (select book_id, a, sha256(cast(to_json(a) as varchar) || chr(10)) as h from artifacts)"""

T41_ARTIFACT_DIGEST = f"with {_ANALYSES} select book_id, h as canonical_artifact_sha256 from hashed"
T43_HASH_VIOLATIONS = f"""with {_ANALYSES}, c as (
  select book_id, case when book_id % 7 = 1 then upper(h) when book_id % 13 <> 6 then h end as given, book_id % 11 = 3 and book_id % 5 <> 2 as lost,
    case when book_id % 5 = 2 then sha256(replace(cast(to_json(a) as varchar), cast(to_json(a.spans[-1].confidence.reasons) as varchar), '["changed"]')) else h end as computed from hashed)
select book_id, case when lost then 'INVALID_ARTIFACT' when given is null or not regexp_full_match(given, '[0-9a-f]{{64}}') then 'INVALID_ARTIFACT_HASH' else 'ARTIFACT_HASH_MISMATCH' end as rule
from c where lost or given is null or not regexp_full_match(given, '[0-9a-f]{{64}}') or given <> computed"""

_VOICES = """v as (
  select c_name as voice_id, abs(c_acctbal) / 4000.0::double as speed, case when c_custkey % 5 <> 0 then cast(c_custkey % 9 - 4 as integer) end as pitch_semitones, c_custkey % 5 = 0 as old,
    case when c_custkey % 5 <> 0 and c_custkey % 17 <> 1 then case c_mktsegment when 'BUILDING' then 'bright' when 'MACHINERY' then 'loud' else 'warm' end end as tone_preset,
    struct_pack(enabled := true, engine := 'fake', id := c_name, sample_rate := 24000, voice_version := c_nationkey) as facts from customer
), judged as (
  select *, case when not old and (pitch_semitones is null or tone_preset is null) then 'INVALID_VOICE_SETTINGS' when speed not between 0.5 and 2 then 'INVALID_SPEED'
    when not old and pitch_semitones not between -3 and 3 then 'INVALID_PITCH' when not old and tone_preset not in ('neutral', 'warm', 'bright') then 'INVALID_TONE' end as rule,
    struct_pack(pitch_semitones := coalesce(pitch_semitones, 0), speed := speed, tone_preset := coalesce(tone_preset, 'neutral')) as settings from v)"""
T46_SETTINGS_DIGEST = f"with {_VOICES} select voice_id, case when rule is null then sha256(cast(to_json(settings) as varchar)) else '' end as settings_sha256 from judged"
M15_SETTINGS_VIOLATIONS = f"with {_VOICES} select voice_id, rule from judged where rule is not null"
T47_PREVIEW_KEYS = f"""with {_VOICES} select voice_id, case when rule is null then sha256(cast(to_json(struct_pack(generation_facts := facts, settings := settings, shaping_fingerprint := 'shape-1',
  text := 'This is a short voice preview for your audiobook.', text_version := 'preview-text-v1', voice := voice_id)) as varchar)) else '' end as preview_key from judged"""
T48_DESCRIPTOR_DIGEST = """select s_name as name, sha256(cast(to_json(struct_pack(duration_seconds := s_acctbal, name := s_name,
  note := case when s_suppkey % 3 <> 0 then '"ü" ' || s_suppkey end, sample_rate := 24000, schema_version := 1)) as varchar)) as descriptor_sha256 from supplier"""


def _spoken(revision: int, speaker: str = "speaker_id") -> str:
    facts = "struct_pack(enabled := true, engine := 'fake', id := 'voice_' || sp, sample_rate := 24000)"
    audio = f"""boundary_policy := 'sentence_paragraph_safe', chapter_index := chapter_index, chunk_cap := 300, generation_facts := {facts}, mode := 'interactive_voices', {{more}}segment_type := type,
      shaping_fingerprint := 'shape-1', source_end := source_end, source_start := source_start, span_id := span_id, speaker_id := sp, text := text, voice_id := 'voice_' || sp, {{last}}
      voice_settings := struct_pack(pitch_semitones := length(sp) % 3, speed := 1.25::double, tone_preset := 'warm')"""
    plan = f"voice_plan_canonical_hash := sha256(cast(book_id as varchar)), voice_plan_revision := {revision},"
    return f"""(select book_id, chapter_index, ordinal as global_index, ordinal % 4 as local_index, span_id, sp as speaker_id, text,
      sha256(cast(to_json(struct_pack({audio.format(more="", last="")})) as varchar)) as audio_input_hash,
      sha256(cast(to_json(struct_pack({audio.format(more="registry_revision := repeat('r', 64), ", last=plan)})) as varchar)) as input_hash from (select *, {speaker} as sp from spans))"""


T45_INTERACTIVE_HASHES = f"with {_SPANS} select book_id, span_id, audio_input_hash, input_hash from {_spoken(2)}"
_NEW_SPEAKER = "case when band = 'low' then 'narrator' else speaker_id end"
J17_REUSE_AUDIO = f"""with {_SPANS}, plan as {_spoken(2, _NEW_SPEAKER)}, log as {_spoken(1)}
select p.book_id, p.global_index, p.speaker_id, coalesce(case when l.global_index % 9 <> 4 and length(l.text) > 0 then sha256(l.text) end, '') as wav_sha256,
  coalesce(case when l.global_index % 9 <> 4 and length(l.text) > 0 then length(l.text) / 15.0::double end, 0) as duration_seconds
from plan p left join log l using (book_id, chapter_index, global_index, local_index, audio_input_hash)"""
J17_MOVED_AUDIO = f"""with {_SPANS}, r as (
  select book_id, speaker_id, text, min(ordinal) as first from spans where ordinal % 9 <> 4 group by all)
select s.book_id, -s.ordinal as global_index, coalesce(sha256(format('span-{{:05d}}', r.first)), '') as wav_sha256, coalesce(case when r.first is not null then length(s.text) / 15.0::double + 1 end, 0) as duration_seconds
from spans s left join r using (book_id, speaker_id, text)"""



#: White space, what closes a sentence, and abbreviations, as patterns of DuckDB.
_WS, _CLOSE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]", r"""["''”’)\]}]*"""
_IN_LINE = r"[ \t\r\f\p{Z}\x0b\x1c-\x1f\x85]"
_SHORT = "'mr', 'mrs', 'ms', 'dr', 'prof', 'sr', 'jr', 'st', 'vs', 'etc', 'fig', 'e.g', 'i.e'"


def _abbreviates(token: str) -> str:
    return rf"(lower({token}) in ({_SHORT}) or regexp_full_match(lower({token}), '([a-z]\.)+[a-z]') or (length(lower({token})) = 1 and {token} <> '.'))"


def _line_start(text: str, at: str) -> str:
    return rf"regexp_matches(left({text}, {at}), '(^|\n){_IN_LINE}*$')"


def _sentence_start(text: str, at: str) -> str:
    """Whether the text before an offset ends a sentence; paragraphs and headings begin at line starts or page starts."""
    before = f"left({text}, {at})"
    token = rf"regexp_extract({before}, '([\p{{L}}.]*)\.{_CLOSE}{_WS}+$', 1)"
    return rf"""(not regexp_matches(substring({text}, {at} + 1, 1), '{_WS}') and regexp_matches({before}, '[.!?]{_CLOSE}{_WS}+$')
      and not (regexp_matches({before}, '\.{_CLOSE}{_WS}+$') and {_abbreviates(token)}))"""


def _paragraph_start(text: str, at: str) -> str:
    return rf"(regexp_matches(left({text}, {at}), '\n{_WS}*\n$') and not regexp_matches(substring({text}, {at} + 1), '^{_WS}*\n'))"


def _heading_start(text: str, at: str) -> str:
    line = rf"regexp_extract(substring({text}, {at} + 1), '^[^\n]*')"
    words = _count(line, _LATIN)
    return rf"""({_line_start(text, at)} and not regexp_matches(substring({text}, {at} + 1, 1), '{_WS}') and (regexp_matches({_strip(line)}, '(?i)^(?:chapter|part|section)\b(?:\s+.*)?$')
      or (upper({line}) = {line} and lower({line}) <> {line} and {words} between 2 and 10)))"""


T15_SENTENCE_STARTS = rf"""with b as (select doc_id as book_id, coalesce(text, '') as text from documents),
stops as (
  select book_id, text, i, stop, substring(text, i + 1) as after from (select book_id, text, unnest(regexp_extract_all(text, '(?s).')) as stop, unnest(range(1, length(text) + 1)) as i from b) where stop in ('.', '!', '?')
), ended as (
  select book_id, i + length(regexp_extract(after, '^{_CLOSE}{_WS}*')) as pos, stop, reverse(regexp_extract(reverse(left(text, i - 1)), '^[\p{{L}}.]*')) as token from stops where regexp_matches(after, '^{_CLOSE}({_WS}|$)')
), blank as (
  select book_id, length(array_to_string(p[1:k], '')) as pos from (select book_id, p, unnest(range(2, len(p), 2)) as k
    from (select book_id, string_split(regexp_replace(text, '(\n{_WS}*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from b))
), starts as (
  select distinct book_id, pos from (select book_id, pos from ended where not (stop = '.' and {_abbreviates('token')}) union all select book_id, pos from blank)
)
select book_id, cast(count(pos) as integer) as n, sha256(coalesce(string_agg(cast(pos as varchar), ',' order by pos), '')) as at_sha256 from b left join starts using (book_id) group by book_id"""

_MAPPED = f"""{_PLAN},
edges as (select book_id, index, unnest([start_offset, greatest(start_offset, end_offset - 1)]) as off from plan),
paged as (
  select e.book_id, index, off, arg_min(number, (case when off >= cleaned_start and off < cleaned_end then -1 else least(abs(off - cleaned_start), abs(off - cleaned_end)) end) * 100000000 + cleaned_start) as page
  from (select distinct * from edges) e join clean using (book_id) group by all
), listed as (
  select p.book_id, index, title, start_offset, end_offset, arg_min(page, off) as start_page, arg_max(page, off) as end_page, source_type, text,
    {_count('substring(text, start_offset + 1, end_offset - start_offset)', _LATIN)} as word_count, count(*) over (partition by p.book_id) as n_chapters
  from plan p join paged using (book_id, index) group by p.book_id, index, title, start_offset, end_offset, source_type, text
)"""
P02_PLAN_ARTIFACTS = f"""with {_MAPPED} select book_id, 'original' as mode, sha256(text) as cleaned_text_sha256, cast(n_chapters as integer) as n_chapters, index, title, start_offset, end_offset,
  start_page, end_page, source_type, word_count from listed"""

_CHAPTER_RULES = [
    ("INVALID_PLAN", "index", "index", "index = position + 1"),
    ("INVALID_PLAN", "title", "title", rf"({_strip('title')}) <> '' and not regexp_matches(title, '[\x00-\x1f]')"),
    ("INVALID_PLAN", "source_type", "source_type", "source_type <> ''"),
    ("INVALID_PLAN", "contiguous", "start_offset", "start_offset = expected and end_offset > start_offset"),
    ("INVALID_PLAN", "page_order", "start_page", "start_page >= 1 and end_page >= start_page"),
    ("INVALID_PLAN", "range", "end_offset", "end_offset <= n"),
    ("INVALID_PLAN", "pages", "start_page", "start_page = page_a and end_page = page_b"),
    ("INVALID_PLAN", "words", "word_count", f"word_count = {_count('substring(text, start_offset + 1, end_offset - start_offset)', _LATIN)}"),
    ("UNSAFE_BOUNDARY", "boundary", "start_offset", "is_safe"),
]
_CHAPTER_SQL = " union all ".join(f"select book_id, '{code}' as code, '{rule}' as rule, '$.chapters[' || position || '].{field}' as path from judged where not ({holds})" for code, rule, field, holds in _CHAPTER_RULES)
V02_PLAN_VIOLATIONS = f"""with {_MAPPED}, hurt as (
  select book_id, book_id % 10 as kind, index - 1 as position, n_chapters - case when book_id % 10 = 9 then 1 else 0 end as n_chapters, text, length(text) as n,
    case when book_id % 10 = 8 and index = n_chapters then 99 else index end as index, case when book_id % 10 = 4 and index = 1 then ' ' || chr(9) else title end as title,
    case when book_id % 10 = 5 and index = 2 then start_offset + 2 else start_offset end as start_offset, end_offset, start_page,
    case when book_id % 10 = 7 and index = n_chapters then end_page + 1 else end_page end as end_page, case when book_id % 10 = 8 and index = n_chapters then '' else source_type end as source_type,
    case when book_id % 10 = 6 and index = n_chapters then word_count + 1 else word_count end as word_count, index = n_chapters as was_last from listed
), stay as (select *, coalesce(lag(end_offset) over (partition by book_id order by position), 0) as expected from hurt where not (kind = 9 and was_last)),
asked as (select distinct book_id, unnest([start_offset, greatest(start_offset, end_offset - 1)]) as off from stay),
answers as (
  select book_id, off, arg_min(number, (case when off >= cleaned_start and off < cleaned_end then -1 else least(abs(off - cleaned_start), abs(off - cleaned_end)) end) * 100000000 + cleaned_start) as page
  from asked join clean using (book_id) group by all
), judged as (
  select s.*, a.page as page_a, b.page as page_b, start_offset in (0, n) or exists (select 1 from clean c where c.book_id = s.book_id and c.cleaned_start = s.start_offset) or {_sentence_start('text', 'start_offset')}
      or {_paragraph_start('text', 'start_offset')} or {_heading_start('text', 'start_offset')} or (source_type in ('outline', 'heading', 'explicit', 'layout') and {_line_start('text', 'start_offset')}) as is_safe
  from stay s join answers a on a.book_id = s.book_id and a.off = start_offset join answers b on b.book_id = s.book_id and b.off = greatest(start_offset, end_offset - 1)
), found as (
  {_CHAPTER_SQL}
  union all select distinct book_id, 'HASH_MISMATCH', 'hash', '$.cleaned_text_sha256' from hurt where kind = 1
  union all select distinct book_id, 'INVALID_PLAN', 'schema_version', '$.schema_version' from hurt where kind = 2
  union all select distinct book_id, 'INVALID_PLAN', 'requested_count', '$.requested_count' from hurt where kind = 3
  union all select distinct book_id, 'INVALID_PLAN', 'chapters', '$.chapters' from hurt where n_chapters = 0
  union all select book_id, 'INVALID_PLAN', 'coverage', '$.chapters' from stay group by book_id having max(end_offset) <> max(n)
)
select book_id, code, rule, count(*) as n, min(path) as first_path from found group by book_id, code, rule"""

V01_MAPPING_VIOLATIONS = f"""with {_CLEAN}, m as (
  select book_id, book_id % 6 as kind, row_number() over w - 1 as position, count(*) over (partition by book_id) as pages, number, cleaned_start, cleaned_end from clean window w as (partition by book_id order by number)
), odd as (
  select book_id, position, case when kind = 3 and position = 0 then 0 else number end as source_page,
    case when kind = 1 and position = 1 then cleaned_start - 3 when kind = 4 and position = 0 then 1 else cleaned_start end as s,
    case when kind = 2 and position = pages - 1 then cleaned_end + 1 when kind = 5 and position = 1 then cleaned_start else cleaned_end end as e from m where book_id % 12 <> 7
), seen as (
  select o.*, length(w.text) as n, lag(s) over p as bs, lag(e) over p as be, position = 0 as head, lead(s) over p is null as tail
  from odd o join whole w using (book_id) window p as (partition by book_id order by position)
)
select book_id, 'INVALID_MAPPING' as code, 'range' as rule, '$.cleaned_map[' || position || ']' as path from seen where not (source_page >= 1 and s >= 0 and e > s and e <= n)
union all select book_id, 'INVALID_MAPPING', 'order', '$.cleaned_map[' || position || ']' from seen where s < coalesce(bs, -1) or s < coalesce(be, 0)
union all select book_id, 'INVALID_MAPPING', 'coverage', '$.cleaned_map[' || position || ']' from seen where (head and s <> 0) or (tail and e <> n)
union all select book_id, 'INVALID_MAPPING', 'empty', '$.cleaned_map' from whole where book_id % 12 = 7"""

_FOLD = "replace(lower({}), 'ß', 'ss')"
_COMPACT = rf"regexp_replace({{}}, '{_WS.replace('{', '{{').replace('}', '}}')}+', ' ', 'g')"
J05_CANDIDATE_OFFSETS = f"""with {_CLEAN},
page_lines as (select book_id, number, cleaned_start, cleaned_end, string_split(left(text, cleaned_end - cleaned_start), chr(10)) as lines from clean),
each_line as (select *, unnest(range(0, len(lines))) as i from page_lines),
ln as (select book_id, number, cleaned_start, cleaned_end, i, lines[i + 1] as line, cast(cleaned_start + i + coalesce(list_sum(list_transform(lines[1:i], lambda x: length(x))), 0) as bigint) as pos from each_line where lines[i + 1] <> ''),
cand as (
  select *, number || '-' || i as candidate_id, (number * 5 + i) % 6 as kind, {_strip("case (number * 5 + i) % 6 when 0 then translate(left(line, 40), '" + _LOWER + "', '" + _UPPER + "') when 1 then 'an outline' when 2 then translate(left(line, 40), '" + _UPPER + "', '" + _LOWER + "') when 3 then replace(left(line, 40), ' ', '  ') when 4 then substring(line, 9, 24) else 'no such title' end")} as title from ln
), c as (
  select cand.*, text, {_FOLD.format('title')} as ft from cand join whole using (book_id) where title <> ''
), tries as (
  select book_id, candidate_id, 0 as step, 0 as nth, pos as off, text, false as sure from c where kind = 0 and pos < length(text) and {_FOLD.format('substring(text, pos + 1, length(title))')} = ft
  union all select book_id, candidate_id, 0, 0, pos + 1, text, false from c where kind = 2 and pos + 1 < length(text) and {_FOLD.format('substring(text, pos + 2, length(title))')} = ft
  union all select book_id, candidate_id, 1, 0, cleaned_start, text, true from c where kind = 1
  union all select book_id, candidate_id, 2, 0, cleaned_start + instr(substring({_FOLD.format('text')}, cleaned_start + 1, cleaned_end - cleaned_start), ft) - 1, text, false from c
    where kind > 0 and instr(substring({_FOLD.format('text')}, cleaned_start + 1, cleaned_end - cleaned_start), ft) > 0
  union all select c.book_id, c.candidate_id, 3, l.i, l.pos + length(l.line) - length(regexp_replace(l.line, '^{_WS}+', '')), text, false from c join ln l on l.book_id = c.book_id and l.number = c.number
    where kind > 0 and contains({_FOLD.format(_COMPACT.format(_strip('l.line')))}, {_COMPACT.format('ft')})
), good as (
  select book_id, candidate_id, step, nth, off from tries t where sure or off in (0, length(text)) or {_line_start('text', 'off')} or {_sentence_start('text', 'off')}
    or exists (select 1 from clean p where p.book_id = t.book_id and p.cleaned_start = t.off)
), best as (select book_id, candidate_id, arg_min(off, step * 1000000 + nth) as off, min(step) as step from good group by all)
select book_id, candidate_id, coalesce(off, -1) as "offset", coalesce(['direct', 'outline', 'search', 'line'][step + 1], '') as step from cand left join best using (book_id, candidate_id)"""
J04_PAGE_SEGMENTS = f"""with {_CLEAN} select book_id, cast((number + 1) // 2 as integer) as source_page, min(cleaned_start) as segment_start, max(cleaned_end) as segment_end from clean group by all"""



_SPAN_FACTS = [
    ("INVALID_RANGE", "range", "source_start", "source_start >= 0 and source_end > source_start"),
    ("INVALID_CONFIDENCE", "score", "confidence.score", "score between 0 and 1"),
    ("INVALID_CONFIDENCE_BAND", "band", "confidence.band", "band in ('low', 'medium', 'high')"),
    ("UNORDERED_SPANS", "order", "source_start", "source_start >= coalesce(before_start, -1)"),
    ("OVERLAPPING_SPANS", "overlap", "source_start", "source_start < coalesce(before_start, -1) or source_start >= coalesce(before_end, -1)"),
    ("INVALID_CHAPTER_INDEX", "chapter", "chapter_index", "c_start is not null"),
    ("CROSS_CHAPTER", "chapter", "source_start", "c_start is null or (source_start >= c_start and source_end <= c_end)"),
]


def _facts(table: str, rules: list[tuple[str, str, str, str]]) -> str:
    return " union all ".join(f"select book_id, '{code}' as code, '{rule}' as rule, path || '.{field}' as path from {table} where not coalesce(({holds}), false)" for code, rule, field, holds in rules)


_COUNTED = "select book_id, code, rule, count(*) as n, min(path) as first_path from found group by book_id, code, rule"
V06_ANALYSIS_VIOLATIONS = f"""with {_SPANS}, books as (select distinct book_id, book_id % 12 as kind from spans),
placed as (
  select book_id, book_id % 12 as kind, row_number() over w - 1 as pos, count(*) over (partition by book_id) as n, source_start, source_end, span_id, chapter_index, speaker_id, band from spans
  window w as (partition by book_id order by source_start, source_end, span_id)
), hurt as (
  select * replace (case when kind = 7 and pos = 1 then source_start - 1 else source_start end as source_start, case when kind = 8 and pos = 2 then 99 else chapter_index end as chapter_index,
    case when kind = 6 and pos = n - 1 then 'sure' else band end as band), case when kind = 6 and pos = n - 1 then 1.5 else 0.5 end as score from placed
), seen as (
  select h.*, lag(h.source_start) over w as before_start, lag(h.source_end) over w as before_end, c.start_offset as c_start, c.end_offset as c_end, '$.spans[' || pos || ']' as path
  from hurt h left join chapters c using (book_id, chapter_index) window w as (partition by h.book_id order by pos)
), people as (
  select book_id, kind, character_id, row_number() over (partition by book_id order by character_id) - 1 as pos, count(*) over (partition by book_id) as n
  from (select distinct book_id, book_id % 12 as kind, case when book_id % 12 = 3 and speaker_id = 'user' then 'narrator' else speaker_id end as character_id from spans where speaker_id <> 'narrator')
), found as (
  {_facts('seen', _SPAN_FACTS)}
  union all select book_id, 'CHAPTER_OUTSIDE_ANALYZED_RANGE', 'scope', path || '.chapter_index' from seen where kind = 9 and chapter_index <> 1
  union all select book_id, 'UNKNOWN_SPEAKER_REFERENCE', 'reference', path || '.speaker_id' from seen s where speaker_id <> 'narrator' and not exists (select 1 from people p where p.book_id = s.book_id and p.character_id = s.speaker_id)
  union all select book_id, 'INVALID_CHARACTER_ID', 'id', '$.characters[' || pos || '].character_id' from people where character_id = 'narrator'
  union all select book_id, 'DUPLICATE_CHARACTER_ID', 'unique', '$.characters[' || (n + pos) || '].character_id' from people where kind = 4
  union all select book_id, 'INVALID_ALIAS_KIND', 'kind', '$.characters[' || pos || '].aliases[0].kind' from people where kind = 5
  union all select book_id, 'INVALID_TOKEN_RANGE', 'tokens', '$.characters[' || pos || '].aliases[0].provenance.token_start' from people where kind = 5
  union all select book_id, 'INVALID_REVISION', 'revision', '$.revision' from books where kind = 1
  union all select book_id, 'SOURCE_HASH_MISMATCH', 'binding', '$.source_pdf_sha256' from books where kind = 2
  union all select book_id, 'INVALID_WARNINGS', 'warnings', '$.warnings' from books where kind = 10
  union all select book_id, 'CHAPTER_PLAN_HASH_MISMATCH', 'current', '$.chapter_plan_sha256' from books where kind = 10
  union all select book_id, 'ARTIFACT_HASH_MISMATCH', 'digest', '$.canonical_artifact_sha256' from books where kind = 11
) {_COUNTED}"""

V08_VOICE_PLAN_VIOLATIONS = f"""with {_SPANS}, members as (
  select book_id, cast_id, row_number() over (partition by book_id order by cast_id) - 1 as pos, row_number() over (partition by book_id, cast_id <> 'narrator' order by cast_id) - 1 as alias_pos
  from (select book_id, speaker_id as cast_id from spans union select book_id, 'narrator' from spans) where cast_id <> 'narrator' or book_id % 13 <> 1
), books as (
  select book_id, book_id % 13 as kind, book_id % 2 = 1 as draft, count(*) as n_chapters, max(end_offset) as goal from chapters where book_id in (select book_id from members) group by book_id
), told as (
  select s.* replace (case when kind = 6 and source_end = max(source_end) over (partition by book_id) then 'unknown' else type end as type, case when kind = 7 and ordinal = 0 then null else speaker_id end as speaker_id),
    kind, draft, n_chapters, 0.5 as score from spans s join books using (book_id)
), held as (
  select *, '$.chapters[' || (chapter_index - 1) || '].spans[' || (row_number() over (partition by book_id, chapter_index order by source_start, source_end, span_id) - 1) || ']' as path
  from told where not (kind = 5 and ordinal = 0) and not (kind = 4 and chapter_index = n_chapters)
), seen as (
  select h.*, lag(h.source_start) over w as before_start, lag(h.source_end) over w as before_end, c.start_offset as c_start, c.end_offset as c_end
  from held h left join chapters c using (book_id, chapter_index) window w as (partition by h.book_id order by chapter_index, h.source_start, h.source_end, span_id)
), found as (
  {_facts('seen', _SPAN_FACTS)}
  union all select book_id, 'INVALID_OVERRIDE', 'effect', path || '.override.to' from seen where kind = 8 and ordinal = 0
  union all select book_id, 'INCOMPLETE_COVERAGE', 'gap', path || '.source_start' from seen where source_start > coalesce(before_end, 0)
  union all select book_id, 'UNRESOLVED_SPANS', 'unknown', path || '.type' from seen where type = 'unknown' and not draft
  union all select book_id, 'UNASSIGNED_SPEAKER', 'speaker', path || '.speaker_id' from seen where speaker_id is null and not draft
  union all select book_id, 'UNKNOWN_SPEAKER_REFERENCE', 'reference', path || '.speaker_id' from seen s where speaker_id is not null and not exists (select 1 from members m where m.book_id = s.book_id and m.cast_id = s.speaker_id)
  union all select book_id, 'INCOMPLETE_COVERAGE', 'end', '$.chapters' from books b where coalesce((select max(source_end) from held h where h.book_id = b.book_id), 0) < goal
  union all select book_id, 'CHAPTER_COVERAGE_MISMATCH', 'count', '$.chapters' from books where kind = 4
  union all select book_id, 'CHAPTER_COVERAGE_MISMATCH', 'chapter', '$.chapters[0]' from books where kind = 12
  union all select book_id, 'MISSING_NARRATOR', 'narrator', '$.cast' from books where kind = 1
  union all select book_id, 'INVALID_SPEED', 'settings', '$.cast[' || pos || '].voice_settings' from members where cast_id = 'narrator' and book_id % 13 = 2
  union all select book_id, 'NARRATOR_VOICE_MISMATCH', 'voice', '$.cast[' || pos || '].voice_id' from members where cast_id <> 'narrator' and book_id % 13 = 11
  union all select book_id, 'INVALID_OVERRIDE_STATE', 'state', '$.aliases[' || alias_pos || '].override_state' from members where cast_id <> 'narrator' and book_id % 13 = 3
  union all select book_id, 'INVALID_ALIAS_CHARACTER', 'reference', '$.aliases[' || alias_pos || '].character_id' from members where cast_id <> 'narrator' and book_id % 13 = 3
  union all select book_id, 'APPROVAL_REVISION_MISMATCH', 'revision', '$.approval.approved_revision' from books where kind = 9 and not draft
  union all select book_id, case when draft then 'INVALID_DRAFT_APPROVAL' else 'INVALID_APPROVED_AT' end, case when draft then 'draft' else 'time' end, '$.approval.approved_at' from books where kind = 10
) {_COUNTED}"""



_MEMBERS = f"""{_SPANS}, speech as (
  select book_id, ordinal, chapter_index, span_id, source_start, source_end, type, band, case when type = 'dialogue' then
    case when book_id % 4 = 1 and ordinal % 5 = 4 then 'Guest One' when ordinal % 2 = 1 then speaker_id || '!' when ordinal % 7 = 6 then ' Unknown ' else speaker_id end else speaker_id end as name
  from spans where band <> 'low'
), counts as (
  select book_id, trim(name) as name, count(*) as n, min(ordinal) as first from speech where type = 'dialogue' and lower(trim(name)) not in ('', 'narrator', 'unknown') group by all
), roles as (
  select *, upper(left(role, 1)) || substring(role, 2) as big, row_number() over (partition by book_id order by role) as ord from (select distinct book_id, speaker_id as role from spans where type = 'dialogue')
), chars as (
  select book_id, ord, role, role as source_id, 'separate_from_narrator' as relationship, 'female' as gender, 'The ' || big as label, [role, big, 'The ' || big, 'she'] as keys,
    [struct_pack(id := null::varchar, t := 'The ' || big), struct_pack(id := null::varchar, t := 'she')] as aliases from roles
  union all select book_id, ord + 100, role, role || '!', 'same_as_narrator', 'male', 'Dr X ' || role, [role || '!', 'X', 'Dr X ' || role, 'The ' || big],
    [struct_pack(id := 'al-9', t := 'Dr X ' || role), struct_pack(id := null::varchar, t := 'The ' || big)] from roles where book_id % 3 = 0
), claims as (select book_id, ord, role, unnest(keys) as name from chars),
fit as (
  select c.* from chars c join (select book_id, ord, sum(n) as n from claims join counts using (book_id, name) group by all) h using (book_id, ord) where h.n >= 2
), ones as (
  select a.book_id, a.ord, a.role, a.source_id, a.relationship, case when b.ord is null then a.gender end as gender, a.label, list_distinct(a.keys || [a.label] || coalesce(b.keys || [b.label], [])) as keys,
    a.aliases || coalesce(list_filter(b.aliases, lambda x: not list_contains(list_transform(a.aliases, lambda y: y.t), x.t)), []) as aliases
  from fit a left join fit b on a.book_id = b.book_id and a.role = b.role and b.ord > 100 where a.ord < 100
  union all select book_id, ord, role, source_id, relationship, gender, label, list_distinct(keys || [label]), aliases from fit x where ord > 100 and not exists (select 1 from fit y where y.book_id = x.book_id and y.role = x.role and y.ord < 100)
), members as (
  select *, row_number() over (partition by book_id order by late, pos) as rank from (
    select book_id, false as late, ord as pos, 'character-' || role as cast_id, source_id, label, relationship, gender, keys, aliases from ones
    union all select book_id, true, first, 'character-Guest-One', 'Guest One', 'Guest One', 'separate_from_narrator', null, ['Guest One'], [] from counts where name = 'Guest One' and n >= 2)
), cast_rows as (
  select *, case when relationship = 'same_as_narrator' then 'af_one' when gender = 'female' then 'bf_three' when gender = 'male' then 'am_two' else ['am_two', 'bf_three', 'bm_four'][cast(turn as bigint) % 3 + 1] end as voice_id
  from (select *, sum(case when relationship = 'same_as_narrator' then 0 else 1 end) over (partition by book_id order by rank) - 1 as turn from members)
), meant as (
  select book_id, name, arg_max(cast_id, rank) as cast_id from (
    select book_id, rank, cast_id, unnest(keys || [cast_id, label, source_id] || list_transform(aliases, lambda a: a.t)) as name from cast_rows
    union all select distinct book_id, 0, 'narrator', 'narrator' from cast_rows) group by all
)"""
P06_CAST_MEMBERS = f"""with {_MEMBERS} select book_id, cast(rank as integer) as rank, cast_id, source_id, label, relationship, coalesce(gender, '') as gender, voice_id, array_to_string(list_sort(keys), '|') as keys from cast_rows"""
_PLAN_ALIASES = f"""{_MEMBERS}, own as (
  select book_id, cast_id, a[i].id as id, a[i].t as t, i from (select book_id, cast_id, aliases as a, unnest(range(1, len(aliases) + 1)) as i from cast_rows)
), plan_aliases as (
  select book_id, coalesce(id, 'alias-' || cast_id || '-' || i) as alias_id, t as text, cast_id as character_id, false as late from own
  union all select n.book_id, 'alias-' || coalesce(m.cast_id, 'character-' || n.slug) || '-' || (n.ord + 1), n.text, coalesce(m.cast_id, 'character-' || n.slug), true
  from (select distinct book_id, unnest([0, 2]) as ord, unnest(['Chief', 'Me']) as text, unnest(['user!', 'narrator']) as who, unnest(['user', 'narrator']) as slug from spans) n left join meant m on m.book_id = n.book_id and m.name = n.who
  where exists (select 1 from cast_rows c where c.book_id = n.book_id and (c.cast_id = coalesce(m.cast_id, 'character-' || n.slug) or coalesce(m.cast_id, 'character-' || n.slug) = 'narrator'))
)"""
P06_PLAN_ALIASES = f"with {_PLAN_ALIASES} select * from plan_aliases"
_COVERED = """told as (
  select s.book_id, chapter_index, span_id, source_start, source_end, band, coalesce(m.cast_id, 'narrator') as speaker_id, s.who not in ('', 'narrator', 'unknown') and m.cast_id is null as lost,
    case when who = 'unknown' or (who not in ('', 'narrator') and m.cast_id is null) then 'unknown' else type end as type
  from (select *, case when lower(trim(name)) = 'unknown' then 'unknown' else trim(name) end as who from speech) s left join meant m on m.book_id = s.book_id and m.name = case when s.who = 'unknown' then 'narrator' else s.who end
), edges as (
  select c.book_id, chapter_index, span_id, source_start, source_end, type, speaker_id, band, lost, start_offset, end_offset, coalesce(lag(source_end) over w, start_offset) as before, lead(source_start) over w is null as tail
  from chapters c left join told using (book_id, chapter_index) window w as (partition by c.book_id, chapter_index order by source_start, source_end)
), parts as (
  select book_id, chapter_index, span_id, source_start, source_end, type, speaker_id, band || case when lost then '|speaker_not_cast' else '' end as reasons from edges where span_id is not null
  union all select book_id, chapter_index, null, before, coalesce(source_start, end_offset), 'narration', 'narrator', 'coverage_gap' from edges where before < coalesce(source_start, end_offset)
  union all select book_id, chapter_index, null, source_end, end_offset, 'narration', 'narrator', 'coverage_gap' from edges where tail and source_end < end_offset
), covered as (
  select * replace (coalesce(span_id, 'gap-' || chapter_index || '-' || row_number() over (partition by book_id, chapter_index order by source_start, source_end)) as span_id) from parts
)"""
P06_PLANNED_SPANS = f"with {_MEMBERS}, {_COVERED} select book_id, chapter_index, span_id, source_start, source_end, type, speaker_id, reasons from covered"
P06_DRAFT_PLANS = f"""with {_PLAN_ALIASES}, {_COVERED}, b as (select book_id, count(*) as n_chapters, max(end_offset) as goal from chapters group by book_id),
v as (select book_id, count(*) filter (relationship = 'same_as_narrator' and voice_id <> 'af_one') as bad, count(*) as n from cast_rows group by book_id),
dup as (select book_id, count(*) - count(distinct alias_id) as bad, count(*) as n from plan_aliases where not (late and text = 'Me') group by book_id),
s as (select book_id, count(*) as n, count(*) filter (source_end <= source_start) as bad from covered group by book_id)
select b.book_id, cast(1 + coalesce(v.n, 0) as integer) as n_cast, cast(coalesce(dup.n, 0) as integer) as n_aliases, cast(count(distinct p.chapter_index) as integer) as n_chapters, cast(coalesce(s.n, 0) as integer) as n_spans,
  coalesce(v.bad, 0) + coalesce(dup.bad, 0) + coalesce(s.bad, 0) as n_broken
from b join covered p using (book_id) left join v using (book_id) left join dup using (book_id) left join s using (book_id) group by b.book_id, v.n, dup.n, s.n, v.bad, dup.bad, s.bad"""



_EDITED = f"""{_SPANS}, members as (
  select book_id, cast_id, upper(left(cast_id, 1)) || substring(cast_id, 2) as label from (select book_id, speaker_id as cast_id from spans union select book_id, 'narrator' from spans)
), books as (
  select book_id, book_id % 12 as n, book_id % 13 = 12 as idle, book_id % 11 = 10 as stale, count(*) as turns, bool_or(speaker_id = 'user') as u, bool_or(speaker_id = 'assistant') as a from spans group by book_id
), o as (
  select *, case when idle then 'unchanged' when stale then 'STALE_REVISION' else case n when 0 then if(u, 'edited', 'UNKNOWN_CAST_ID') when 1 then if(u, 'edited', 'UNKNOWN_CAST_ID') when 2 then if(not u, 'UNKNOWN_CAST_ID', if(a, 'edited', 'UNKNOWN_ALIAS_ID'))
    when 3 then if(u, 'edited', 'UNKNOWN_ALIAS_ID') when 4 then if(a, 'edited', 'UNKNOWN_CAST_ID') when 5 then if(a and u, 'edited', 'UNKNOWN_CAST_ID') when 6 then if(turns < 2, 'UNKNOWN_SPAN_ID', if(u, 'edited', 'UNKNOWN_CAST_ID'))
    when 7 then 'edited' when 8 then 'CANNOT_REMOVE_NARRATOR' when 9 then 'CANNOT_MERGE_SELF' when 10 then 'UNKNOWN_SPAN_ID' else 'INVALID_EDIT' end end as outcome from books
), e as (select *, case when outcome = 'edited' then n else -1 end as d from o),
cast_after as (
  select book_id, cast_id as k, cast_id || ':' || case when d = 0 and cast_id = 'user' then 'The Reader' else label end || ':' || case when cast_id = 'narrator' then 'third_person' when d = 1 and cast_id = 'user' then 'same_as_narrator' else 'separate_from_narrator' end
    || ':v-' || case when d = 1 and cast_id = 'user' then 'narrator' else cast_id end || ':' || case when d = 1 and cast_id = 'user' then '1.5' else '1.0' end as line from members join e using (book_id) where not (d in (4, 5) and cast_id = 'assistant')
  union all select book_id, '~', 'character-New-One:New One:separate_from_narrator:v-narrator:1.0' from e where d = 3
), names_after as (
  select book_id, cast_id as k, 'alias-' || cast_id || ':' || case when d = 2 and cast_id = 'assistant' then 'user' when d = 3 and cast_id = 'user' then 'character-New-One' when d = 5 and cast_id = 'assistant' then 'user' else cast_id end as line
  from members join e using (book_id) where cast_id <> 'narrator' and not (d = 4 and cast_id = 'assistant')
), spans_after as (
  select book_id, chapter_index, source_start, source_end, span_id, case when d = 4 and speaker_id = 'assistant' then span_id || ':' || type || ':narrator:speaker:assistant:narrator:user:cast_removed'
    when d = 5 and speaker_id = 'assistant' then span_id || ':' || type || ':user:speaker:assistant:user:user:cast_merged' when d = 6 and ordinal = 1 then span_id || ':' || type || ':user:speaker:' || speaker_id || ':user:user:heard'
    when d = 7 and ordinal = 0 then span_id || ':unknown:narrator:type:' || type || ':unknown:tool:odd' else span_id || ':' || type || ':' || speaker_id end as line from spans join e using (book_id)
)"""
R02_EDITED_PLANS = f"""with {_EDITED}
select e.book_id, outcome, case when outcome = 'edited' then 3 else 2 end as revision, case when outcome = 'edited' or e.book_id % 2 = 1 then 'draft' else 'approved' end as state,
  (select string_agg(line, '|' order by k) from cast_after c where c.book_id = e.book_id) as cast, coalesce((select string_agg(line, '|' order by k) from names_after c where c.book_id = e.book_id), '') as aliases,
  (select sha256(string_agg(line, '|' order by chapter_index, source_start, source_end, span_id)) from spans_after c where c.book_id = e.book_id) as spans_sha256, '' as rule from e"""

R09_APPROVED_PLANS = f"""with {_SPANS}, t as (
  select book_id, book_id % 2 = 1 as draft, book_id % 4 < 2 and source_end = max(source_end) over (partition by book_id) as is_open, source_end <= source_start as bad from spans
), b as (select book_id, any_value(draft) as draft, count(*) filter (is_open) as n_open, count(*) filter (bad) as n_bad from t group by book_id),
o as (select *, case when n_bad > 0 then 'INVALID_RANGE' when not draft and n_open > 0 then 'UNRESOLVED_SPANS' when not draft then 'unchanged' when n_open > 0 and book_id % 3 <> 0 then 'UNRESOLVED_SPANS' else 'approved' end as outcome from b)
select book_id, outcome, case when not draft or outcome = 'approved' then 'approved' else 'draft' end as state, case when outcome = 'approved' then '2026-02-03T04:05:06Z' when not draft then '2026-01-02T03:04:05Z' else '' end as approved_at,
  case when not draft or outcome = 'approved' then 2 else 0 end as approved_revision, outcome = 'approved' and n_open > 0 as accepted, n_bad + case when draft then 0 else n_open end as n_broken from o"""

A07_PLAN_REVIEW = f"""with {_SPANS}, t as (
  select s.* replace (case when book_id % 13 = 6 and source_end = max(source_end) over (partition by book_id) then 'unknown' else type end as type), book_id % 13 as kind, max(chapter_index) over (partition by book_id) as chapters from spans s
), h as (
  select book_id, count(*) as n, count(*) filter (band = 'low') as n_low, count(*) filter (band = 'medium') as n_medium, count(*) filter (band = 'high') as n_high, count(*) filter (type = 'unknown') as unresolved, count(*) filter (kind = 8 and ordinal = 0) as overrides
  from t where not (kind = 5 and ordinal = 0) and not (kind = 4 and chapter_index = chapters) group by book_id
), m as (select book_id, count(*) as n from (select book_id, speaker_id as c from spans union select book_id, 'narrator' from spans) where c <> 'narrator' or book_id % 13 <> 1 group by book_id)
select m.book_id, cast(m.n as integer) as cast_count, cast(coalesce(h.n, 0) as integer) as span_count, cast(coalesce(n_low, 0) as integer) as n_low, cast(coalesce(n_medium, 0) as integer) as n_medium, cast(coalesce(n_high, 0) as integer) as n_high,
  cast(coalesce(unresolved, 0) as integer) as unresolved_count, cast(coalesce(overrides, 0) as integer) as override_count, 0 as speaker_not_cast_count, 0 as voice_collision_count, 2 as revision, case when m.book_id % 2 = 1 then 'draft' else 'approved' end as approval_state
from m left join h using (book_id)"""



F03_DAMAGED_PAGES = _F03.replace(f"with {_PAGES},", f"""with {_PAGES},
changed as (
  select book_id, number, case when (book_id % 5 = 1 and number % 7 = 0) or book_id % 5 = 3 then '' when (book_id % 5 = 2 and number = 2) or (book_id % 10 = 4 and number % 2 = 0) then '漢字' when book_id % 5 = 0 and number % 7 = 0 then 'only two' else text end as text from pages
),""").replace("as words from pages)", "as words from changed)")


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name.lower(): sql for name, sql in globals().items() if name[0] != "_" and name.isupper() and isinstance(sql, str)}
