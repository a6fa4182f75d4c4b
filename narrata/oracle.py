"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from narrata.functions.text import ENGLISH_MARKERS

_L = r"\p{L}"
_ANY = rf"({_L}+(?:[''-]{_L}+)?)"
_LATIN = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+(?:[''’‑-][A-Za-zÀ-ÖØ-öø-ÿ0-9]+)*"
_BENCH = r"[\p{L}\p{N}\p{M}_]+(?:[''’.-][\p{L}\p{N}\p{M}_]+)*"
_ASCII = r"[A-Za-z][A-Za-z''’-]*"
_MARKERS = ", ".join(f"'{m}'" for m in ENGLISH_MARKERS)


def _count(text: str, pattern: str) -> str:
    return f"cast(len(regexp_extract_all({text}, '{pattern}')) as integer)"


def _strip(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


_LANGUAGE = f"""
books as (select doc_id as book_id, coalesce(text, '') as text from documents),
worded as (select *, list_transform(regexp_extract_all(text, '{_ANY}', 1), lambda w: replace(lower(w), '’', '''')) as words from books),
judged as (
  select *, len(words) as n, len(list_filter(words, lambda w: w in ({_MARKERS}))) / len(words) as markers,
    len(list_filter(words, lambda w: length(w) = octet_length(encode(w)))) / len(words) as plain from worded
), lang as (
  select book_id, text, n, case when n < 8 then 'uncertain' when markers >= 0.08 and plain >= 0.75 then 'English'
    when markers >= 0.02 and plain >= 0.45 then 'uncertain' else 'unsupported' end as language from judged
)"""

T_TEXT_FACTS = f"""with {_LANGUAGE}
select book_id, cast(length(text) as integer) as characters, {_count('text', _ASCII)} as ascii_words, {_count('text', _LATIN)} as latin_words,
  {_count('text', _BENCH)} as bench_words, cast(n as integer) as any_words, round_even({_count('text', _ASCII)} / 150.0::double, 2) as minutes, language,
  sha256(left(text, 4000)) as preview_sha256, sha256(text) as text_sha256 from lang"""

A02_LANGUAGE = f"""with {_LANGUAGE}
select language, count(*) as books, cast(sum({_count('text', _ASCII)}) as bigint) as words from lang group by language"""

_PAGES = """
split as (select doc_id as book_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (select book_id, lines, unnest(range(1, cast(ceil(len(lines) / 5.0) as bigint) + 1)) as number from split),
pages as (
  select book_id, cast(number as integer) as number,
    case when (number - 1) % 3 = 0 then 'Chapter ' || ((number - 1) // 3 + 1) || chr(10) else '' end || array_to_string(lines[(number - 1) * 5 + 1 : number * 5], chr(10)) as text
  from numbered
)"""

S02_PAGE_SPLIT = f"with {_PAGES} select book_id, count(*) as n_pages, cast(sum(length(text)) as bigint) as chars, min(text) as least from pages group by book_id"

_REPEATED = f"""{_PAGES},
full_lines as (select book_id, number, list_filter(string_split(text, chr(10)), lambda x: {_strip('x')} <> '') as lines from pages),
votes as (select book_id, unnest(list_distinct([lines[1], lines[-1]])) as line from full_lines where len(lines) > 0),
considered as (select book_id, count(*) as considered from full_lines where len(lines) > 0 group by book_id),
repeated as (
  select book_id, line, n_pages from (select book_id, line, count(*) as n_pages from votes group by book_id, line) join considered using (book_id)
  where n_pages >= greatest(2, ceil(considered * 0.6)) and length(line) > 2
)"""

A01_REPEATED_LINES = f"with {_REPEATED} select book_id, line, n_pages from repeated"

_HEAD = r"(?i)^(?:chapter|part|section)\b"
_CLEAN = rf"""{_REPEATED},
gone as (select book_id, list(line) as gone from repeated group by book_id),
kept as (
  select book_id, number, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}),
    lambda x: not list_contains(coalesce(gone, []), x) and not regexp_matches(x, '(?i)^(?:page\s+)?\d+$')) as lines
  from pages left join gone using (book_id)
), glued as (
  select book_id, number, regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '\n\n+', chr(10) || chr(10), 'g'), '([\p{{L}}\p{{N}}_])-\n([a-z])', '\1\2', 'g') as text from kept
), cleaned as (
  select * from (select book_id, number, {_strip(r"regexp_replace(text, '([^.!?:;\n])\n(\p{Ll})', '\1 \2', 'g')")} as text from glued) where text <> ''
), lagged as (
  select *, lag(text) over (partition by book_id order by number) as prev from cleaned
), separated as (
  select *, case when prev is null then '' when regexp_matches(prev, '[.!?:;…]["''’”»›)\]}}]*$') then chr(10) || chr(10)
    when regexp_matches(trim(string_split(prev, chr(10))[-1]), '{_HEAD}') then chr(10) || chr(10)
    when regexp_matches(text, '^\p{{Ll}}') then case when regexp_matches(prev, '[A-Za-z]-$') then '' else ' ' end
    when regexp_matches(prev, '(?:\p{{Ll}}|,)$') and not regexp_matches(trim(string_split(text, chr(10))[1]), '{_HEAD}') then ' '
    else chr(10) || chr(10) end as separator from lagged
), hyphened as (
  select *, case when prev is not null and separator = '' then 1 else 0 end as hyphen from separated
), placed as (
  select *, sum(length(text) + length(separator) - hyphen) over (partition by book_id order by number) - length(text) as cleaned_start,
    coalesce(lead(hyphen) over (partition by book_id order by number), 0) as lost from hyphened
), clean as (
  select book_id, number, text, separator, cast(cleaned_start as bigint) as cleaned_start, cast(cleaned_start + length(text) - lost as bigint) as cleaned_end from placed
), whole as (
  select book_id, string_agg(separator || left(text, cleaned_end - cleaned_start), '' order by number) as text, max(cleaned_end) as map_end from clean group by book_id
)"""

W01_CLEAN_PAGES = f"with {_CLEAN} select book_id, number, sha256(text) as text_sha256, separator, cleaned_start, cleaned_end from clean"
S09_CLEANED_TEXT = f"with {_CLEAN} select book_id, sha256(text) as cleaned_sha256, cast(length(text) as bigint) as chars, length(text) = map_end as covered from whole"

F03_PAGE_COVERAGE = rf"""with {_PAGES},
worded as (select *, {_count('text', _ASCII)} as words from pages),
classed as (
  select *, case when words > 0 and number % 7 = 0 then 'mixed' when words > 0 then 'text' when number % 7 = 0 then 'scanned'
    when regexp_matches(text, '\p{{L}}') then 'unsupported' else 'blank' end as classification from worded
), seen as (
  select *, row_number() over w > 1 and lead(number) over w is not null as inner_page, max(words) over (partition by book_id) >= 2 as usable,
    bool_or(classification = 'unsupported') over (partition by book_id) as odd from classed window w as (partition by book_id order by number)
), ruled as (
  select *, case when not usable then case when odd then 'NO_USABLE_TEXT' else 'OCR_REQUIRED' end when inner_page and classification = 'unsupported' then 'PARSER_FAILURE'
    when inner_page and (classification = 'scanned' or (classification = 'mixed' and words < 5)) then 'OCR_REQUIRED' end as rule from seen
)
select book_id, rule, string_agg(cast(number as varchar), ',' order by number) as pages from ruled r where rule is not null
  and (rule <> 'OCR_REQUIRED' or not exists (select 1 from ruled q where q.book_id = r.book_id and q.rule = 'PARSER_FAILURE')) group by book_id, rule"""

_PLAN = rf"""{_CLEAN},
clean_lines as (select book_id, cleaned_start, string_split(left(text, cleaned_end - cleaned_start), chr(10)) as lines from clean),
each_line as (select book_id, cleaned_start, lines, unnest(range(0, len(lines))) as i from clean_lines),
headings as (
  select book_id, cleaned_start + i + coalesce(list_sum(list_transform(lines[1:i], lambda x: length(x))), 0) as off, {_strip('lines[i + 1]')} as title from each_line
  where regexp_matches({_strip('lines[i + 1]')}, '(?i)^(?:chapter|part|section)\b(?:\s+.*)?$')
), chosen as (
  select book_id, off, min(title) as title from headings group by book_id, off
), met as (
  select w.book_id, length(w.text) as n, off, title, w.text from whole w left join chosen c on w.book_id = c.book_id and off < length(w.text) where length(w.text) > 0
), plan as (
  select book_id, cast(row_number() over w as integer) as index, coalesce(title, 'Whole Book') as title, cast(case when row_number() over w = 1 then 0 else off end as bigint) as start_offset,
    cast(coalesce(lead(off) over w, n) as bigint) as end_offset, case when title is null then 'whole' else 'heading' end as source_type, text
  from met window w as (partition by book_id order by off)
)"""

U02_CHAPTER_PLAN = f"""with {_PLAN} select book_id, index, title, start_offset, end_offset, source_type,
  {_count('substring(text, start_offset + 1, end_offset - start_offset)', _LATIN)} as word_count from plan"""
F05_CHAPTER_RANGE = f"with {_PLAN} select book_id, index - 1 as index, title, start_offset, end_offset, source_type from plan where index between 2 and 3"
R01_RENAME_CHAPTERS = f"""with {_PLAN} select book_id, index, case when index = 1 then 'Opening of ' || book_id else left(title, 200) end as title,
  start_offset, end_offset, source_type from plan"""
J02_PAGE_AT = f"""with {_PLAN}, offs as (select distinct book_id, end_offset - 1 as off from plan)
select book_id, off as "offset", arg_min(number, (case when off >= cleaned_start and off < cleaned_end then -1 else least(abs(off - cleaned_start), abs(off - cleaned_end)) end) * 100000000 + cleaned_start) as page
from offs join clean using (book_id) group by book_id, off"""

_SPANS = """
rows as (
  select conv_id as book_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn) - 1 as ordinal, cast(sum(length(coalesce(text, ''))) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as source_end
  from conversations
), turns as (
  select *, source_end - length(text) as source_start, ordinal // 4 + 1 as chapter_index from rows
), spans as (
  select book_id, chapter_index, printf('span-%05d', ordinal) as span_id, source_start, source_end, case when role = 'system' then 'narration' else 'dialogue' end as type,
    case when role = 'system' then 'narrator' else role end as speaker_id, case when length(text) >= 200 then 'high' when length(text) >= 60 then 'medium' else 'low' end as band, text, ordinal
  from turns
), chapters as (
  select book_id, chapter_index, min(source_start) as start_offset, max(source_end) as end_offset from turns group by book_id, chapter_index
)"""

W06_FILL_GAPS = f"""with {_SPANS},
kept as (select * from spans where band <> 'low'),
edges as (
  select c.book_id, c.chapter_index, span_id, source_start, source_end, type, speaker_id, start_offset, end_offset,
    coalesce(lag(source_end) over w, start_offset) as before, lead(source_start) over w as following
  from chapters c left join kept k using (book_id, chapter_index) window w as (partition by c.book_id, c.chapter_index order by source_start, source_end, span_id)
), filled as (
  select book_id, chapter_index, span_id, source_start, source_end, type, speaker_id from edges where span_id is not null
  union all select book_id, chapter_index, null, before, source_start, 'narration', 'narrator' from edges where span_id is not null and before < source_start
  union all select book_id, chapter_index, null, coalesce(source_end, start_offset), end_offset, 'narration', 'narrator' from edges where following is null and coalesce(source_end, start_offset) < end_offset
)
select book_id, chapter_index, coalesce(span_id, printf('gap-%d-%d', chapter_index, row_number() over (partition by book_id, chapter_index order by source_start, source_end))) as span_id,
  source_start, source_end, type, speaker_id from filled"""

J06_SPAN_CHAPTER = f"""with {_SPANS}
select s.book_id, span_id, source_start + 3 as source_start, source_end + 3 as source_end, coalesce(c.chapter_index, 0) as found_chapter from spans s
left join chapters c on s.book_id = c.book_id and source_start + 3 >= start_offset and source_end + 3 <= end_offset"""

_VIOLATIONS = """
seen as (
  select s.*, start_offset, end_offset, count(*) over (partition by s.book_id, span_id) as same,
    max(source_end) over (partition by s.book_id order by source_start, source_end, span_id rows between unbounded preceding and 1 preceding) as ends
  from damaged s left join chapters c using (book_id, chapter_index)
), ruled as (
  select book_id, span_id, 'DUPLICATE_SPAN_ID' as rule from seen where same > 1
  union all select book_id, span_id, 'OVERLAPPING_SPANS' from seen where source_start < ends
  union all select book_id, span_id, 'OUT_OF_RANGE' from seen where source_start < 0 or source_end <= source_start
  union all select book_id, span_id, 'CROSS_CHAPTER' from seen where start_offset is null or source_start < start_offset or source_end > end_offset
)"""

W04_SPAN_VIOLATIONS = f"""with {_SPANS},
damaged as (
  select book_id, chapter_index, source_start, case when source_start % 5 = 0 then source_end + 7 else source_end end as source_end,
    case when source_start % 11 = 3 then 'span-00000' else span_id end as span_id from spans
), {_VIOLATIONS} select book_id, rule, count(*) as n from ruled group by book_id, rule"""

W05_SPAN_COVERAGE = f"""with {_SPANS}, damaged as (select * from spans where band <> 'low'), {_VIOLATIONS}
select book_id, rule, span_id from ruled union all select book_id, 'INCOMPLETE_COVERAGE', span_id from seen where source_start > coalesce(ends, 0)"""

A05_SPEAKING_COUNTS = f"""with {_SPANS} select book_id, speaker_id, count(*) as n_spans from spans where type in ('dialogue', 'unknown') and lower(speaker_id) not in ('', 'narrator', 'unknown') group by all"""
A06_CHARACTERS = f"""with {_SPANS} select speaker_id, count(*) as n_spans from spans where type in ('dialogue', 'unknown') and lower(speaker_id) not in ('', 'narrator', 'unknown') group by all having count(*) >= 10"""
A07_REVIEW_SUMMARY = f"""with {_SPANS} select book_id, count(*) as span_count, count(*) filter (band = 'high') as n_high, count(*) filter (band = 'medium') as n_medium,
  count(*) filter (band = 'low') as n_low, count(*) filter (type = 'unknown') as unresolved_count, count(*) filter (speaker_id = 'narrator') as narrator_count from spans group by book_id"""
F06_REVIEW_PAGE = f"""with {_SPANS} select book_id, span_id, speaker_id, band, left(text, 240) as excerpt, length(text) > 240 as truncated from spans where band = 'medium'
  order by book_id, source_start, span_id limit 50 offset 10"""

_MATCHED = f"""{_SPANS},
said as (select *, left(text, 1) as c from spans where type = 'dialogue'),
gold as (select book_id, source_start, source_end, speaker_id, case when contains(text, ', ') then 'explicit' else 'implicit' end as category from said),
predicted as (
  select book_id, source_start + case when c = 'A' then 1 else 0 end as source_start, source_end, speaker_id as original, case when band = 'medium' then 'narrator' else speaker_id end as effective,
    case when c < 'E' then 'exception' when c < 'J' then 'unresolved' when c < 'P' then 'manual_correction' else 'auto_approved' end as state from said where band <> 'low'
), matched as (
  select coalesce(g.book_id, p.book_id) as book_id, category, speaker_id, state, effective, original, speaker_id is not null and state is not null as paired,
    speaker_id is not null and state is not null and effective = speaker_id as correct from gold g full join predicted p
    on g.book_id = p.book_id and g.source_start = p.source_start and g.source_end = p.source_end
)"""


def _ratio(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0.0::double else round_even(({a})::double / ({b})::double, 6) end"


A10_ACCURACY = f"""with {_MATCHED}, counted as (
  select book_id, count(speaker_id) as gold, count(state) as predicted, count(*) filter (paired) as matched, count(*) filter (correct) as correct,
    count(distinct (book_id, speaker_id)) filter (speaker_id <> 'narrator') as n_cast, count(distinct (book_id, speaker_id)) filter (correct and speaker_id <> 'narrator') as n_recovered,
    count(*) filter (paired and speaker_id <> 'narrator') as cast_matched, count(*) filter (paired and speaker_id <> 'narrator' and original <> 'narrator' and effective = 'narrator') as demoted,
    count(*) filter (state = 'auto_approved') as auto, count(*) filter (state = 'auto_approved' and not correct) as auto_wrong, count(*) filter (paired and not correct) as wrong,
    count(*) filter (paired and not correct and state in ('exception', 'unresolved')) as captured, count(*) filter (paired and state in ('exception', 'unresolved')) as exc,
    count(*) filter (state = 'manual_correction') as corrections
  from matched group by grouping sets ((book_id), ())
), pr as (select *, {_ratio('matched', 'predicted')} as precision, {_ratio('matched', 'gold')} as recall from counted)
select coalesce(book_id, -1) as book_id, gold, predicted, matched, precision, recall, {_ratio('2 * precision * recall', 'precision + recall')} as f1, {_ratio('correct', 'gold')} as speaker_accuracy,
  {_ratio('n_recovered', 'n_cast')} as cast_recall, {_ratio('demoted', 'cast_matched')} as demotion_rate, {_ratio('auto_wrong', 'auto')} as auto_error_rate,
  {_ratio('captured', 'wrong')} as exception_capture, {_ratio('exc', 'matched')} as exception_rate, {_ratio('100 * corrections', 'gold')} as corrections_per_100,
  predicted - matched as spurious, gold - matched as missed from pr"""
A09_CATEGORY_ACCURACY = f"""with {_MATCHED} select category, count(*) filter (correct) as correct, count(*) as gold, {_ratio('count(*) filter (correct)', 'count(*)')} as accuracy
  from matched where speaker_id is not null group by category"""

_TIME = rf"""{_SPANS},
chunks as (select book_id, chapter_index, ordinal as global_index, text || case when ordinal % 3 = 0 then chr(10) || chr(10) else '' end as text from turns),
framed as (select *, cast(greatest(1, floor((greatest(1, len(regexp_extract_all(text, '[^\s\p{{Z}}]+'))) * 0.32::double + 0.25) * 24000 / 1.0::double)) as bigint) as frames from chunks),
paused as (
  select *, cast(round_even(24000 * (case when lead(chapter_index) over w is null then 0 when lead(chapter_index) over w <> chapter_index then 750
    when regexp_matches(text, '\n\s*\n+\s*$') then case when regexp_matches({_strip('text')}, '[.!?…]["''’”»›)\]}}]*$') then 400 else 0 end else 150 end) / 1000.0::double, 0) as bigint) as pause_frames
  from framed window w as (partition by book_id order by global_index)
), timed as (
  select *, cast(sum(frames + pause_frames) over (partition by book_id order by global_index rows unbounded preceding) - frames - pause_frames as bigint) as start_frame from paused
), bounds as (
  select book_id, chapter_index, min(start_frame) as start_frame, max(start_frame + frames) as end_frame from timed group by book_id, chapter_index
), ms as (
  select *, cast(round_even(start_frame * 1000 / 24000.0::double, 0) as bigint) as start_ms, cast(round_even(end_frame * 1000 / 24000.0::double, 0) as bigint) as own_end from bounds
), timings as (
  select book_id, chapter_index, start_frame, end_frame, start_ms, coalesce(lead(start_ms) over (partition by book_id order by chapter_index), own_end) as end_ms from ms
)"""

W07_TIMELINE = f"with {_TIME} select book_id, global_index, frames, pause_frames, start_frame from timed"
W09_CHAPTER_TIMINGS = f"with {_TIME} select book_id, chapter_index, start_frame, end_frame, start_ms, end_ms from timings"
K13_CHAPTER_METADATA = rf"""with {_TIME} select book_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms
  || chr(10) || 'title=Part\; \#' || chapter_index || ' \= a\\b', chr(10) order by chapter_index) || chr(10) as metadata from timings group by book_id"""

_LOG = "log as (select user_id as analysis_id, event_id, ts, event_type as stage, value from events)"
W14_PROGRESS = f"""with {_LOG}, m as (select *, value < lag(value) over (partition by analysis_id order by ts, event_id) as falls from log)
select analysis_id, count(*) as reports, count(*) filter (falls) as regressions, max(value) as highest from m group by analysis_id"""
W15_STAGE_CHANGES = f"""with {_LOG}, m as (select *, lag(stage) over (partition by analysis_id order by ts, event_id) as before from log)
select analysis_id, event_id, stage from m where stage is distinct from before"""
O03_LATEST_STATUS = f"""with {_LOG}, m as (select *, row_number() over (partition by analysis_id order by ts desc, event_id desc) as n from log)
select analysis_id, event_id, stage, value from m where n = 1"""

T23_SLUGS = rf"""with f as (select doc_id as book_id, string_split(coalesce(text, ''), chr(10))[1] as line from documents),
s as (select book_id, line, {_strip('line')} as raw from f),
c as (select *, trim(regexp_replace(raw, '[^A-Za-z0-9_-]+', '-', 'g'), '-') as core, left(trim(regexp_replace(line, '[^A-Za-z0-9._ -]+', '_', 'g'), ' .'), 120) as safe from s)
select book_id, 'character-' || case when core = '' then left(sha256(raw), 12) else core end as slug, case when safe = '' then 'Audiobook' else safe end as file_name,
  case when contains(lower(line), 'outline') or contains(lower(line), 'bookmark') then 'outline' when lower(line) in ('heading', 'explicit') then lower(line)
    when contains(lower(line), 'heading') then 'heading' when contains(lower(line), 'layout') then 'layout' else 'candidate' end as source_type from c"""


P04_CHAPTER_CHUNKS = f"""with {_PLAN}
select book_id, index as chapter_index, cast(row_number() over (partition by book_id order by index) - 1 as integer) as global_index, 0 as local_index, start_offset as source_start,
  end_offset as source_end, sha256(substring(text, start_offset + 1, end_offset - start_offset)) as text_sha256 from plan where end_offset > start_offset"""
T17_WORD_STARTS = rf"""with b as (select doc_id as book_id, coalesce(text, '') as text from documents)
select book_id, {_count('text', _LATIN)} as n, cast(case when regexp_matches(text, '{_LATIN}') then length(regexp_extract(text, '^((?s:.)*?){_LATIN}', 1)) else -1 end as integer) as first from b"""
T44_INPUT_HASH = f"""with {_SPANS}
select book_id, ordinal, sha256('{{"metadata":{{"engine":"fake","settings":{{"speed":1.0}}}},"text":' || cast(to_json(text) as varchar) || '}}') as input_hash from turns"""

_REUSED = f"""{_SPANS},
planned as (select book_id, role, chapter_index, ordinal as global_index, ordinal % 4 as local_index, sha256(text) as input_hash from turns),
reused as (select *, role <> 'system' and input_hash >= '2' as reused from planned)"""
J16_REUSE = f"with {_REUSED} select book_id, chapter_index, global_index, local_index, input_hash, reused from reused"
A11_CHAPTER_COMPLETION = f"""with {_REUSED}, c as (select book_id, chapter_index, bool_and(reused) as complete from reused group by all)
select book_id, count(*) as chapters, count(*) filter (complete) as complete_chapters, coalesce(min(chapter_index) filter (not complete), max(chapter_index)) as current_chapter from c group by book_id"""

_CAST = f"""{_SPANS},
counted as (
  select book_id, speaker_id, count(*) as n_spans, case when speaker_id = 'user' then 1 else 2 end as ord, case when book_id % 3 = 0 and speaker_id = 'user' then 'female' end as gender
  from spans where type = 'dialogue' group by book_id, speaker_id having count(*) >= 2
), cast_rows as (
  select book_id, speaker_id, 'character-' || speaker_id as cast_id, upper(left(speaker_id, 1)) || substring(speaker_id, 2) as label, n_spans, gender,
    case when gender = 'female' then 'bf_three' else ['am_two', 'bf_three', 'bm_four'][(row_number() over (partition by book_id order by ord) - 1) % 3 + 1] end as voice_id from counted
)"""
P06_CAST = f"with {_CAST} select book_id, cast_id, label, n_spans, coalesce(gender, '') as gender, voice_id from cast_rows"
J12_SPEAKERS_TO_CAST = f"""with {_CAST}
select book_id, span_id, coalesce(cast_id, 'narrator') as speaker_id, case when cast_id is null and s.speaker_id <> 'narrator' then 'unknown' else type end as type,
  case when cast_id is null and s.speaker_id <> 'narrator' then 'speaker_not_cast' else '' end as reason from spans s left join cast_rows c using (book_id, speaker_id)"""

_ALIASES = f"""{_SPANS},
aliases as (
  select book_id, role as character_id, ordinal as ord, case ordinal % 3 when 0 then 'proper' when 1 then 'nominal' else 'pronoun' end as kind,
    case when ordinal % 3 = 2 then case when book_id % 2 = 0 then 'She' when ordinal % 2 = 0 then 'he' else 'her' end else string_split(text, ' ')[1] end as alias from turns
)"""
A13_CANONICAL_LABELS = f"""with {_ALIASES}, f as (
  select book_id, character_id, arg_min(alias, ord) as first_alias, (list(alias order by length(alias) desc, ord) filter (kind = 'proper'))[1] as proper_alias,
    count(distinct (alias, kind)) as n_aliases from aliases group by all)
select book_id, character_id, case when length(proper_alias) > length(first_alias) then proper_alias else first_alias end as label, n_aliases from f"""
A15_CHARACTER_GENDERS = f"""with {_ALIASES}, g as (select book_id, character_id, list_distinct(list(case when lower(alias) = 'he' then 'male' else 'female' end) filter (kind = 'pronoun')) as genders from aliases group by all)
select book_id, character_id, case when len(genders) = 1 then genders[1] else '' end as gender from g"""

R06_REMOVE_CAST = f"""with {_SPANS} select book_id, span_id, type, case when speaker_id = 'assistant' then 'narrator' else speaker_id end as speaker_id,
  case when speaker_id = 'assistant' then 'speaker|assistant|narrator|cast_removed' else '' end as override from spans"""
R07_MERGE_CAST = f"""with {_SPANS} select book_id, span_id, type, case when speaker_id = 'assistant' then 'user' else speaker_id end as speaker_id,
  case when speaker_id = 'assistant' then 'speaker|assistant|user|cast_merged' else '' end as override from spans"""
R08_OVERRIDE_SPANS = f"""with {_SPANS} select book_id, span_id, case band when 'medium' then 'unknown' else type end as type,
  case band when 'low' then 'user' when 'medium' then 'narrator' else speaker_id end as speaker_id,
  case band when 'low' then 'speaker|' || speaker_id || '|user|review' when 'medium' then 'type|' || type || '|unknown|review' else '' end as override from spans"""
A07_VOICE_COLLISIONS = f"""with {_SPANS}, m as (select distinct book_id, speaker_id from spans union select distinct book_id, 'narrator' from spans)
select book_id, count(*) as cast_count, count(*) filter (speaker_id <> 'narrator' and book_id % 4 = 1) as voice_collisions from m group by book_id"""

_RECORDS = f"""{_SPANS}, records as (
  select book_id, span_id, speaker_id as original_speaker_id, case ordinal % 4 when 3 then 'unknown' else 'user' end as proposed_speaker_id,
    case ordinal % 4 when 0 then speaker_id when 1 then 'user' else '' end as effective_speaker_id,
    ['verified_consensus', 'auto_corrected', 'ambiguous', 'unresolved'][ordinal % 4 + 1] as decision_state, ordinal % 4 < 2 as auto_approved, ordinal % 4 >= 2 as review_required from spans
)"""
R11_DECISION_RECORDS = f"with {_RECORDS} select * from records"
A08_VERIFICATION_SUMMARY = f"""with {_RECORDS} select book_id, count(*) as total, count(*) filter (decision_state = 'verified_consensus') as verified_consensus,
  count(*) filter (decision_state = 'auto_corrected') as auto_corrected, count(*) filter (decision_state = 'ambiguous') as ambiguous, count(*) filter (decision_state = 'unresolved') as unresolved,
  count(*) filter (auto_approved) as auto_approved, count(*) filter (review_required) as review_required, count(*) - count(distinct span_id) as repeated_ids from records group by book_id"""
I09_STAGE_COUNTS = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type as stage, count(*) as reports from events group by all"
I01_RESUMED_CHUNKS = rf"""with t as (select distinct coalesce(text, '') as text from conversations)
select sha256(text) as input_hash, cast(greatest(1, floor((greatest(1, len(regexp_extract_all(text, '[^\s\p{{Z}}]+'))) * 0.32::double + 0.25) * 24000 / 1.0::double)) as bigint) as frames from t"""


P01_SHORT_CHAPTERS = f"""with {_PLAN}, f as (
  select book_id, count(*) as chapters, sum({_count('substring(text, start_offset + 1, end_offset - start_offset)', _LATIN)}) as words from plan group by book_id)
select book_id, words / chapters as words_a_chapter, cast(case when words // 250 >= 2 then words // 250 else 1 end as bigint) as recommended from f where words / chapters < 250"""

_TOKENS = f"""{_SPANS},
split_words as (select book_id, ordinal, string_split(text, ' ') as w from turns),
tokens as (
  select book_id, ordinal, row_number() over (partition by book_id order by ordinal, pos) - 1 as token_id, w[pos] as word, case when pos = 1 then '' else ' ' end as gap
  from (select *, unnest(range(1, len(w) + 1)) as pos from split_words)
), places as (
  select book_id, ordinal, token_id, word, cast(sum(length(gap) + length(word)) over w as bigint) as char_end, cast(sum(octet_length(encode(gap)) + octet_length(encode(word))) over w as bigint) as byte_end
  from tokens window w as (partition by book_id order by token_id)
)"""
W13_TOKEN_OFFSETS = f"""with {_TOKENS} select book_id, token_id, word, char_end - length(word) as char_start, char_end, byte_end - octet_length(encode(word)) as byte_start, byte_end from places"""
J08_QUOTE_PLACES = f"""with {_TOKENS} select book_id, ordinal as quote_id, min(char_end - length(word)) as source_start, max(char_end) as source_end from places group by book_id, ordinal"""
W11_WITHOUT_OVERLAPS = f"""with recursive {_SPANS}, q as (
  select book_id, source_start, source_end + length(text) // 10 as source_end, ordinal as quote_id, row_number() over (partition by book_id order by source_start, source_end + length(text) // 10, ordinal) as n from turns
), fold as (
  select book_id, n, source_start, source_end, quote_id, true as kept, source_end as reach from q where n = 1
  union all select q.book_id, q.n, q.source_start, q.source_end, q.quote_id, q.source_start >= f.reach, case when q.source_start >= f.reach then q.source_end else f.reach end
  from fold f join q on q.book_id = f.book_id and q.n = f.n + 1
) select book_id, source_start, source_end, quote_id from fold where kept"""


V09_CAST_RULES = f"""with {_SPANS}, m as (select distinct book_id, speaker_id from spans where speaker_id <> 'assistant'),
f as (select book_id, bool_or(speaker_id = 'narrator') as narrated, bool_or(speaker_id <> 'narrator') as other from m group by book_id)
select book_id, 'MISSING_NARRATOR' as rule from f where not narrated
union all select book_id, 'NARRATOR_VOICE_MISMATCH' from f where other
union all select distinct book_id, 'UNKNOWN_SPEAKER_REFERENCE' from spans where speaker_id = 'assistant'"""
V12_RECORD_RULES = f"""with {_RECORDS}
select book_id, span_id, 'speakers' as rule from records where case decision_state when 'verified_consensus' then original_speaker_id <> 'user'
  when 'auto_corrected' then original_speaker_id = 'user' when 'ambiguous' then true else false end"""
V13_CHUNK_LOG = f"""with {_SPANS}, l as (
  select book_id, ordinal as global_index, sha256(text) as h, length(text) as n, count(*) filter (length(text) >= 60) over (partition by book_id) as total_chunks from turns
), s as (select *, max(global_index) over (partition by book_id order by h, global_index rows between unbounded preceding and 1 preceding) as before from l)
select book_id, global_index, 'exceeds_total' as rule from s where global_index >= total_chunks
union all select book_id, global_index, 'order' from s where global_index <= before union all select book_id, global_index, 'duration' from s where n = 0"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name.lower(): sql for name, sql in globals().items() if name[0] != "_" and name.isupper() and isinstance(sql, str) and name != "ENGLISH_MARKERS"}
