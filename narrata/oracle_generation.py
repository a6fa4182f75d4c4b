"""DuckDB SQL of the queries of analyzer output, scopes, generations and manifests."""

from __future__ import annotations

from narrata.oracle import _SPANS, _TOKENS

_RAW = f"""{_TOKENS}, ends as (
  select book_id, ordinal, min(token_id) as a, max(token_id) as b, case any_value(role) when 'user' then 4 when 'assistant' then 7 else -1 end as coref_id from tokens join turns using (book_id, ordinal) group by book_id, ordinal
), named as (
  select t.book_id, t.token_id as position, coref_id, word as alias, case when token_id > a then 'pronoun' when t.ordinal % 3 = 0 then 'proper' else 'nominal' end as kind from tokens t join ends e using (book_id, ordinal)
  where token_id < a + 2 and word <> '' and coref_id >= 0 and t.ordinal % 5 <> 4
), people as (
  select n.book_id, n.coref_id, arg_min(alias, position) as first_alias, (list(alias order by length(alias) desc, position) filter (kind = 'proper'))[1] as longest, cast(count(*) as integer) as n_aliases,
    sha256(string_agg(alias || '|' || kind || '|' || position || '|' || (position + 1), chr(10) order by position)) as aliases_sha256 from named n group by all
), characters as (
  select p.book_id, p.coref_id, case when length(longest) > length(first_alias) then longest else first_alias end as canonical_label, n_aliases, coalesce(q.n, 0) as quote_count, aliases_sha256
  from people p left join (select book_id, coref_id, count(*) as n from ends group by all) q using (book_id, coref_id)
)"""
S16_CHARACTERS = f"with {_RAW} select * from characters"
S16_QUOTE_SPANS = f"""with {_RAW}
select e.book_id, cast(e.ordinal as varchar) as quote_id, x.char_end - greatest(length(x.word), 0) as source_start, y.char_end as source_end,
  case when c.coref_id is null then -1 else e.coref_id end as coref_id, coalesce(canonical_label, '') as label
from ends e join places x on x.book_id = e.book_id and x.token_id = a join places y on y.book_id = e.book_id and y.token_id = b left join characters c on c.book_id = e.book_id and c.coref_id = e.coref_id"""
S16_INTAKE_VIOLATIONS = f"""with {_RAW}, bad as (
  select book_id, 'tokens' as file, token_id as position, case book_id % 9 when 1 then 'contiguous' when 2 then 'word' else 'offsets' end as rule from tokens
  where (book_id % 9 = 1 and token_id = 3) or (book_id % 9 = 2 and token_id = 2) or (book_id % 9 = 3 and token_id = 1)
  union all select book_id, 'quotes', ordinal, case book_id % 9 when 4 then 'range' else 'character' end from ends where (book_id % 9 = 4 and ordinal = 0) or (book_id % 9 = 5 and ordinal = 1)
) select * from bad union all select book_id, 'quotes', count(*), 'sound' from ends where book_id not in (select book_id from bad) group by book_id"""

P10_UNIFIED_SPANS = f"""with {_SPANS}, s as (select *, ordinal % 4 as shape, lower(speaker_id) = 'unknown' as nobody from spans)
select book_id, case when shape in (0, 3) then span_id else 'machine-' || (ordinal + 1) end as span_id, case when shape = 3 then -1 else source_start end as source_start, case when shape = 3 then -1 else source_end end as source_end,
  case when shape >= 2 or nobody then 'unknown' else type end as type, case when shape >= 2 or nobody then 'narrator' else speaker_id end as speaker_id, [0.5, 0.25, 0, 0][shape + 1]::double as score,
  case when shape = 0 then band else 'low' end as band, case when shape = 0 then band || '|x' else '' end as reasons, case when shape = 0 then 'a|2' else 'rules|1' end as provenance, shape <> 3 as is_valid from s"""

_SCOPES = f"""{_SPANS}, sized as (select book_id, count(*) as n from chapters group by book_id),
ranges as (
  select book_id, n, case book_id % 5 when 1 then 1 when 2 then least(2, n) when 3 then 2 when 4 then case when book_id % 2 = 0 then 1 end end as f, case book_id % 5 when 1 then 1 when 2 then n when 3 then 1 end as l from sized
), scopes as (
  select r.book_id, min(chapter_index) as f, max(chapter_index) as l, min(start_offset) as base, max(end_offset) as lim from ranges r join chapters c using (book_id)
  where (r.f is null and r.l is null) or (r.f >= 1 and r.l >= r.f and r.l <= r.n and chapter_index between r.f and r.l) group by r.book_id
)"""
P07_SCOPED_INPUTS = f"""with {_SCOPES}, books as (select book_id, string_agg(text, '' order by ordinal) as text from turns group by book_id)
select book_id, chapter_index - f + 1 as chapter_index, start_offset - base as start_offset, end_offset - base as end_offset, n_turns, cast(lim - base as integer) as characters, sha256(substring(text, base + 1, lim - base)) as cleaned_text_sha256
from (select book_id, chapter_index, min(source_start) as start_offset, max(source_end) as end_offset, count(*) as n_turns from turns group by all) join scopes using (book_id) join books using (book_id) where chapter_index between f and l""".replace("n_turns, cast", "cast").replace(", count(*) as n_turns from turns", " from turns")
P07_SCOPE_VIOLATIONS = f"""with {_SCOPES}
select book_id, 'INVALID_CHAPTER_RANGE' as code, 'ends' as rule, '$.chapter_start' as path from ranges where (f is null) <> (l is null)
union all select book_id, 'INVALID_CHAPTER_RANGE', 'range', '$.chapter_start' from ranges where f is not null and l is not null and not (f >= 1 and l >= f and l <= n)"""
P08_REMAPPED_SPANS = f"""with {_SCOPES}
select book_id, span_id, greatest(chapter_index, f) as chapter_index, greatest(source_start, base) as source_start, least(source_end + 4, lim) as source_end, greatest(chapter_index, f) - f + 1 as scoped_chapter, greatest(source_start, base) - base as scoped_start
from spans join scopes using (book_id) where source_end + 4 > base and source_start < lim"""

_LOG = f"""{_SPANS}, log as (
  select book_id, ordinal, chapter_index, book_id % 4 <> 1 or ordinal < 3 as recorded, book_id % 3 = 0 and ordinal = 2 as odd, book_id % 5 = 2 and ordinal = 1 as changed, length(text) as n from turns
)"""
J19_GENERATION_SUMMARY = f"""with {_LOG}, m as (select *, min(ordinal) filter (not recorded or odd or changed or n = 0) over (partition by book_id) as first_mismatch from log),
c as (select book_id, chapter_index, bool_and(first_mismatch is null or ordinal < first_mismatch) as complete, count(*) filter (first_mismatch is null or ordinal < first_mismatch) as n_done, count(*) as n, max(first_mismatch) as first_mismatch from m group by all)
select book_id, cast(sum(n) as bigint) as total_chunks, cast(sum(n_done) as bigint) as completed_chunks, count(*) as total_chapters, count(*) filter (complete) as completed_chapters,
  coalesce(min(chapter_index) filter (not complete), max(chapter_index)) as current_chapter, coalesce(max(first_mismatch), -1) as first_mismatch from c group by book_id"""
J20_BOUND_SUMMARY = f"""with {_LOG}, c as (select book_id, chapter_index, bool_and(recorded) as complete, count(*) filter (recorded) as n_done, count(*) as n, bool_or(recorded and odd) as wrong from log group by all),
f as (
  select book_id, sum(n) as n, sum(n_done) as n_done, count(*) as chapters, count(*) filter (complete) as complete, coalesce(min(chapter_index) filter (not complete), max(chapter_index)) as current_chapter, bool_or(wrong) as wrong from c group by book_id
), r as (select *, case when book_id % 7 = 5 then 'total' when wrong then 'record' else '' end as reason from f)
select book_id, 'synthesis' as stage, cast(n + case when book_id % 7 = 5 then 1 else 0 end as integer) as total_chunks, reason, case when reason = '' then cast(n_done as bigint) else -1 end as completed_chunks,
  case when reason = '' then chapters else -1 end as total_chapters, case when reason = '' then complete else -1 end as completed_chapters, case when reason = '' then current_chapter else -1 end as current_chapter from r"""

_BOOKS = f"{_SPANS}, b as (select book_id, count(*) as n, book_id % 5 + 1 as v, book_id // 5 % 8 as kind, book_id % 5 + 1 >= 3 and book_id % 2 = 0 as done, book_id % 4 = 0 as final from turns group by book_id)"
S14_UPGRADED_MANIFESTS = f"""with {_BOOKS}
select book_id, cast(v as integer) as from_version, cast(case v when 1 then 2 when 3 then 4 else v end as integer) as schema_version, case when v < 3 then 'planned' when done then 'completed' else 'cancelled' end as status,
  cast(case when v < 3 then -1 else n end as integer) as total_chunks, cast(case when v < 3 then 0 else n end as integer) as n_chunks,
  cast(case when v = 3 then (select count(*) from turns t where t.book_id = b.book_id and (ordinal % 2 = 1 or (t.book_id % 4 = 1 and ordinal >= 3))) else 0 end as integer) as n_gone, 0 as n_without, case when v = 5 then 'interactive_voices' else '' end as mode from b"""
V14_MANIFEST_VIOLATIONS = f"""with {_BOOKS}
select book_id, 'MALFORMED_MANIFEST' as code, 'json' as rule, '$' as path from b where kind = 0
union all select book_id, 'UNSUPPORTED_SCHEMA', 'version', '$.schema_version' from b where kind = 1
union all select book_id, 'INVALID_MANIFEST', 'source', '$.source_pdf_sha256' from b where kind = 2
union all select book_id, 'INVALID_MANIFEST', 'complete', '$.progress' from b where kind = 3 and v >= 4 and done
union all select book_id, 'INVALID_MANIFEST', 'error', '$.error' from b where kind = 4
union all select book_id, 'INVALID_MANIFEST', 'voice', '$.tts.voice' from b where kind = 5 and v = 5
union all select book_id, 'INVALID_MANIFEST', 'output', '$.output' from b where kind = 6 and v >= 4 and done and final
union all select book_id, 'INVALID_MANIFEST', 'revision', '$.voice_plan_revision' from b where kind = 7 and v = 5"""

_JOBS = f"""{_SPANS}, jobs as (
  select book_id, book_id % 3 as kind, ['planned', 'analyzed', 'pending', 'cancelled', 'failed', 'synthesizing', 'cancelling', 'completed', 'broken'][book_id % 9 + 1] as status, case when book_id % 2 = 0 then 'synthesis_complete' else 'chapter_review' end as stage,
    book_id % 4 = 1 as published, cast(count(*) as integer) as total, list(ordinal order by ordinal) filter (ordinal % 3 <> 2) as done from turns group by book_id
), asked as (select *, case when kind = 0 then 'two' else 'one' end as new_tts, cast(case when kind = 1 then total else greatest(1, total - 2) end as integer) as new_total from jobs)"""
_OUTCOME = "case when status = 'completed' and stage = 'synthesis_complete' and not published and {same} then 'unchanged' when status = 'completed' then 'COMPLETED' when status = 'broken' then 'NOT_READY' when {same} then 'unchanged' when status in ('synthesizing', 'cancelling') then 'ACTIVE' when {mismatch} then 'PLAN_MISMATCH' else 'configured' end"
R13_CONFIGURED = f"""with {_JOBS}, o as (select *, {_OUTCOME.format(same="(new_tts = 'one' and new_total = total)", mismatch="new_tts = 'one'")} as outcome from asked)
select book_id, outcome, case when outcome = 'configured' then 'planned' else status end as status, case when outcome = 'configured' then 'chapter_review' else stage end as stage, case when outcome = 'configured' then new_tts else 'one' end as tts,
  case when outcome = 'configured' then new_total else total end as total_chunks, case when outcome = 'configured' then '' else array_to_string(done, ',') end as completed_chunks from o"""
R14_CONFIGURED_INTERACTIVE = f"""with {_JOBS}, o as (select *, {_OUTCOME.format(same="(kind = 1)", mismatch="false")} as outcome from asked)
select book_id, outcome, case when outcome = 'configured' then 'planned' else status end as status, case when outcome = 'configured' then 'chapter_review' else stage end as stage, case when outcome = 'configured' then new_tts else 'one' end as tts,
  case when outcome = 'configured' then new_total else total end as total_chunks, case when outcome = 'configured' and kind = 2 then 'p2' else 'p1' end as voice_plan_sha256, case when outcome = 'configured' and kind = 2 then 2 else 1 end as voice_plan_revision,
  array_to_string(case when outcome = 'configured' then list_filter(done, lambda x: x < new_total) else done end, ',') as completed_chunks from o"""



_RUNS = """runs as (
  select user_id as group_id, event_id as run_id, case when event_id % 50 = 3 then -1 else ms end as generation_ms, ms * 3 + 7 as cpu_ms, ms + event_id % 5 as wall_ms, case when event_id % 40 = 1 then 0 else event_id % 977 + 1 end as audio_ms,
    case when user_id % 10 <> 4 then 8 end as cores from (select *, cast(floor(abs(value) * 1000) as bigint) as ms from events)
)"""
_MEASURES = "coalesce(case when generation_ms >= 0 and audio_ms > 0 then generation_ms / audio_ms end, -1) as rtf, coalesce(case when wall_ms > 0 then cpu_ms / (wall_ms * cores) end, -1) as utilisation"
M01_RUN_MEASURES = f"with {_RUNS} select run_id, {_MEASURES} from runs"
A18_RUN_AVERAGES = f"""with {_RUNS}, s as (
  select group_id, count(*) as runs, max(cores) as cores, cast(sum(generation_ms) as bigint) as generation_ms, cast(sum(cpu_ms) as bigint) as cpu_ms, cast(sum(wall_ms) as bigint) as wall_ms, cast(sum(audio_ms) as bigint) as audio_ms
  from runs where generation_ms >= 0 group by group_id)
select group_id, runs, generation_ms / runs / 1000.0::double as generation_seconds, cpu_ms / runs / 1000.0::double as cpu_seconds, audio_ms / runs / 1000.0::double as audio_seconds, {_MEASURES} from s"""
U03_CORPUS_DIFFERENCES = """with d as (select doc_id as book_id from documents)
select book_id, 'missing_predictions' as rule from d where book_id % 17 = 5 and book_id % 11 <> 3 union all select book_id, 'unknown_book' from d where book_id % 11 = 3 and book_id % 17 <> 5
union all select book_id, 'text' from d where book_id % 17 <> 5 and book_id % 11 <> 3 and book_id % 13 = 2 union all select book_id, 'cast' from d where book_id % 17 <> 5 and book_id % 11 <> 3 and book_id % 19 = 4"""
A16_ORDERED_VOICES = f"""with {_SPANS}, v as (select book_id, role || '-' || (ordinal % (book_id % 3 + 1)) as voice_id, min(ordinal) as first from turns group by all)
select book_id, string_agg(voice_id, ',' order by first) as voice_ids from v group by book_id"""
A20_CAPPED_WARNINGS = """select doc_id as book_id, sha256(array_to_string(l[1:7], chr(10))) as listed_sha256, cast(len(l) as integer) as total, len(l) > 7 as truncated from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)"""
O06_SHORT_SAMPLES = r"""select doc_id as book_id, sha256(array_to_string((regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}\x0b\x1c-\x1f\x85]+'))[1:220], ' ')) as sample_sha256 from documents"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name.lower(): sql for name, sql in globals().items() if name[0] != "_" and name.isupper() and isinstance(sql, str)}
