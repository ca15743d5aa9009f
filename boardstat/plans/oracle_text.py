"""Oracle SQL of text extraction, files, writes, ingest and throttling."""

from __future__ import annotations

from ..registry import (MONTHS, NAME_ABBREVIATIONS, NAME_STOP_WORDS, PROGRAMS, PROVINCES, REGION_HINTS, REGIONS,
                        TITLE_RULES, name_words)
from .oracle_audit import BAD, CODES, KEEP, LINK_INDEX, NATIONAL_CHECKS, OWNER, URL_YEAR, inferred, scores
from .oracle_audit import NATIONAL as AUDITED
from .oracle_parts import MONTH_LIST, NATIONAL, REGISTERED, SCHOOLS, delta_text, num, quote, r

# Fixed values, spelled here anew so that a slip in the code under test shows.
EXCLUDED_TITLE = (
    '(?i)top[\\s-]?schools|topnotchers|performance[\\s-]?of[\\s-]?schools|room\\s+assignment|procurement|advi'
    'sory|cancellation|passers\\s*\\([A-Z]-[A-Z]\\)|passers\\s*\\([A-Z]\\s*-\\s*[A-Z]\\)|^[A-Z]-[A-Z]\\s+|master\\s'
    '+plumber|\\bmple\\b'
)
PARTIAL_ROLL = '(?i)passers\\s*\\([A-Z]-[A-Z]\\)|passers\\s*\\([A-Z]\\s*-\\s*[A-Z]\\)|\\([A-Z]-[A-Z]\\)\\s*$|sple\\b'
WORDINGS = (  # whole patterns: pattern, groups of passers, takers and rate
    ('(?is)([\\d,]+)\\s+out\\s+of\\s+([\\d,]+)\\s+\\(([\\d.]+)%?\\)', 1, 2, 3),
    ('(?is)([\\d,]+)\\s+out\\s+of\\s+([\\d,]+)\\s+passed', 1, 2, None),
    ('(?is)([\\d,]+)\\s+passed\\s+and\\s+([\\d,]+)\\s+failed\\s+out\\s+of\\s+([\\d,]+)', 1, 3, None),
    ('(?is)passing\\s+rate\\s+of\\s+([\\d.]+)%.*?([\\d,]+)\\s+out\\s+of\\s+([\\d,]+)', 2, 3, 1),
    ('(?is)([\\d,]+)\\s+examinees.*?([\\d,]+)\\s+passers.*?([\\d.]+)%', 2, 1, 3),
    ('(?is)total\\s+(?:number\\s+of\\s+)?passers[:\\s]+([\\d,]+).*?examinees[:\\s]+([\\d,]+)', 1, 2, None),
)
EXCLUDED_ARTICLE = '(?i)middle\\s+east|special\\s+professional|room\\s+assignment|advisory|procurement'
SCHOOL_PAGE_MARKERS = (
    'top-schools', 'top schools', 'top-performing', 'top performing', 'performance of schools',
    'performance-of-schools', 'performance-of-school',
)
ANCHOR = '(?is)<a\\b[^>]*\\bhref\\s*=\\s*[\\"\']([^\\"\']*)[\\"\'][^>]*>(.*?)</a>'

# ── announcements ────────────────────────────────────────────────────────────────────────────────────────────────────
_RATE = "printf('%.2f', pass_rate)"
_P, _T = num("total_passers"), num("total_takers")
STYLE = "(program_id + year + month_no) % 6"
COMPUTED = "(floor((total_passers / total_takers) * 100.0::double * 100.0::double + 0.5) / 100.0::double)"
ANN = f""", ann as (
  select id, program_id, exam_code, year, month, done, phase, total_takers, total_passers, pass_rate, exam_fullname,
    source_url as url, case when source_url like '%prc.gov.ph%' then 'prc.gov.ph' when source_url like '%prcboard%'
      then 'prcboard.com' else 'unknown' end as source, exam_fullname || ' Results ' || month || ' ' || year as title,
    exam_fullname || ' Results ' || month || ' ' || year || ' The ' || exam_fullname || ' of ' || month || ' ' || year
    || ' is over. ' || case when not done then 'The list of passers will follow.' else case {STYLE}
      when 0 then {_P} || ' out of ' || {_T} || ' (' || {_RATE} || '%) made it.'
      when 1 then {_P} || ' out of ' || {_T} || ' passed the exam.'
      when 2 then {_P} || ' passed and ' || {num('total_takers - total_passers')} || ' failed out of ' || {_T}
        || ' who sat.'
      when 3 then 'A passing rate of ' || {_RATE} || '% with ' || {_P} || ' out of ' || {_T} || ' examinees.'
      when 4 then {_T} || ' examinees gave ' || {_P} || ' passers, or ' || {_RATE} || '%.'
      else 'Total number of passers: ' || {_P} || '; examinees: ' || {_T} || '.' end end as text,
    case when done then total_passers end as x_passers, case when done then total_takers end as x_takers,
    case when done then case when {STYLE} in (0, 3, 4) then pass_rate else {COMPUTED} end end as x_rate
  from ordered),
arr as (select * replace (case when url like 'manual://%' then 'https://example.org/' || id else url end as url)
  from ann)"""
ANNOUNCED = REGISTERED + ANN
_ANN_TEXT = "trim(lower(url || ' ' || title || ' ' || left(text, 800)))"
SCORED = f""", scored as (select *, {scores('low')} as s from (select *, {_ANN_TEXT} as low from arr)),
guessed as (select *, {inferred('s')} as parsed_exam, s[list_position({CODES}, exam_code)] as exam_score from scored)"""


def title_ok(title: str) -> str:
    parts = []
    for code, (require, exclude) in TITLE_RULES.items():
        tests = [f"not contains(lower({title}), {quote(w)})" for w in exclude]
        if require:
            tests.append("(" + " or ".join(f"contains(lower({title}), {quote(w)})" for w in require) + ")")
        parts.append(f"when {quote(code)} then {' and '.join(tests)}")
    return f"case exam_code {' '.join(parts)} else true end"


def reasons(title: str, year: str, passers: str, takers: str, rate: str) -> str:
    expected = f"(floor(({passers} / {takers}) * 100.0::double * 100.0::double + 0.5) / 100.0::double)"
    return f"""case when regexp_matches({title}, {quote(EXCLUDED_TITLE)}) or regexp_matches({title},
      {quote(PARTIAL_ROLL)}) then 'excluded title pattern' when not ({title_ok(title)})
      then 'program-specific title rules failed' when {year} is null then 'no parsed year'
      when {year} <> year then 'year mismatch (parsed=' || {year} || ', index=' || year || ')'
      when exam_score < 5 or parsed_exam <> exam_code then 'exam mismatch (parsed=' || parsed_exam || ', index='
      || exam_code || ')' when {takers} is null and {passers} is null and {rate} is null then 'no summary stats'
      when coalesce({takers}, 0) <= 0 then 'total_takers <= 0' when {passers} > {takers} then 'passers > takers'
      when {rate} is null then 'missing pass_rate' when abs({rate} - {expected}) > 1.0 then 'pass_rate mismatch ('
      || {rate} || ' vs ' || {expected} || ')' end"""


_ADJACENT = "case when phase = 0 then month end"
CANDIDATES = """, cand as (select *, case when k = 1 then 'Room Assignment ' || title when k = 2 then 'Some title 2019'
    else title end as c_title, case when k = 3 then null when k = 4 then p_year + 1 else p_year end as c_year,
  case when k = 5 then x_takers + 1 else x_passers end as c_passers,
  case when k = 6 then x_rate + 5 else x_rate end as c_rate
  from (select *, (id // 10) % 13 as k, year as p_year from guessed))"""
INGESTED = f"""{ANNOUNCED} {SCORED}, ruled as (select *, case when x_takers is null then 'no summary stats' else
  {reasons('title', 'year', 'x_passers', 'x_takers', 'x_rate')} end as reason from guessed),
decided as (select g.*, c.total_takers as e_takers, c.source_url as e_url, g.reason is null and (
    coalesce(c.total_takers, 0) <= 0 or coalesce(c.source_url, '') = '' or case when c.source_url like 'manual://%'
    then false when c.source_url like '%prc.gov.ph%' then g.source = 'prc.gov.ph'
    when c.source_url like '%prcboard.com%' then g.source in ('prc.gov.ph', 'prcboard.com') else true end) as ok
  from ruled g join cycles c using (id))"""

# ── pages ────────────────────────────────────────────────────────────────────────────────────────────────────────────


def plain(html: str) -> str:
    out = html
    for pattern in ("(?s)<!--.*?-->", "(?is)<script\\b.*?</script\\s*>", "(?is)<style\\b.*?</style\\s*>",
                    "(?s)<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


PAGES = f"""pt as (select page_id, url, {plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
  {plain('html')} as text from pages)"""


def _wording(at: int) -> str:
    pattern, p, t, rate = WORDINGS[at]
    q = quote(pattern)

    def whole(k: int) -> str:
        g = f"replace(regexp_extract(text, {q}, {k}), ',', '')"
        return f"try_cast(case when regexp_matches({g}, '^[0-9]+$') then {g} end as integer)"

    rate_sql = "null::double"
    if rate:
        g = f"regexp_extract(text, {q}, {rate})"
        rate_sql = f"try_cast(case when regexp_matches({g}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then {g} end as double)"
    return f"{whole(p)} as p{at}, {whole(t)} as t{at}, {rate_sql} as r{at}"


def _first(field: str) -> str:
    parts = []
    for i, (_, _, _, rate) in enumerate(WORDINGS):
        value = {"p": f"p{i}", "t": f"t{i}", "r": f"r{i}" if rate else
                 f"floor((p{i} / t{i}) * 100.0::double * 100.0::double + 0.5) / 100.0::double"}[field]
        parts.append(f"when t{i} > 0 and p{i} <= t{i}" + (f" and r{i} is not null" if rate else "") + f" then {value}")
    return f"case {' '.join(parts)} end"


# ── school reports ───────────────────────────────────────────────────────────────────────────────────────────────────
RANKED = SCHOOLS + """, rr as (select p.* replace (coalesce(p.rank, 0) as rank, coalesce(p.pass_rate,
    floor((p.passers / p.takers) * 100.0::double * 100.0::double + 0.5) / 100.0::double) as pass_rate), upper(s.name) as school, translate(upper(s.name), '0123456789', 'ABCDEFGHIJ')
  as lettered, c.program_id, c.year, c.month from perf p join schools s on s.id = p.school_id
  join cycles c on c.id = p.exam_result_id)"""
GROUP = ("passers || ' ' || (takers - passers) || ' ' || takers || ' ' || printf('%.2f', pass_rate)")

# The merged layout looked for in the corpus.
CORPUS_MERGED = """(select * from (select *, trim(regexp_replace(regexp_replace(regexp_replace(case when lead <> '' then lead else
    split_part(line, ' ', 1) end, '^\\d+\\s+', ''), '[^A-Za-z0-9\\s&().,\\-/'']', ' ', 'g'), '\\s+', ' ', 'g')) as school
  from (select doc_id, line_no, line, rate, ints[-1] as takers, case when len(ints) >= 3 then ints[-3]
      when len(ints) = 2 then ints[-2] else floor(ints[-1] * rate / 100 + 0.5)::integer end as passers,
      regexp_extract(line, '^(.+?)\\s+[\\d,]', 1) as lead
    from (select -doc_id - 1 as doc_id, line_no::integer as line_no, line,
        try_cast(regexp_extract_all(line, '([\\d.]+)\\s*%', 1)[-1] as double) as rate,
        list_transform(list_filter(regexp_extract_all(replace(line, '%', ' '), '[\\d,]+\\.?\\d*'),
          lambda n: regexp_matches(n, '^[\\d,]*\\d[\\d,]*$')), lambda n: try_cast(replace(n, ',', '') as integer)) as ints
      from (select doc_id, unnest(range(1, len(parts) + 1)) as line_no, trim(regexp_replace(unnest(parts), '\\s+', ' ',
        'g')) as line from (select doc_id, string_split(text, chr(10)) as parts from documents))))
  where rate is not null and takers > 0 and passers <= takers) where length(school) >= 4)"""

# Re-submitted school results and the canonical form of their names.
_spelled = "name"
CLEAN = "regexp_replace(trim(school), '(?i)\\s*[-–—]\\s*(main|campus|main campus)\\s*$', '')"
for _short, _full in NAME_ABBREVIATIONS:
    CLEAN = f"regexp_replace({CLEAN}, '(?i)\\b{_short}\\b', '{_full}', 'g')"
CLEAN = f"trim(regexp_replace({CLEAN}, '\\s+', ' ', 'g'))"
TITLED = ("case when upper(c0) = c0 and lower(c0) <> c0 then array_to_string(list_transform(string_split(c0, ' '), "
          "lambda w: upper(w[1]) || lower(w[2:])), ' ') else c0 end")
SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
RESENT = SCHOOLS + f""", res0 as (
  select p.exam_result_id, p.id * 2 + copy as arrival, takers + copy as takers, passers, pass_rate, rank,
    case school_id % 5 when 0 then upper(name) || ' - Main Campus' when 1 then replace(name, ' ', '  ')
      when 2 then 'UST Annex ' || school_id when 3 then replace(name, ' ', '-') else name end as school
  from perf p join schools s on s.id = p.school_id join (values (0), (1)) k(copy)
    on copy = 0 or (school_id + exam_result_id) % 11 = 0),
res1 as (select *, {CLEAN} as c0 from res0),
res as (select *, {TITLED} as clean from res1)"""

# ── posts ────────────────────────────────────────────────────────────────────────────────────────────────────────────
POSTS = ANNOUNCED + """, posts as (
  select exam_fullname || ' ' || month || ' ' || year || ' ' || ['Results', 'List of Passers', 'Top Schools and Results',
    'Performance of Schools', 'Room Assignment', 'Licensure Examination Results'][(id // 10) % 6 + 1]
    || repeat(' again', copy) as title, url || '/' || ((id // 10) % 97) as url, id * 2 + copy as arrival
  from ann join (values (0), (1)) k(copy) on copy = 0 or id % 4 = 0),
dated as (select *, regexp_extract(title || ' ' || url, '\\b(20\\d{2})\\b', 1)::integer as year, lower(title) as t,
  lower(url) as u, regexp_extract(title || ' ' || url, '(?i)\\b(""" + "|".join(MONTHS) + """)\\b', 1) as month0
  from posts)"""
_MARKS = " or ".join(f"contains(u, {quote(m)}) or contains(t, {quote(m)})" for m in SCHOOL_PAGE_MARKERS)
_LOOSE = "[" + ", ".join(
    f"case when contains(low, {quote(p.site_slug)}) then 10 else 0 end + case when contains(low, "
    f"{quote(p.slug.replace('-', ' '))}) then 8 else 0 end + case when contains(low, {quote(p.exam_code.lower())}) then 6 "
    "else 0 end" + "".join(f" + case when contains(low, {quote(k.lower())}) then 5 else 0 end" for k in p.keywords)
    for p in PROGRAMS) + "]"


def _article(p) -> str:
    strong = [p.exam_code.lower(), p.site_slug.lower(), p.slug.replace("-", " ")] + [k.lower() for k in p.keywords]
    words = name_words(p, ("licensure", "examination", "examinations") + NAME_STOP_WORDS)
    some = " or ".join(f"contains(t, {quote(s)})" for s in strong if len(s) >= 3)
    hits = " + ".join(f"contains(t, {quote(w)})::integer" for w in words) or "0"
    return f"case when ({some}) or ({hits}) >= 2 then {quote(p.exam_code)} end"


_MONTH0 = "upper(month0[1]) || lower(month0[2:])"
_WORDED = f"list_filter({MONTH_LIST}, lambda m: regexp_matches(lower(title || ' ' || url), '\\b' || lower(m) || '\\b'))[1]"


def _upserted(keep: str) -> str:
    """The guard replayed row by row: `keep` says when the row at hand (a) survives the arrival (x)."""
    return f"""{REGISTERED}, wave as (select *, ((id // 10) % 7 + w) % 7 as kind, (id // 10) % 7 as mark from cycles,
      (values (0), (1), (2)) v(w)),
    inc as (select program_id, month, (year + case when mark = 5 then 1 else 0 end)::integer as year,
      case when kind in (1, 4) then 0 else w + 100 end as total_takers, case when kind in (1, 4) then 0 else 50 end as
      total_passers, case when kind in (1, 4) then 0.0 else 50.0 end as pass_rate, case when kind in (3, 4) then
      'manual://user-csv-national' else 'https://www.prc.gov.ph/w' || w end as source_url, id * 10 + w as arrival
      from wave where kind <> 6),
    seq as (select program_id, month, year, total_takers, total_passers, pass_rate, source_url, -1 as arrival, id
      from cycles union all select *, null from inc),
    folded as (select program_id, month, year, max(id) as id, min(arrival) filter (where arrival >= 0) as first_arrival,
      list_reduce(list(struct_pack(t := coalesce(total_takers, 0), total_takers := total_takers,
        total_passers := total_passers, pass_rate := pass_rate::double, source_url := source_url) order by arrival),
        lambda a, x: case when {keep} then a else x end) as f from seq group by all),
    numbered as (select *, row_number() over (partition by id is null order by first_arrival) as n from folded)
    select coalesce(id, (select max(id) from cycles) + n) as id, program_id, month, year, f.total_takers as total_takers,
      f.total_passers as total_passers, f.pass_rate as pass_rate, f.source_url as source_url from numbered"""


_SHELL_LOSES = "(a.t > 0 and x.t <= 0)"

SQL: dict[str, str] = {
    "cycle_labels": f"""{NATIONAL} select id, label, short, abbr || suffix as axis_month, split_part(month, ' ', 1) as
      label_month, year::varchar as label_year, split_part(month, ' ', 1) || ' ' || year as label_line,
      case when total_takers > 0 and total_passers is not null then greatest(0, total_takers - total_passers) end as
      failed, case when total_takers > 0 and pass_rate is not null then {r('100.0::double - pass_rate', 2)} end as
      failed_rate, {delta_text(r('pass_rate - 50', 2))} as delta from ordered""",
    "link_rules": f"""{REGISTERED}, x as (select *, label as title, source_url as url from ordered)
      select id, {URL_YEAR} as url_year, {OWNER} as owner, case when source_url like 'manual://%' then 5
      when source_url like '%prc.gov.ph%' then 3 when source_url like '%prcboard.com%' then 2 else 0 end as priority,
      {KEEP} as keep_score, {_WORDED} as month_in_order, split_part(month, ' ', 1) as first_month,
      coalesce((select c.month from calendar c where c.exam_code = x.exam_code and contains(lower(title || ' ' || url),
        lower(c.month)) order by month_pos limit 1), list_filter({MONTH_LIST},
        lambda m: contains(lower(title || ' ' || url), lower(m)))[1]) as inferred_month,
      source_url like '%prcboard%' as mirror_may_overwrite, source_url not like 'manual://%' as official_may_overwrite
      from x""",
    "school_names": f"""{RESENT} select distinct school, clean, {SLUG.format(x='clean')} as slug,
      trim(regexp_replace(regexp_replace(regexp_replace(school || ' 12', '\\s+', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g'),
        '\\s+\\d{{1,4}}$', '')) as report_name,
      trim(regexp_replace(regexp_replace(school || ' *', '[^A-Za-z0-9\\s&().,\\-/'']', ' ', 'g'), '\\s+', ' ', 'g'))
        as scanned_name from res""",
    "region_hints": f"""{SCHOOLS}, h as (select id, lower(name || ' ' || ['Manila', 'QUEZON CITY', 'Cebu', 'Davao',
      'Nowhere', 'Cagayan de Oro', 'Iloilo'][id % 7 + 1]) as low from schools) select id, case {' '.join(
        f"when contains(low, {quote(h)}) then {quote(v)}" for h, v in REGION_HINTS)} end as region from h""",
    "html_to_text": f"with {PAGES} select page_id, title, text from pt",
    "infer_exam": f"""{ANNOUNCED}, sc as (select *, {scores('low')} as s from (select *, {_ANN_TEXT} as low from arr))
      select id, exam_code, {inferred('s')} as parsed_exam, array_to_string(s, ' ') as scores from sc""",
    "infer_exam_titled": f"""with {PAGES}, named as (select * replace (coalesce(title, '') || case when page_id % 2 = 0 then '' else ' '
        || [{', '.join(quote(p.name) for p in PROGRAMS)}][page_id % {len(PROGRAMS)} + 1] end as title) from pt),
      sc as (select page_id, {scores('low')} as s from (select page_id, {_ANN_TEXT} as low from named))
      select page_id, {inferred('s')} as parsed_exam from sc""",
    "infer_exam_pages": f"""with {PAGES}, sc as (select {scores('low')} as s from (select {_ANN_TEXT} as low from pt))
      select {inferred('s')} as parsed_exam, count(*) as n from sc group by 1""",
    "extract_summary": f"""{ANNOUNCED} select id, x_passers as total_passers, x_takers as total_takers, x_rate as
      pass_rate from ann""",
    "extract_summary_planted": f"""with d as (select doc_id, coalesce(text, '') as body, doc_id % 900 + 100 as p, doc_id % 900 + 100
        + doc_id % 301 as t, printf('%.1f', (doc_id % 1000) / 10.0) as r from documents),
      planted as (select doc_id, body || ' 7 examinees, 8,9 out of. ' || case doc_id % 8 when 0 then p || ' out of ' || t || ' (' || r || '%)'
        when 1 then p || ' out  of ' || t || ' passed' when 2 then p || ' passed and ' || (t - p) || ' failed out of ' || t
        when 3 then 'A passing rate of ' || r || '%. ' || body || ' ' || p || ' out of ' || t || ' sat'
        when 4 then t || ' examinees. ' || body || ' ' || p || ' passers. ' || body || ' ' || r || '%'
        when 5 then 'Total number of passers: ' || p || '. ' || body || ' Examinees: ' || t
        when 6 then t || ' out of ' || p || ' passed, total passers ' || p || ', examinees ' || t else '' end as text from d),
      h as (select doc_id, {', '.join(_wording(i) for i in range(6))} from planted)
      select doc_id, {_first('p')} as total_passers, {_first('t')} as total_takers, {_first('r')} as pass_rate from h""",
    "extract_summary_corpus": f"""with h as (select doc_id, {', '.join(_wording(i) for i in range(6))} from documents)
      select doc_id, {_first('p')} as total_passers, {_first('t')} as total_takers, {_first('r')} as pass_rate from h""",
    "extract_dual": f"""{REGISTERED} select id, 'LET-E' as exam_code, total_passers, total_takers, pass_rate from ordered
      where program_id = 1 and done union all select id, 'LET-S', total_passers * 2, total_takers * 2, pass_rate
      from ordered where program_id = 1 and done""",
    "announced_dates": f"""{ANNOUNCED} select id, {_ADJACENT} as month, case when phase in (0, 2) then year end as year
      from ann""",
    "html_tables": f"""{RANKED} select id as page_id, 1 as rank, school, takers, passers, pass_rate, null::varchar as
      region from rr""",
    "mine_links": f"""{ANNOUNCED}, k as (select id::varchar as k, id from ann) select id as page_id,
      'https://www.example.org/a/' || k as url, 'ID_' || k || ' ALT_' || k as drive_ids,
      'https://www.example.org/uploaded/documents/' || k || '.pdf https://www.example.org/a/files/list.PDF' as documents,
      'https://www.example.org/a/img/result-' || k || '.png https://cdn.example.org/banner.jpg' as images, 4 as anchors,
      'pdf' as report_type, 'https://www.prc.gov.ph/uploaded/documents/' || k || '.pdf' as report_url,
      null::varchar as report_drive_id from k union all
      select -page_id - 1, url, '', '', '', len(regexp_extract_all(html, {quote(ANCHOR)}, 0))::integer, null, null, null
      from pages""",
    "parse_lines_table": f"""{RANKED} select id as doc_id, 3 as line_no, rank, school, takers, passers, pass_rate,
      null::varchar as region from rr""",
    "parse_lines_official": f"""{RANKED} select id as doc_id, 3 as line_no, 1 as rank, lettered as school, takers,
      passers, pass_rate, null::varchar as region from rr""",
    "parse_lines_simple": f"""{RANKED} select id as doc_id, 3 as line_no, rank, lettered as school, takers,
      floor(takers * pass_rate / 100 + 0.5)::integer as passers, pass_rate, null::varchar as region from rr""",
    "parse_lines_merged": f"""{RANKED} select id as doc_id, 3 as line_no, 1 as rank, replace(lettered, '_', ' ') as
      school, takers, passers, pass_rate, null::varchar as region from rr union all
      select doc_id, line_no, (row_number() over (partition by doc_id order by line_no))::integer, school, takers,
        passers, rate, null from {CORPUS_MERGED}""",
    "parse_school_reports": f"""{RANKED}, printed as (select rr.*, exam_result_id * 1000 + school_id // 25 as doc_id, copy,
        case copy when 1 then lower(lettered) else lettered end as shown,
        row_number() over (partition by exam_result_id, school_id // 25 order by school_id, copy) as place,
        count(*) filter (where copy = 0) over (partition by exam_result_id, school_id // 25) as named
        from rr join (values (0), (1)) k(copy) on copy = 0 or school_id % 4 = 0),
      last as (select * from printed where copy = 1 or school_id % 4 <> 0)
      select doc_id, (place + 2)::integer as line_no, place::integer as rank, shown as school, takers, passers, pass_rate,
        null::varchar as region, 0 as source_no from last union all
      select doc_id, (place + 2)::integer, place::integer, shown || ' ' || {GROUP} || '% 0 0 0 0.00%', takers,
      floor(takers * pass_rate / 100 + 0.5)::integer, pass_rate, null, 1 from last where named < 20""",
    "parse_topnotcher_lines": f"""{SCHOOLS} select id as doc_id, 1 as position, rank,
      upper(translate(name, '#0123456789', '-ABCDEFGHIJ')) || ',' as name,
      translate(upper(school), '_0123456789', ' ABCDEFGHIJ') as school, rating from top""",
    "parse_topnotcher_items": f"""{SCHOOLS} select id as doc_id, i::integer as position, i::integer as rank,
      upper(translate(name, '#0123456789', ' ABCDEFGHIJ')) || ' ' || chr((64 + i)::integer) as name,
      replace(school, ' - Main', ' Main') as school, rating from top,
      generate_series(1, 10) g(i)""",
    "json_rows": f"""{RANKED} select id as doc_id, 0 as row_no, rank, school, takers, passers, pass_rate,
      null::varchar as region from rr""",
    "discover_school_pages": f"""{POSTS}, f as (select *, lower(url || ' ' || title) as low from dated where
      ({_MARKS}) and year between 2016 and 2020 qualify row_number() over (partition by url order by arrival) = 1),
      sc as (select *, {_LOOSE} as s from f)
      select url, title, year, {_MONTH0} as month, case when list_max(s) > 0 then {CODES}[list_position(s, list_max(s))]
      else 'UNKNOWN' end as exam_code from sc""",
    "discover_result_pages": f"""{POSTS}, f as (select *, {scores('low')} as s from (select *, trim(lower(url || ' ' ||
      title || ' ')) as low from dated where year between 2016 and 2020
      and not regexp_matches(title, {quote(EXCLUDED_TITLE)}) and not regexp_matches(title, {quote(PARTIAL_ROLL)})
      and (contains(t, 'list of passers') or contains(u, 'list-of-passers') or (contains(t, 'results') and
      regexp_matches(u, '-results-[a-z]+-20\\d{{2}}')) or (regexp_matches(t, 'results.*20\\d{{2}}') and
      regexp_matches(t, 'examination|licensure|board|passers')))))
      select url, title, year, {_MONTH0} as month, {inferred('s')} as exam_code from f where {inferred('s')} <> 'UNKNOWN'
      qualify row_number() over (partition by url order by arrival) = 1""",
    "discover_articles": f"""{POSTS}, m as (select *, unnest(list_filter([{', '.join(_article(p) for p in PROGRAMS)}],
      lambda c: c is not null)) as exam_code from dated where year between 2016 and 2020
      and not regexp_matches(title, {quote(EXCLUDED_ARTICLE)})),
      a as (select * from m qualify row_number() over (partition by exam_code, year, url order by arrival) = 1)
      select url, title, arrival, year, exam_code, {_WORDED} as month from a
      qualify row_number() over (partition by exam_code, year, lower(title) order by arrival) = 1""",
    "article_report": f"""{ANNOUNCED} select id as page_id, exam_code, year, month, url, title,
      x_passers as total_passers, x_takers as total_takers, x_rate as pass_rate, 'pdf' as report_type,
      'https://www.prc.gov.ph/uploaded/documents/x.pdf' as report_url, null::varchar as report_drive_id from ann""",
    "drive_counts": f"{REGISTERED} select year, count(*) as found from ordered group by year",
    "index_counts": f"{AUDITED} {LINK_INDEX} select exam_code, count(*) as links from link_index group by exam_code",
    "national_csv": f"""{REGISTERED}, v as (select case when id % 97 = 0 then null else exam_code end as exam_code, month,
      year, total_passers, total_takers, pass_rate, case when id % 3 = 0 then source_url else 'manual://user-csv-national'
      end as source_url from ordered) select *, case when exam_code is null then 'unknown exam_code'
      when total_takers is null or pass_rate is null then 'bad_number' when total_takers <= 0 then 'total_takers <= 0'
      when abs(pass_rate - {COMPUTED}) > 1.0 then 'pass_rate mismatch (' || pass_rate || ' vs ' || {COMPUTED} || ')' end
      as reason from v""",
    "school_csv_rows": f"""{RANKED} select id::varchar as doc_id, 2 as line_no, school || ', Inc' as school, rank, takers,
      passers, pass_rate, null::varchar as region from rr where school_id % 10 <> 0""",
    "school_file_errors": f"""{RANKED} select id::varchar as file_name, 'passers' as missing from rr
      where school_id % 10 = 0""",
    "school_folder_rows": f"""{RANKED}, f as (select *, program_id || '_' || lower(month) || '_' || year || '.csv' as doc_id,
      (program_id + year + case when month = 'May' then 1 else 2 end) % 6 as style from rr)
      select doc_id, (row_number() over (partition by doc_id order by school_id) + 1)::integer as line_no,
      school || ', Inc' as school, rank, takers, passers, pass_rate, null::varchar as region from f where style <> 5""",
    "school_folder_errors": f"""{RANKED} select distinct program_id || '_' || lower(month) || '_' || year || '.csv' as file_name,
      'passers' as missing from rr where (program_id + year + case when month = 'May' then 1 else 2 end) % 6 = 5""",
    "folder_cycles": f"""{RANKED}, f as (select case when school_id % 2 = 0 then 'CELE_' else '' end || case month
      when 'May' then 'May' else 'nov' end || '_' || year || case when school_id % 5 = 0 then '_final' else '' end
      || '.csv' as file_name, school_id % 5 <> 0 as fits, month, year from rr)
      select file_name, case when fits then 'matched' else 'skipped' end as status, case when fits then month end as month,
      case when fits then year end as year, count(*) as files from f group by all""",
    "seed_provinces": f"""{SCHOOLS}, rg as (select id, name, code from regions union all values {', '.join(
        f"({i}, {quote(n)}, {quote(c)})" for i, (n, c) in enumerate(REGIONS, 5))}),
      pv as (select n_nationkey::bigint as id, n_name as name, r_name as region from nation join region
        on r_regionkey = n_regionkey union all values {', '.join(
            f"({i}, {quote(n)}, {quote(g)})" for i, (g, n) in enumerate(PROVINCES, 25))})
      select pv.id, pv.name, region, code from pv join rg on rg.name = region""",
    "validate_rows": f"""{ANNOUNCED} {SCORED} {CANDIDATES} select id, exam_code, case when phase = 0 then month else month
      end as final_month, {reasons('c_title', 'c_year', 'c_passers', 'x_takers', 'c_rate')} as reason from cand""",
    "upsert_national": _upserted(f"(a.source_url like 'manual://%' and (a.t > 0 or x.t <= 0)) or {_SHELL_LOSES}"),
    "upsert_national_compat": _upserted(f"a.source_url like 'manual://%' or {_SHELL_LOSES}"),
    "upsert_national_forced": _upserted("false"),
    "upsert_school_rows": f"""{RESENT}, known as (select * from schools where id % 4 <> 0),
      named as (select clean, min(arrival) as seen, {SLUG.format(x='clean')} as slug from res group by clean),
      fresh as (select n.slug, arg_min(clean, seen) as name from named n where clean not in (select name from known)
        and n.slug not in (select slug from known) group by n.slug),
      dims as (select name, slug from known union all select name, slug from fresh),
      placed as (select n.clean, coalesce((select d.name from dims d where d.name = n.clean),
        (select d.name from dims d where d.slug = n.slug)) as name from named n),
      allrows as (select exam_result_id, s.name, takers, passers, pass_rate, rank, -1 as arrival from perf p join known s
        on s.id = p.school_id where exam_result_id % 2 = 0
        union all select exam_result_id, placed.name, takers, passers, pass_rate, rank, arrival from res
        join placed using (clean))
      select exam_result_id, a.name as school, d.slug, takers, passers, pass_rate, rank from allrows a join dims d
      on d.name = a.name qualify row_number() over (partition by exam_result_id, a.name order by arrival desc) = 1""",
    "upsert_topnotchers": f"""{SCHOOLS}, inc as (select exam_result_id, (rank % 6 + 1)::integer as rank, upper(name) as
      name, school, rating, id as arrival from top union all select exam_result_id, rank, name, school, rating, -1 from top
      where rank <= 4) select exam_result_id, rank, name, school, rating from inc
      qualify row_number() over (partition by exam_result_id, rank order by arrival desc) = 1""",
    "ingest_school_rows": f"""{RANKED} select r.program_id, r.month, r.year, case when r.exam_result_id % 2 = 0 then
      c.source_url else 'manual://user-csv-schools' end as source_url, count(*) as schools, sum(takers)::bigint as takers,
      count(*)::integer as last_rank from rr r join cycles c on c.id = r.exam_result_id where rank % 9 <> 0 group by all""",
    "merge_index": f"""{AUDITED} {LINK_INDEX} select * from link_index qualify row_number() over (partition by exam_code,
      month, year order by case source when 'prc.gov.ph' then 3 when 'prcboard.com' then 2 else 1 end desc,
      case when post_id % 4 = 0 then 0 else 1 end, post_id, url) = 1""",
    "import_job_islands": f"""{REGISTERED}, l as (select *, row_number() over (order by id) - 1 as pos from ordered),
      s as (select *, case when lag(exam_code) over (order by id) = exam_code and lag(year) over (order by id) = year
        then 0 else 1 end as start, row_number() over (order by id) as line_no from l),
      j as (select *, sum(start) over (order by id)::bigint as job_no from s)
      select job_no, exam_code, year, min(line_no) as first_line, count(*) as rows, count(*) filter (where done) as
      rows_affected from j group by job_no, exam_code, year""",
    "import_job_rows": f"""{REGISTERED}, s as (select *, case when lag(exam_code) over (order by id) = exam_code
        and lag(year) over (order by id) = year then 0 else 1 end as start from ordered),
      j as (select *, sum(start) over (order by id)::bigint as job_no from s),
      g as (select job_no, exam_code, year, count(*) as n, count(*) filter (where done) as saved from j group by all)
      select job_no as id, a.id::bigint as program_id, year, case when saved = 0 or a.id is null then 'failed'
      when saved < n then 'partial' else 'success' end as status, saved::integer as rows_affected,
      saved || ' of ' || n || ' rows saved' as notes, '2026-01-02 04:05' as finished
      from g left join (select * from programs where exam_code <> 'CPALE') a using (exam_code)""",
    "school_rows_saved": f"""{RESENT} select exam_result_id, count(*) filter (where takers % 7 <> 0) as saved,
      count(*) filter (where takers % 7 = 0) as failed from res group by exam_result_id""",
    "link_index_file": f"""{AUDITED} {LINK_INDEX} select exam_code, year, month, url, source, post_id from link_index
      where exam_code = 'CPALE'""",
    "link_index_files": f"{AUDITED} {LINK_INDEX} select exam_code, year, month, url, source, post_id from link_index",
    "written_index": f"""{AUDITED} {LINK_INDEX} select exam_code, count(*) as csv_links, count(*) as json_links
      from link_index group by exam_code""",
    "written_drive_links": f"{REGISTERED} select year, 'ID_' || id as drive_file_id from ordered",
    "streamed_announcements": f"""{INGESTED} select d.program_id, d.month, d.year, case when ok then x_takers else
      c.total_takers end as total_takers, case when ok then x_passers else c.total_passers end as total_passers,
      case when ok then x_rate else c.pass_rate end as pass_rate, case when ok then d.url else c.source_url end as
      source_url from decided d join cycles c using (id)""",
    "delete_cycles": f"{AUDITED}, {BAD} select id from cycles where id not in (select id from bad)",
    "delete_audit": f"{AUDITED}, {BAD} select id as entity_id, 'delete' as action from bad",
    "clean_after_delete": f"""{AUDITED}, {BAD}, f as ({' union all '.join(NATIONAL_CHECKS[c] for c in (
        'url_year_mismatch', 'rate_mismatch', 'placeholder_row', 'exam_content_mismatch'))})
      select * from f where id not in (select id from bad)""",
    "delete_program": f"""{SCHOOLS}, gone as (select id from cycles where program_id = (select id from programs
      where exam_code = 'BUILDING')) select count(*) as rows, 'exam_results' as table from cycles where id not in
      (select id from gone) union all select count(*), 'school_performance' from perf where exam_result_id not in
      (select id from gone) union all select count(*), 'topnotchers' from top where exam_result_id not in
      (select id from gone)""",
    "gap_candidates": f"""{AUDITED} {LINK_INDEX}, kept as (select * from ordered where (year + program_id) % 3 <> 0
      and total_takers > 0), gaps as (select exam_code, y as year from programs, generate_series(2015, 2023) g(y)
      where not exists (select 1 from kept k where k.exam_code = programs.exam_code and k.year = y))
      select i.* from link_index i join gaps using (exam_code, year) qualify row_number() over (partition by exam_code,
      month, year order by case source when 'prc.gov.ph' then 3 when 'prcboard.com' then 2 else 1 end desc, post_id, url)
      = 1""",
    "missing_dual_cycles": f"""{REGISTERED}, g as (select y::integer as year, month, exam_code from calendar,
      generate_series(2015, 2023) g(y) where exam_code in ('LET-E', 'LET-S')) select distinct year, month from g
      where not exists (select 1 from ordered o where o.exam_code = g.exam_code and o.year = g.year
      and o.month = g.month and o.total_takers > 0)""",
    "ingest_status": f"""{INGESTED} select id as arrival, exam_code, year, month, case when ok then 'saved' else 'skipped'
      end as status, case when reason is not null then reason when ok then {num('x_passers')} || '/' || {num('x_takers')}
      || ' (' || x_rate || '%) ' || month || ' ' || year || ' [' || source || ']'
      else 'existing official row (no overwrite)' end as detail from decided""",
    "ingest_announcements": f"""{INGESTED} select d.program_id, d.month, d.year, case when ok then x_takers else
      c.total_takers end as total_takers, case when ok then x_passers else c.total_passers end as total_passers,
      case when ok then x_rate else c.pass_rate end as pass_rate, case when ok then d.url else c.source_url end as
      source_url from decided d join cycles c using (id)""",
    "reingest_placeholders": f"""{ANNOUNCED} {SCORED}, ruled as (select *, case when x_takers is null then
      'no summary stats' else {reasons('title', 'year', 'x_passers', 'x_takers', 'x_rate')} end as reason from guessed),
      dual as (select * from ordered where program_id = 1 and done),
      state as (select c.*, (c.id // 10) % 2 = 0 as hollow, d.id is not null and c.program_id <= 2 as by_dual,
        g.reason is null and c.program_id > 2 as by_page, d.total_takers * c.program_id as d_takers,
        d.total_passers * c.program_id as d_passers, d.pass_rate as d_rate, d.source_url as d_url, g.x_takers,
        g.x_passers, g.x_rate, g.url as x_url
        from cycles c join ruled g using (id) left join dual d on d.year = c.year and d.month = c.month)
      select program_id, month, year,
        case when not hollow then total_takers when by_dual then d_takers when by_page then x_takers else 0 end::integer
          as total_takers,
        case when not hollow then total_passers when by_dual then d_passers when by_page then x_passers else 0
          end::integer as total_passers,
        case when not hollow then pass_rate when by_dual then d_rate when by_page then x_rate else 0.0 end::double
          as pass_rate,
        case when not hollow then source_url when by_dual then d_url when by_page then x_url end as source_url
      from state""",
    "direct_links": f"""{REGISTERED}, g as (select o.exam_code, o.year, o.month, coalesce((select month_pos from calendar c
        where c.exam_code = o.exam_code and c.month = o.month), 100 + o.month_no) as month_pos, u.pos as url_pos,
        a.name || ' results ' || o.month as title, 'https://www.prcboard.com/' || a.site_slug || '-results-'
        || lower(o.month) || '-' || o.year || case u.pos when 0 then '-' || replace(replace(replace(lower(a.name),
        ' licensure examination', ''), ' / ', '-'), ' ', '-') else '' end || '-list-of-passers' as url
        from ordered o join programs a using (exam_code), (values (0), (1)) u(pos)
        where o.done and o.phase = 0 and o.year % 5 <> 0),
      sc as (select *, {scores('low')} as s from (select *, trim(lower(url || ' ' || title || ' ')) as low from g))
      select exam_code, year, month, url, 'prcboard.com/direct' as source, 'direct_url' as discovered_via, title from sc
      where {inferred('s')} = exam_code
      qualify row_number() over (partition by exam_code, year order by month_pos, url_pos) = 1""",
    "throttle_events": """with recursive ev as (select user_id as key, epoch_us(ts) // 1000 as at_ms, count(*) as hits
      from events group by all),
      win(key, start) as (select key, min(at_ms) from ev group by key union all
        select key, nxt from (select w.key, (select min(e.at_ms) from ev e where e.key = w.key
          and e.at_ms > w.start + 21600000) as nxt from win w) where nxt is not null),
      placed as (select e.*, (select max(start) from win w where w.key = e.key and w.start <= e.at_ms) as start from ev e),
      counted as (select *, (sum(hits) over (partition by key, start order by at_ms) - hits)::bigint as earlier,
        case when key = 7 then 30 else 3 end as lim from placed)
      select key, at_ms, hits, greatest(0, least(hits, lim - earlier))::bigint as allowed,
        (hits - greatest(0, least(hits, lim - earlier)))::bigint as rejected,
        case when hits > lim - earlier then ceil((start + 21600000 - at_ms) / 1000.0)::bigint else 0 end as retry_after
      from counted""",
}
# the late rows are left out, so the stream decides as the whole log does
SQL["throttle_streamed"] = SQL["throttle_events"]
