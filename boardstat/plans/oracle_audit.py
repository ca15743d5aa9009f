"""Oracle SQL of the quality checks."""

from __future__ import annotations

from .oracle_parts import REGISTERED, SCHOOLS, quote, r
from ..operators.audit import CHECKS, SEVERITY
from ..registry import GENERIC_NAME_WORDS, NAME_STOP_WORDS, PROGRAMS, name_words

# The school tables with the planted defects.
DEFECTS = """,
marked as (select *, school_id + exam_result_id as mark from perf where exam_result_id % 23 <> 0),
dperf as (
  select case when c.copy = 1 then -id else id end as id, exam_result_id, school_id, takers,
         case when mark % 107 = 0 then takers + 1 else passers end as passers,
         case when mark % 103 = 0 then 120.0::double else pass_rate end as pass_rate, rank
  from marked join (values (0), (1)) c(copy) on c.copy = 0 or mark % 101 = 0),
dschools as (select id, case when id % 14 = 3 then ' ' || upper(regexp_replace(name, ' \\d+$', ''))
  when id % 7 = 3 then regexp_replace(name, ' \\d+$', '') else name end as name from schools)"""
BROKEN = SCHOOLS + DEFECTS

# Cycles of the audited range, and helper frames of the national checks.
RANGE = """, rng as (select * from ordered where year between 2015 and 2023),
real as (select * from rng where done)"""
NATIONAL = REGISTERED + RANGE


def word(token: str, text: str) -> str:
    t = token.lower().strip()
    if len(t) <= 4:
        return f"regexp_matches({text}, '\\b{t}\\b')"
    return f"contains({text}, {quote(t)})"


def score(text: str, p) -> str:
    parts = [f"case when {word(p.site_slug, text)} then 10 else 0 end",
             f"case when contains({text}, {quote(p.slug.replace('-', ' '))}) then 8 else 0 end",
             f"case when {word(p.exam_code, text)} then 6 else 0 end"]
    parts += [f"case when {word(k, text)} then 5 else 0 end" for k in p.keywords]
    parts += [f"case when contains({text}, {quote(w)}) then 3 else 0 end"
              for w in name_words(p, GENERIC_NAME_WORDS + NAME_STOP_WORDS)]
    return " + ".join(parts)


def scores(text: str) -> str:
    return "[" + ", ".join(score(text, p) for p in PROGRAMS) + "]"


CODES = "[" + ", ".join(quote(p.exam_code) for p in PROGRAMS) + "]"


def inferred(scores_sql: str) -> str:
    return (f"case when list_max({scores_sql}) >= 5 and (list_reverse_sort({scores_sql})[2] < 5 or "
            f"list_max({scores_sql}) - list_reverse_sort({scores_sql})[2] >= 3) "
            f"then {CODES}[list_position({scores_sql}, list_max({scores_sql}))] else 'UNKNOWN' end")


OWNER = ("case " + " ".join(
    f"when regexp_matches(lower(source_url), '[-/]{p.site_slug}([-/]|$)') then {quote(p.exam_code)}"
    for _, p in sorted(enumerate(PROGRAMS), key=lambda e: (-len(e[1].site_slug), e[0]))) + " end")

URL_YEAR = ("list_reverse(list_filter(list_transform(regexp_extract_all(source_url, '\\b(20\\d{2})\\b', 1), "
            "lambda y: y::integer), lambda y: y between 2010 and 2030))[1]")


def finding(check: str, detail: str, source: str, *, code="exam_code", month="month", year="year", id="id",
            url="source_url") -> str:
    severity, _, action = CHECKS[check]
    return (f"select {quote(check)} as check_id, {quote(severity)} as severity, {code}::varchar as exam_code, "
            f"{month}::varchar as month, {year}::integer as year, {id}::bigint as id, {detail} as detail, "
            f"{url}::varchar as source_url, {quote(action)} as action from {source}")


NULL = dict(month="null", year="null", id="null", url="null")
EXPECTED = "(floor((coalesce(total_passers, 0) / total_takers) * 100.0::double * 100.0::double + 0.5) / 100.0::double)"
HARD = """(select exam_code, y as year from programs, generate_series(2015, 2023) g(y)
  where not exists (select 1 from real x where x.exam_code = programs.exam_code and x.year = y))"""
SOFT = """(select c.exam_code, y as year, month, month_pos from calendar c, generate_series(2015, 2023) g(y)
  where not exists (select 1 from rng x where x.exam_code = c.exam_code and x.year = y and x.month = c.month
  and coalesce(x.total_takers, 0) <> 0))"""
DUPLICATES = f"""(select exam_code, total_takers, total_passers, {r('pass_rate', 2)} as rate,
  array_to_string(list(month || ' ' || year order by year, month), ', ') as listed from real
  group by all having count(*) > 1)"""
OUTLIERS = """(select *, abs(pass_rate - prior_rate) as delta from (select *, lag(pass_rate) over w as prior_rate,
  lag(month) over w as prior_month, lag(year) over w as prior_year from real
  window w as (partition by exam_code order by year, month, id)) where abs(pass_rate - prior_rate) > 30)"""

LINK_INDEX = """, marks as (select o.*, id // 10 as mark from ordered o),
base as (
  select exam_code, (case when mark % 20 = 1 then year + 10 else year end)::integer as year, month, source_url as url,
    case when mark % 3 = 1 then 'prc.gov.ph' else 'prcboard.com' end as source, 'search' as discovered_via,
    id as post_id, exam_fullname || ' Results ' || month || ' ' || year || ' List of Passers' as title, mark
  from marks where mark % 3 <> 0),
link_index as (
  select exam_code, year, month, url, source, discovered_via, post_id, title from base
  union all select exam_code, year, month, url, 'prcboard.com/direct', 'direct_url', post_id + 1, title from base
    where mark % 5 = 0
  union all select exam_code, year, month, url, source, 'search_again', post_id + 2, title from base where mark % 7 = 0)"""

INDEXED = """(select i.*, c.total_takers as st, c.pass_rate as sr from link_index i left join ordered c
  on c.exam_code = i.exam_code and c.year = i.year and c.month is not distinct from i.month)"""

PERF = """(select p.*, d.exam_code, d.month, d.year, s.name as school from dperf p join dim d using (exam_result_id)
  join dschools s on s.id = p.school_id)"""

NATIONAL_CHECKS = {
    "url_year_mismatch": finding("url_year_mismatch", f"'url_year=' || {URL_YEAR} || ' != stored=' || year",
                                 f"(select * from rng where {URL_YEAR} <> year)"),
    "rate_mismatch": finding("rate_mismatch",
                             f"'stored rate ' || pass_rate || '% vs computed ' || {EXPECTED} || '%'",
                             f"(select * from rng where total_takers > 0 and abs(pass_rate - {EXPECTED}) > 1.0)"),
    "placeholder_row": finding("placeholder_row", "'total_takers=0 (list-of-passers shell; may pollute charts)'",
                               "(select * from rng where coalesce(total_takers, 0) = 0)"),
    "exam_content_mismatch": finding(
        "exam_content_mismatch", "'URL/content infers ' || inferred || ', stored as ' || exam_code",
        f"(select *, {inferred('s')} as inferred from (select *, {scores('t')} as s from (select *, "
        "trim(lower(source_url || ' ' || source_url)) as t from rng where total_takers > 0 "
        "and source_url like '%prcboard%'))) where inferred <> 'UNKNOWN' and inferred <> exam_code"),
    "slug_mismatch": finding("slug_mismatch", "'URL slug matches ' || owner || ', stored as ' || exam_code",
                             f"(select *, {OWNER} as owner from rng where total_takers > 0 "
                             "and source_url like '%prcboard%') where owner <> exam_code"),
    "unexpected_month": finding(
        "unexpected_month", "month || ' not in EXAM_CYCLES (' || months || ')'",
        "(select x.*, m.months from rng x join (select exam_code, array_to_string(list(month order by month_pos), ', ') "
        "as months, list(lower(month)) as lows from calendar group by exam_code) m using (exam_code) "
        "where total_takers > 0 and not list_contains(lows, lower(month)))"),
    "duplicate_stats": finding("duplicate_stats", "'Same stats ' || total_passers || '/' || total_takers || ' (' || rate "
                               "|| '%) on cycles: ' || listed", DUPLICATES, **NULL),
    "rate_outlier": finding("rate_outlier", "'Pass rate ' || pass_rate || '% vs prior ' || prior_rate || '% (change ' "
                            f"|| {r('delta', 1)} || 'pp) at ' || prior_month || ' ' || prior_year", OUTLIERS),
    "mirror_only_program": finding(
        "mirror_only_program", "n || ' cycles with stats, 0 from prc.gov.ph (2015-2023)'",
        "(select exam_code, count(*) as n from real group by exam_code having count(*) filter "
        "(where source_url like '%prc.gov.ph%') = 0)", **NULL),
    "hard_coverage_gap": finding("hard_coverage_gap", "'No national stats for any cycle in ' || year", HARD,
                                 month="null", id="null", url="null"),
    "soft_coverage_gap": finding("soft_coverage_gap", "'Expected cycle missing real stats in DB'", SOFT, id="null",
                                 url="null"),
    "index_not_ingested": finding("index_not_ingested", "'Indexed but not ingested: ' || title[:80]",
                                  f"{INDEXED} where not (coalesce(st, 0) > 0 and sr is not null)", id="null", url="url"),
}
PLATFORM_CHECKS = {
    "dup_school_name": finding(
        "dup_school_name", "'''' || key || ''' appears on ' || n || ' school ids: ' || a || ' to ' || z",
        "(select lower(trim(name)) as key, count(*) n, min(id) a, max(id) z from dschools group by 1 having count(*) > 1)",
        code="null", **NULL),
    "dup_school_performance": finding(
        "dup_school_performance", "'Duplicate perf for ' || school || ' in cycle (' || n || ' rows, ids ' || a || ' to ' "
        "|| z || ')'", f"(select exam_code, month, year, school, count(*) n, min(id) a, max(id) z from {PERF} "
        "group by exam_result_id, school_id, exam_code, month, year, school having count(*) > 1)", id="null", url="null"),
    "exam_no_schools": finding(
        "exam_no_schools", "'National stats present but no per-school performance rows'",
        "(select * from dim where total_takers > 0 and exam_result_id not in (select exam_result_id from dperf))",
        id="exam_result_id", url="null"),
    "perf_missing_rate": finding("perf_missing_rate", "'Missing pass_rate for ' || school",
                                 f"{PERF} where pass_rate is null", url="null"),
    "perf_rate_out_of_range": finding("perf_rate_out_of_range",
                                      "school || ': pass_rate=' || pass_rate || ' out of 0-100'",
                                      f"{PERF} where pass_rate < 0 or pass_rate > 100", url="null"),
    "perf_passers_gt_takers": finding("perf_passers_gt_takers",
                                      "school || ': passers (' || passers || ') > takers (' || takers || ')'",
                                      f"{PERF} where passers > takers", url="null"),
}
WITH_INDEX = NATIONAL + LINK_INDEX
ALL_NATIONAL = " union all ".join(NATIONAL_CHECKS.values())

KEEP = f"""(case when source_url like '%prc.gov.ph%' then 20 else 0 end + case when exists (select 1 from calendar c
  where c.exam_code = x.exam_code and lower(c.month) = lower(x.month)) then 10 else 0 end
  + case when {URL_YEAR} = year then 5 else 0 end)"""
LOSERS = f"""(select *, 'duplicate_stats (keeping ' || first(month) over w || ' ' || first(year) over w || ')' as reason,
  row_number() over w as place from (select x.*, {KEEP} as kept_score, {r('pass_rate', 2)} as rate from real x)
  window w as (partition by exam_code, total_takers, total_passers, rate order by kept_score desc, year, month, id))"""
BAD = f"""picked as (
  select id, exam_code, month, year, source_url, 0 as seq, 'url_year=' || {URL_YEAR} || ' != stored=' || year
    || case when source_url like '%prcboard%' then ', prcboard_wrong_year' else '' end as reason from rng
    where {URL_YEAR} <> year
  union all select id, exam_code, month, year, source_url, 1, 'stored rate ' || pass_rate || '% vs computed '
    || {EXPECTED} || '%' from rng where total_takers > 0 and abs(pass_rate - {EXPECTED}) > 1.0
  union all select id, exam_code, month, year, source_url, 2, 'placeholder_row (total_takers=0)' from rng
    where coalesce(total_takers, 0) = 0
  union all select id, exam_code, month, year, source_url, 3, detail from ({NATIONAL_CHECKS['exam_content_mismatch']})
  union all select id, exam_code, month, year, source_url, 4, reason from {LOSERS} where place > 1),
bad as (select exam_code, id, month, year, source_url, reason from picked
  qualify row_number() over (partition by id order by seq) = 1)"""

SQL: dict[str, str] = {
    **{f"check_{name}": f"{WITH_INDEX} {sql}" for name, sql in NATIONAL_CHECKS.items()},
    **{f"check_{name}": f"{BROKEN} {sql}" for name, sql in PLATFORM_CHECKS.items()},
    "audit_national": f"{WITH_INDEX} {ALL_NATIONAL}",
    "audit_full": f"""select * from ({WITH_INDEX} {ALL_NATIONAL}) union all
      select * from ({BROKEN} {' union all '.join(PLATFORM_CHECKS.values())})""",
    "duplicate_performance": f"""{BROKEN} select id, exam_result_id, school_id, copies from (select *, count(*) over
      (partition by exam_result_id, school_id) as copies from dperf) where copies > 1""",
    "findings_summary": f"""{WITH_INDEX}, f as ({ALL_NATIONAL}), labels(check_id, label) as (values {', '.join(
        f'({quote(c)}, {quote(v[1])})' for c, v in CHECKS.items())})
      select check_id, label, count(*) as findings, [{', '.join(quote(s) for s in SEVERITY)}][min(list_position(
      [{', '.join(quote(s) for s in SEVERITY)}], severity))] as highest_severity,
      min(list_position([{', '.join(quote(s) for s in SEVERITY)}], severity))::integer as severity_rank
      from f join labels using (check_id) group by check_id, label""",
    "coverage_by_program": f"""{NATIONAL} select a.exam_code,
      (select count(*) from rng x where x.exam_code = a.exam_code) as rows,
      (select count(*) from real x where x.exam_code = a.exam_code) as with_stats,
      (select count(*) from real x where x.exam_code = a.exam_code and source_url like '%prc.gov.ph%') as official,
      (select count(*) from real x where x.exam_code = a.exam_code and source_url like '%prcboard%') as mirror,
      (select count(*) from {SOFT} x where x.exam_code = a.exam_code) as soft_gaps,
      (select count(*) from {HARD} x where x.exam_code = a.exam_code) as hard_gap_years,
      coalesce((select min(year) || '-' || max(year) from real x where x.exam_code = a.exam_code), '—') as year_span
      from programs a""",
    "gap_report": f"""{NATIONAL} select a.exam_code,
      (select count(*) from rng x where x.exam_code = a.exam_code and total_takers > 0) as cycles_with_stats,
      coalesce((select string_agg(y::varchar, ', ' order by y) from generate_series(2015, 2023) g(y) where not exists
        (select 1 from rng x where x.exam_code = a.exam_code and x.year = y and total_takers > 0)), '') as hard_gap_years,
      coalesce((select string_agg(month || ' ' || year, ', ' order by year, month_pos) from {SOFT} x
        where x.exam_code = a.exam_code), '') as soft_gap_cycles from programs a""",
    "missing_from_index": f"""{WITH_INDEX} select exam_code, year, month, url, source, discovered_via, post_id, title
      from {INDEXED} where st is null or sr is null""",
    "duplicate_schools": f"""{BROKEN} select id, name, copies from (select *, count(*) over
      (partition by lower(trim(name))) as copies from dschools) where copies > 1""",
    "duplicate_losers": f"""{NATIONAL} select exam_code, id, month, year, reason from {LOSERS} where place > 1""",
    "bad_rows": f"{NATIONAL}, {BAD} select * from bad",
    "verification_report": f"""{BROKEN}, groups as (select exam_result_id, school_id, count(*) n from dperf group by all)
      select 'duplicates' as section, 'Duplicate school names' as type, (select count(*) from (select 1 from dschools
        group by lower(trim(name)) having count(*) > 1)) as count, 'Schools sharing a normalized name' as detail
      union all select 'duplicates', 'Duplicate performance rows', (select count(*) from groups where n > 1),
        'Same school in the same exam cycle'
      union all select 'missing', 'Exam cycles without schools', (select count(*) from cycles where id not in
        (select exam_result_id from dperf)), 'National stats present but no per-school rows'
      union all select 'missing', 'Exam cycles missing national totals', (select count(*) from cycles
        where total_takers is null or total_passers is null), 'Null total_takers/total_passers'
      union all select 'missing', 'Performance rows missing pass rate', (select count(*) from dperf
        where pass_rate is null), 'Null pass_rate'
      union all select 'validation', 'Pass rate out of range', (select count(*) from dperf
        where pass_rate < 0 or pass_rate > 100), 'pass_rate < 0 or > 100'
      union all select 'validation', 'Passers exceed examinees', (select count(*) from dperf where passers > takers),
        'passers > takers'
      union all select 'validation', 'National rate mismatch', (select count(*) from cycles where total_takers > 0
        and total_passers > 0 and abs(total_passers / total_takers * 100.0 - pass_rate) > 1),
        'Stored rate differs from passers/takers by >1%'""",
}
