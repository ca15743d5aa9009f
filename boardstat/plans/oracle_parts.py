"""SQL building blocks for the oracle queries: the same bindings, written for DuckDB."""

from __future__ import annotations

from ..registry import CALENDAR, MONTHS, PROGRAMS


def quote(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def r(x: str, digits: int) -> str:
    """Round half up to some digits."""
    scale = f"{10 ** digits}.0::double"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def mean(rate: str) -> str:
    """Mean of rates of two decimals, which all rates of the bindings have: summed as whole hundredths."""
    return (f"(floor(sum(cast(round(({rate}) * 100) as bigint)) / 100.0::double / count({rate}) * 100.0::double + 0.5)"
            f" / 100.0::double)")


MONTH_LIST = "[" + ", ".join(quote(m) for m in MONTHS) + "]"

PROGRAM_ROWS = ("registry(id, exam_code, name, level, slug, category, site_slug) as (values " + ", ".join(
    f"({i}, {quote(p.exam_code)}, {quote(p.name)}, {quote(p.level)}, {quote(p.slug)}, {quote(p.category)}, "
    f"{quote(p.site_slug)})" for i, p in enumerate(PROGRAMS, 1)) + ")")

CALENDAR_ROWS = ("calendar(exam_code, month_pos, month) as (values " + ", ".join(
    f"({quote(code)}, {i}, {quote(m)})" for code, months in CALENDAR.items() for i, m in enumerate(months)) + ")")

_COUNTS = """
brands as (select p_brand, dense_rank() over (order by p_brand) as brand_no from (select distinct p_brand from part)),
counts as (
  select p_brand, cast(year(o_orderdate) + 20 as integer) y, cast(month(o_orderdate) as integer) m, l_linestatus ls,
         count(*) t, count(*) filter (where l_returnflag <> 'R') p
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all)"""

_BRAND_PROGRAMS = """
programs as (select brand_no as id, p_brand as exam_code, p_brand || ' Licensure Examination' as name,
                    lower(replace(p_brand, '#', '-')) as slug, lower(replace(p_brand, '#', '-')) as site_slug
             from brands),
keyed as (select c.*, b.brand_no as pid from counts c join brands b using (p_brand))"""

_REGISTRY_PROGRAMS = PROGRAM_ROWS + """,
programs as (select * from registry),
keyed as (select c.*, (b.brand_no - 1) % 15 + 1 as pid from counts c join brands b using (p_brand))"""

_CYCLES = """
grouped as (
  select pid, y, m, case when pid % 5 = 0 and m = 5 then case when ls = 'O' then 1 else 2 end else 0 end phase,
         sum(t)::integer t, sum(p)::integer p
  from keyed group by all),
rated as (
  select g.*, floor((p / t) * 100.0::double * 100.0::double + 0.5) / 100.0::double as rate, a.exam_code,
         case when pid % 6 = 0 and m = 9 then coalesce(b.site_slug, a.site_slug) else a.site_slug end use_slug,
         {months}[m] as month_text,
         y - case when pid % 9 = 0 and m = 3 then 1 else 0 end as url_y
  from grouped g join programs a on a.id = g.pid left join programs b on b.id = g.pid + {shift}),
cycles as (
  select (((pid * 10000 + y) * 100 + m) * 10 + phase)::bigint as id, pid::bigint as program_id, exam_code,
         month_text || case phase when 1 then ' (Written)' when 2 then ' (Practical)' else '' end as month, y as year,
         case when (y * 12 + m) % 11 = 0 then 0 when (y * 12 + m) % 13 = 0 then null else t end::integer total_takers,
         case when (y * 12 + m) % 11 = 0 then 0 else p end::integer total_passers,
         case when (y * 12 + m) % 11 = 0 then 0.0 when (y * 12 + m) % 13 = 0 then null
              when pid % 8 = 0 and m = 7 then least(floor((rate + 5) * 100.0::double + 0.5) / 100.0::double, 100.0)
              else rate end::double as pass_rate,
         case when pid % 7 = 0 or ((pid + y) % 4 = 2)
              then 'https://www.prcboard.com/' || use_slug || '-results-' || lower(month_text) || '-' || url_y
                   || '-list-of-passers'
              when (pid + y) % 4 in (0, 1)
              then 'https://www.prc.gov.ph/article/' || use_slug || '-results-' || lower(month_text) || '-' || url_y
              else 'manual://user-csv-national' end as source_url
  from rated)"""

# The order of a cycle, from its label: first month of the label, then the phase.
_LABELS = """
labelled as (
  select c.*, a.name as exam_fullname, a.slug,
         coalesce(list_position({months}, trim(split_part(replace(regexp_replace(c.month, '\\s*\\([^)]+\\)\\s*$', ''),
                  '–', '-'), '-', 1))), 0)::integer as month_no,
         case when c.month like '%Practical%' then 2 when c.month like '%Written%' then 1 else 0 end as phase,
         coalesce(total_takers, 0) > 0 and pass_rate is not null as done,
         trim(coalesce(c.month, '') || ' ' || c.year) as label,
         left(c.month, 3) as abbr,
         case when c.month like '%Practical%' then ' P' when c.month like '%Written%' then ' W' else '' end as suffix
  from cycles c join programs a on a.id = c.program_id),
ordered as (select *, year * 1000 + month_no * 10 + phase as ord, abbr || ' ' || right(year::varchar, 2) || suffix
            as short from labelled),
windowed as (select * from ordered where year >= 2026 - 10),
complete as (select * from windowed where done)"""


def _national(programs: str, shift: int) -> str:
    return ("with " + _COUNTS + "," + programs + "," + _CYCLES.format(months=MONTH_LIST, shift=shift) + ","
            + _LABELS.format(months=MONTH_LIST))


NATIONAL = _national(_BRAND_PROGRAMS, 0)
REGISTERED = _national(_REGISTRY_PROGRAMS, 1) + ", " + CALENDAR_ROWS

_SEGMENT_LINES = """
segments as (select s as exam_code, row_number() over (order by s) as id, s || ' Licensure Examination' as name,
                    lower(s) as slug from (select distinct c_mktsegment as s from customer)),
lines as (
  select g.id as pid, g.slug, year(o_orderdate) + 20 as y, case when month(o_orderdate) <= 6 then 1 else 2 end as half,
         (g.id * 10000 + year(o_orderdate) + 20) * 10 + case when month(o_orderdate) <= 6 then 1 else 2 end as cycle_id,
         l.*, c_name
  from lineitem l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join segments g on g.exam_code = c_mktsegment)"""

_SCHOOLS = """
programs as (select * from segments),
regions as (select r_regionkey::bigint as id, r_name as name, 'Region ' || r_regionkey as code from region),
schools as (
  select s_suppkey as id, n_name || ' State University ' || s_suppkey as name,
         lower(replace(n_name, '_', '-')) || '-state-university-' || s_suppkey as slug,
         case when s_suppkey % 10 <> 9 then n_regionkey end::bigint as region_id, n_nationkey::bigint as province_id,
         ['Public', 'Private', 'Local'][s_suppkey % 3 + 1] as school_type
  from supplier join nation on s_nationkey = n_nationkey),
cycles as (
  select cycle_id as id, pid as program_id, case half when 1 then 'May' else 'November' end as month, y::integer as year,
         case when (pid + y * 2 + half) % 11 = 0 then 0 else count(*) end::integer as total_takers,
         case when (pid + y * 2 + half) % 11 = 0 then 0 else count(*) filter (where l_returnflag <> 'R') end::integer
           as total_passers,
         case when (pid + y * 2 + half) % 11 = 0 then 0.0
              else floor((count(*) filter (where l_returnflag <> 'R') / count(*)) * 100.0::double * 100.0::double + 0.5)
                   / 100.0::double end as pass_rate,
         'https://www.prc.gov.ph/article/' || slug || '-results-' || case half when 1 then 'may' else 'november' end
           || '-' || y as source_url
  from lines group by cycle_id, pid, slug, y, half),
perf0 as (
  select cycle_id * 10000000000 + l_suppkey as id, cycle_id as exam_result_id, l_suppkey as school_id,
         count(*)::integer as takers, (count(*) filter (where l_returnflag <> 'R'))::integer as passers,
         floor((count(*) filter (where l_returnflag <> 'R') / count(*)) * 100.0::double * 100.0::double + 0.5)
           / 100.0::double as rate
  from lines group by cycle_id, l_suppkey),
perf as (
  select id, exam_result_id, school_id, takers, passers,
         case when (school_id + exam_result_id) % 17 <> 0 then rate end as pass_rate,
         case when (school_id + exam_result_id) % 17 <> 0 then (row_number() over (
           partition by exam_result_id order by rate desc, takers desc, school_id))::integer end as rank
  from perf0),
top as (
  select cycle_id * 100 + rank as id, cycle_id as exam_result_id, rank::integer as rank, c_name as name,
         s.name || ' - Main' as school, floor((75.0::double + l_discount * 200) * 100.0::double + 0.5) / 100.0::double
           as rating
  from (select *, row_number() over (partition by cycle_id order by l_extendedprice desc, l_orderkey, l_linenumber,
               l_partkey, l_suppkey) as rank from lines) t join schools s on s.id = t.l_suppkey where rank <= 10),
located as (select s.*, g.name as region, g.code as region_code from schools s left join regions g
            on g.id = s.region_id),
dim as (select c.id as exam_result_id, program_id, exam_code, a.name as exam_fullname, a.slug as exam_slug, month, year,
               total_takers, total_passers, pass_rate as national_rate, case month when 'May' then 5 else 11 end as
               month_no, year * 100 + case month when 'May' then 5 else 11 end as ord
        from cycles c join programs a on a.id = c.program_id),
history as (
  select p.id, school_id, exam_result_id, program_id, exam_code, exam_fullname, exam_slug, month, year, takers, passers,
         pass_rate, rank, national_rate,
         floor((pass_rate - national_rate) * 100.0::double + 0.5) / 100.0::double as gap_from_national, month_no, ord,
         exam_result_id * 1 as tie
  from perf p join dim using (exam_result_id))"""

SCHOOLS = "with " + _SEGMENT_LINES + "," + _SCHOOLS


def score(rate: str, national: str) -> str:
    raw = (f"100.0 - stddev_samp({rate}) * 2 + (count(*) filter (where {rate} > {national})) / count({rate}) * 20")
    return f"case when count({rate}) >= 2 then greatest(0.0, least(100.0, {r(raw, 1)})) end"


def score_label(score_sql: str) -> str:
    return (f"case when {score_sql} >= 85 then 'Excellent' when {score_sql} >= 70 then 'Very Good' "
            f"when {score_sql} >= 55 then 'Good' when {score_sql} >= 40 then 'Fair' "
            f"when {score_sql} is not null then 'Poor' else 'Insufficient data' end")


def trend(n: str, first: str, last: str) -> str:
    return (f"case when {n} < 3 then 'Insufficient data' when ({last} - {first}) / {n} > 1 then 'Improving' "
            f"when ({last} - {first}) / {n} < -1 then 'Declining' else 'Stable' end")


def delta_text(x: str) -> str:
    tenths = f"((cast(round(abs({x}) * 100) as bigint) + 5) // 10)"
    return (f"coalesce(case when {x} > 0 then '+' when {x} < 0 then '-' else '' end || ({tenths} // 10) || '.' "
            f"|| ({tenths} % 10) || ' pts', '—')")


def pct(x: str) -> str:
    return f"printf('%.2f', {x}) || '%'"


def num(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"
