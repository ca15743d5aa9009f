"""Oracle SQL of schools, rankings, search and logs."""

from __future__ import annotations

from .oracle_parts import REGISTERED, SCHOOLS, mean, quote, r, score, score_label, trend
from ..registry import SEARCH_ALIASES

SUMMARY_COLUMNS = f"""count(*) as exams_participated, {mean('pass_rate')} as avg_pass_rate,
  {score('pass_rate', 'national_rate')} as consistency_score,
  count(*) filter (where pass_rate > national_rate) as times_above_national,
  max(pass_rate) as best_pass_rate, min(pass_rate) as worst_pass_rate"""
SUMMARY = f"""summed as (select school_id, {SUMMARY_COLUMNS} from history group by school_id),
  summary as (select u.*, s.name as school, {score_label('consistency_score')} as consistency_label
              from summed u join schools s on s.id = u.school_id)"""

RANKED = """ranked as (select p.*, d.exam_code, d.year, d.month, d.national_rate,
  row_number() over (partition by d.exam_code order by rank nulls last, p.id) as position
  from perf p join dim d using (exam_result_id){where})"""

NEWEST = "newest as (select exam_code, max(year) as year from dim group by exam_code)"
TOP_WHERE = " join newest n on n.exam_code = d.exam_code and n.year = d.year"


def _gap(a: str, b: str) -> str:
    return r(f"{a} - {b}", 2)


AGGREGATE = """agg as (
  select exam_code, school_id, count(pass_rate) as rates, max(pass_rate) as best, min(pass_rate) as worst,
    sum(takers)::bigint as total_takers, sum(passers)::bigint as total_passers,
    count(distinct year)::integer as years_participated
  from history group by exam_code, school_id),
scored as (select *, floor((total_passers / total_takers) * 10000.0::double + 0.5) / 100.0::double as pass_rate
  from agg where rates > 0 {having}),
placed as (select s.*, (row_number() over (partition by exam_code order by pass_rate desc, total_takers desc,
  total_passers desc, school_id))::integer as rank from scored s)"""

AGG_COLUMNS = f"""exam_code, rank, school_id, l.name as school, l.slug, l.region, pass_rate, pass_rate as avg_pass_rate,
  {r('best', 2)} as best_pass_rate, {r('worst', 2)} as worst_pass_rate, total_takers, total_passers, years_participated"""

# The search texts of the binding, and their tokens.
QUERIES = """texts as (
  select (s_suppkey * 10)::bigint as query_id, n_name || ' ' || s_suppkey as query from supplier join nation
    on s_nationkey = n_nationkey
  union all select (s_suppkey * 10 + 1)::bigint, case s_suppkey % 8 when 0 then 'plv' when 1 then ' UST '
    when 2 then 'up' when 3 then '' when 4 then 'x' when 5 then 'State  University' when 6 then 'civil' else '9' end
    from supplier)"""
_ALIAS_CASE = "case lower(trim(query)) " + " ".join(
    f"when {quote(a)} then [{', '.join(quote(w) for w in words)}]" for a, words in SEARCH_ALIASES.items()) + " end"
TOKENS = f""", tokened as (select query_id, query, coalesce({_ALIAS_CASE},
   list_filter(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda x: length(x) >= 2)) as tokens from texts),
asked as (select query_id, query, case when len(tokens) > 0 then tokens
  when length(trim(query)) >= 2 then [lower(trim(query))] else [] end as tokens from tokened)"""

SQL: dict[str, str] = {
    "school_counts": """select c_mktsegment, year(o_orderdate)::integer + 20 as year,
      case when month(o_orderdate) <= 6 then 1 else 2 end as half, l_suppkey, count(*) as takers,
      count(*) filter (where l_returnflag <> 'R') as passers
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all""",
    "school_performance": f"""{SCHOOLS} select id, exam_result_id, school_id, takers, passers, pass_rate, rank
      from perf""",
    "topnotchers": f"{SCHOOLS} select * from top",
    "latest_topnotchers": f"""{SCHOOLS}, latest as (select exam_code, exam_result_id, year, month from dim
      where total_takers > 0 and national_rate is not null
      qualify row_number() over (partition by exam_code order by ord desc, exam_result_id desc) = 1)
      select exam_code, year, month, month || ' ' || year as cycle_label, rank, name, school, rating
      from top join latest using (exam_result_id)""",
    "top_schools": f"""{SCHOOLS}, {NEWEST}, {RANKED.format(where=TOP_WHERE)}
      select exam_code, position::integer as position, rank, l.name as school, school_id, l.slug, l.region, takers,
      passers, pass_rate, year, month, national_rate, {_gap('pass_rate', 'national_rate')} as gap
      from ranked join located l on l.id = school_id where position <= 20""",
    "top_schools_in_month": f"""{SCHOOLS}, {RANKED.format(where=" where d.year = 2019 and lower(d.month) like '%nov%'")}
      select exam_code, position::integer as position, rank, l.name as school, school_id, l.slug, l.region, takers,
      passers, pass_rate, year, month, national_rate, {_gap('pass_rate', 'national_rate')} as gap
      from ranked join located l on l.id = school_id where position <= 50""",
    "school_list": f"""{SCHOOLS}, f as (select * from located where lower(name) like '%state%'
      and lower(name) like '%nation_1%')
      select id, name, slug, school_type, region, region_code, (select count(*) from f) as total, 2 as page,
      ceil((select count(*) from f) / 15.0)::integer as pages from f order by name, id limit 15 offset 15""",
    "school_page": f"""{SCHOOLS} select id, name, slug, school_type, region, region_code, (select count(*) from located) as total,
      4 as page, ceil((select count(*) from located) / 20.0)::integer as pages from located order by name, id limit 20 offset 60""",
    "school_page_found": f"""{SCHOOLS}, f as (select * from located where lower(name) like '%state%'
      and lower(name) like '%nation_1%' and lower(region) like '%as%')
      select id, name, slug, school_type, region, region_code, (select count(*) from f) as total, 2 as page,
      ceil((select count(*) from f) / 7.0)::integer as pages from f order by name, id limit 7 offset 7""",
    "school_list_region": f"""{SCHOOLS}, f as (select * from located where lower(region) like '%as%')
      select id, name, slug, school_type, region, region_code, (select count(*) from f) as total, 1 as page,
      ceil((select count(*) from f) / 20.0)::integer as pages from f order by name, id limit 20""",
    "school_list_embedded": f"""{SCHOOLS}, f as (select id, name, slug, school_type,
      case when lower(region) like '%as%' then region end as region,
      case when lower(region) like '%as%' then region_code end as region_code from located)
      select *, (select count(*) from f) as total, 1 as page, ceil((select count(*) from f) / 100.0)::integer as pages
      from f order by name, id limit 100""",
    "school_history": f"""{SCHOOLS} select id, school_id, exam_result_id, program_id, exam_code, exam_fullname,
      exam_slug, month, year, takers, passers, pass_rate, rank, national_rate, gap_from_national, month_no,
      0 as phase from history""",
    "school_summary": f"{SCHOOLS}, {SUMMARY} select * from summary",
    "consistency_pooled": f"{SCHOOLS}, {SUMMARY} select school_id, consistency_score, consistency_label from summary",
    "consistency_scores": f"""{SCHOOLS}, c as (select school_id, program_id, {mean('pass_rate')} as avg_rate,
      {r('stddev_samp(pass_rate)', 2)} as volatility, {score('pass_rate', 'national_rate')} as score,
      count(*)::integer as years from history where pass_rate is not null group by school_id, program_id)
      select *, {score_label('score')} as label from c where years >= 2""",
    "school_rank_history": f"""{SCHOOLS}, latest as (select *, row_number() over (partition by school_id order by
      ord desc, exam_result_id desc, id desc) as rn from history)
      select school_id, min(rank) as best_rank, max(rank) as lowest_rank, count(rank) as cycles_ranked,
      max(rank) filter (where rn = 1) as latest_rank, max(pass_rate) filter (where rn = 1) as latest_pass_rate
      from latest group by school_id""",
    "school_vs_national": f"""{SCHOOLS} select school_id, exam_code, left(month, 3) || ' ' || right(year::varchar, 2)
      as label, month || ' ' || year as full_label, left(month, 3) as cycle_month, right(year::varchar, 2) as cycle_year,
      pass_rate as school, national_rate as national, year, month_no, 0 as phase from history
      where pass_rate is not null""",
    "school_trend": f"""{SCHOOLS}, f as (select school_id, count(*) as results, count(pass_rate) as n,
      (array_agg(pass_rate order by ord, exam_result_id, id) filter (where pass_rate is not null))[1] as first_rate,
      (array_agg(pass_rate order by ord desc, exam_result_id desc, id desc) filter (where pass_rate is not null))[1]
      as last_rate from history group by school_id)
      select school_id, results, first_rate, last_rate, {trend('n', 'first_rate', 'last_rate')} as trend from f""",
    "school_trend_series": f"""{SCHOOLS}, f as (select school_id, count(pass_rate) as n,
      (array_agg(pass_rate order by ord, exam_result_id, id) filter (where pass_rate is not null))[1] as first_rate,
      (array_agg(pass_rate order by ord desc, exam_result_id desc, id desc) filter (where pass_rate is not null))[1]
      as last_rate from history group by school_id)
      select school_id, year, month, exam_code, pass_rate as school_rate, national_rate, rank,
      {trend('n', 'first_rate', 'last_rate')} as trend from history join f using (school_id)""",
    "consistency_table": f"""{SCHOOLS}, c as (select school_id, program_id, {mean('pass_rate')} as avg_rate,
      {score('pass_rate', 'national_rate')} as score, count(*)::integer as years from history
      where pass_rate is not null group by school_id, program_id)
      select school_id, program_id, avg_rate, {score_label('score')} as label, years, '2026-01-02' as computed_on
      from c where years >= 2 union all
      select -school_id, program_id, 1.0::double, 'old', 9, '2020-01-01' from c where years >= 2 and school_id % 4 = 0 and school_id <> 0""",
    "school_filter_province": f"""{SCHOOLS} select school_id, s.name as school, n_name as province, exam_code, year, month,
      pass_rate, rank from history h join schools s on s.id = h.school_id join nation on n_nationkey = s.province_id
      where n_name = 'NATION_3'""",
    "sorted_cycles": f"""{REGISTERED} select exam_code, year, month, total_takers, id from ordered
      where total_takers is not null""",
    "search_cycles": f"""{REGISTERED}, q as (select id as query_id, case when id // 10 % 3 <> 1 then exam_code end as code,
        case when id // 10 % 3 < 2 then year end as q_year, case when id // 10 % 3 > 0 then month_no end as q_month
        from ordered)
      select query_id, o.id as exam_result_id, o.exam_code, o.year, o.month from q join ordered o
      on (q_year is null or q_year = o.year) and (q_month is null or q_month = o.month_no)
        and (code is null or contains(lower(o.exam_code || ' ' || o.exam_fullname || ' ' || o.slug), lower(code)))""",
    "school_topnotchers": f"""{SCHOOLS} select t.id, s.id as school_id, t.rank, t.name, t.rating, d.exam_code,
      d.exam_fullname, d.year, d.month from top t join schools s on contains(lower(t.school), lower(s.name))
      join dim d using (exam_result_id)""",
    "compare_schools": f"""{SCHOOLS}, {SUMMARY} select s.school_id, school, exams_participated, avg_pass_rate,
      consistency_score, consistency_label, times_above_national, best_pass_rate, worst_pass_rate, exam_code, year, month,
      takers, passers, pass_rate, rank, national_rate, gap_from_national
      from summary s left join history h on h.school_id = s.school_id and upper(h.exam_code) = 'BUILDING'""",
    "regional_analytics": f"""{SCHOOLS} select region, count(distinct school_id) as schools, {mean('pass_rate')}
      as avg_pass_rate, sum(passers)::bigint as total_passers, sum(takers)::bigint as total_takers
      from perf p join located l on l.id = p.school_id where region is not null group by region""",
    "regional_analytics_exam": f"""{SCHOOLS} select region, count(distinct school_id) as schools, {mean('pass_rate')}
      as avg_pass_rate, sum(passers)::bigint as total_passers, sum(takers)::bigint as total_takers
      from history p join located l on l.id = p.school_id where region is not null and exam_code = 'MACHINERY'
      group by region""",
    "rankings": f"""{SCHOOLS}, {RANKED.format(where='')} select exam_code, position::integer as position, rank,
      l.name as school, school_id, l.region, takers, passers, pass_rate, year, month, national_rate
      from ranked join located l on l.id = school_id where position <= 1000""",
    "rankings_filtered": f"""{SCHOOLS}, {RANKED.format(where=' where takers >= 5')} select exam_code,
      position::integer as position, rank, l.name as school, school_id, l.region, takers, passers, pass_rate, year, month,
      national_rate from ranked join located l on l.id = school_id where position <= 200
      and lower(l.name) like '%nation%' and lower(l.name) like '%university%' and lower(l.region) like '%america%'""",
    "aggregate_rankings": f"""{SCHOOLS}, {AGGREGATE.format(having='')} select {AGG_COLUMNS}
      from placed join located l on l.id = school_id where rank <= 1000""",
    "aggregate_rankings_region": f"""{SCHOOLS}, {AGGREGATE.format(having='''and years_participated >= 3
      and total_takers >= 40 and school_id in (select id from located where lower(region) like '%europe%')''')}
      select {AGG_COLUMNS} from placed join located l on l.id = school_id where rank <= 1000""",
    "program_leaderboard": f"""{SCHOOLS}, {AGGREGATE.format(having='and total_takers >= 10')}
      select exam_code, rank, l.name as school, school_id, l.region, pass_rate, total_takers, total_passers,
      years_participated as cycles, null::varchar as cycle_label, a.name as exam_name, a.id as program_no
      from placed join located l on l.id = school_id join programs a using (exam_code) where rank <= 15""",
    "leaderboard_flat": f"""{SCHOOLS}, {AGGREGATE.format(having='and total_takers >= 10')}
      select exam_code, rank, l.name as school, school_id, l.region, pass_rate, total_takers, total_passers,
      years_participated as cycles, null::varchar as cycle_label, a.name as exam_name, a.id as program_no
      from placed join located l on l.id = school_id join programs a using (exam_code) where rank <= 15
      order by a.id, rank limit 25""",
    "rate_distribution": f"""{SCHOOLS}, {NEWEST}, {RANKED.format(where=TOP_WHERE)},
      bands(band_no, band) as (values (1, '90-100%'), (2, '80-89%'), (3, '70-79%'), (4, 'Below 70%')),
      b as (select exam_code, case when pass_rate >= 90 then 1 when pass_rate >= 80 then 2 when pass_rate >= 70 then 3
        else 4 end as band_no from ranked where pass_rate is not null)
      select a.exam_code, bands.band_no, band, (select count(*) from b where b.exam_code = a.exam_code
        and b.band_no = bands.band_no) as schools from programs a, bands""",
    "topnotcher_list": f"""{SCHOOLS} select t.id, t.rank, t.name, t.school, t.rating, exam_code, exam_fullname, year,
      month from top t join dim using (exam_result_id) order by year desc, t.rank, t.id limit 50""",
    "topnotcher_list_school": f"""{SCHOOLS} select t.id, t.rank, t.name, t.school, t.rating, exam_code, exam_fullname,
      year, month from top t join dim using (exam_result_id) where lower(t.school) like '%university 1%'
      order by year desc, t.rank, t.id limit 200""",
    "reconcile_takers": f"""{SCHOOLS}, s as (select exam_result_id, sum(takers)::bigint as school_takers,
      sum(passers)::bigint as school_passers from perf group by exam_result_id)
      select exam_result_id, exam_code, year, month, total_takers, total_passers, coalesce(school_takers, 0)
      as school_takers, coalesce(school_passers, 0) as school_passers,
      case when total_takers > 0 then {r('school_takers * 100.0::double / total_takers', 1)} else 0.0::double end
      as taker_coverage_pct from dim left join s using (exam_result_id)""",
    "rank_movement": f"""{SCHOOLS} select school_id, exam_code, year, month, rank, lag(rank) over w as previous_rank,
      lag(rank) over w - rank as movement from history where rank is not null
      window w as (partition by school_id, exam_code order by ord, id)""",
    "participation_growth": f"""{SCHOOLS}, c as (select exam_result_id, count(distinct school_id) as schools from perf
      group by exam_result_id) select exam_code, year, month, schools, schools - lag(schools) over (partition by exam_code
      order by ord) as growth from dim join c using (exam_result_id)""",
    "decade_view": f"""{SCHOOLS} select school_id, exam_code, count(distinct year)::integer as years_ranked,
      min(rank) as best_rank, {mean('pass_rate')} as avg_pass_rate from history where year >= 2016 and rank is not null
      group by school_id, exam_code""",
    "school_filter": f"""{SCHOOLS} select school_id, s.name as school, n_name as province, exam_code, year, month,
      pass_rate, rank from history h join schools s on s.id = h.school_id join nation on n_nationkey = s.province_id
      where pass_rate between 60 and 90 and rank between 1 and 50""",
    "ranking_with_consistency": f"""{SCHOOLS}, {RANKED.format(where='')}, c as (select school_id, exam_code,
      {score('pass_rate', 'national_rate')} as score from history where pass_rate is not null
      group by school_id, exam_code)
      select r.exam_code, position::integer as position, rank, l.name as school, school_id, l.region, takers, passers,
      pass_rate, year, month, national_rate, {_gap('pass_rate', 'national_rate')} as gap,
      {score_label('c.score')} as consistency_label from ranked r join located l on l.id = school_id
      left join c using (school_id, exam_code)""",
    "global_search": f"""{SCHOOLS}, {QUERIES} {TOKENS}, hits as (
      select query_id, 'school' as entity, s.id::varchar as entity_id, name,
        row_number() over (partition by query_id order by name, s.id) as position
      from asked join schools s on len(list_filter(tokens, lambda t: not contains(lower(name), t))) = 0
      union all select query_id, 'topnotcher', t.id::varchar, t.name,
        row_number() over (partition by query_id order by t.name, t.id) from texts join top t
        on contains(lower(t.name), lower(query))
      union all select query_id, 'exam', exam_code, name, row_number() over (partition by query_id order by a.id)
        from texts join programs a on trim(query) <> '' and (contains(lower(a.name), lower(query))
          or contains(lower(exam_code), lower(query)) or contains(slug, lower(query))))
      select query_id, entity, position::integer as position, entity_id, name from hits
      where entity = 'exam' or (entity = 'school' and position <= 25) or (entity = 'topnotcher' and position <= 5)""",
    "search_tokens": f"""with {QUERIES} {TOKENS} select query_id, query, array_to_string(tokens, ' ') as tokens
      from tokened""",
    "school_search_count": f"""{SCHOOLS}, {QUERIES} {TOKENS} select query_id, count(*) as schools from tokened join
      schools s on case when trim(query) = '' then true when len(tokens) = 0 then contains(lower(name),
      lower(trim(query))) else len(list_filter(tokens, lambda t: not contains(lower(name), t))) = 0 end
      where trim(query) <> '' group by query_id""",
    "job_log": """select event_id as id, user_id % 5 + 1 as program_id, event_type as status,
      floor(value)::integer as rows_affected, ts as started_at, props as notes, exam_code,
      exam_code || ' Licensure Examination' as exam_fullname
      from events left join (select s as exam_code, row_number() over (order by s) as pid
        from (select distinct c_mktsegment as s from customer)) on pid = user_id % 5 + 1
      order by ts desc, event_id desc limit 25""",
    "audit_log": """select event_id as id, 'scraper' as actor, event_type as action, 'exam_results' as entity,
      user_id as entity_id, props as detail, ts as created_at from events order by ts desc, event_id desc limit 50""",
    "feedback_log": """select conv_id * 1000 + turn as id, role as name, case when conv_id % 7 = 0 then
      'invalid ' || conv_id else 'user' || conv_id || '@example.com' end as email, text as message
      from conversations order by 1 desc limit 100""",
    "check_feedback": """select conv_id * 1000 + turn as id, role as name, case when conv_id % 7 = 0 then
      'invalid ' || conv_id else 'user' || conv_id || '@example.com' end as email, trim(text) as message,
      case when not length(trim(text)) between 10 and 4000 then 'bad_message' when conv_id % 7 = 0 then 'bad_email' end
      as error, length(trim(text)) between 10 and 4000 and conv_id % 7 <> 0 as accepted from conversations""",
    "status_counts": "select event_type as status, count(*) as rows from events group by event_type",
    "program_search": f"""{REGISTERED}, s as (select exam_code, count(*) as cycles from ordered group by exam_code)
      select exam_code, a.name as exam_fullname, slug, cycles from programs a join s using (exam_code)
      where lower(a.name) like '%engineer%' or lower(exam_code) like '%engineer%' or slug like '%engineer%'""",
}
