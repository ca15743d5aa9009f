"""Oracle SQL of the national series."""

from __future__ import annotations

from .oracle_parts import NATIONAL, REGISTERED, delta_text, mean, num, pct, r, trend

SUMMARY = f"""select exam_code, exam_fullname, slug, count(*) as total_cycles,
  count(*) filter (where done) as complete_cycles, max(year) as latest_year, min(year) as earliest_year,
  {mean('case when done then pass_rate end')} as avg_national_pass_rate,
  coalesce(sum(total_takers) filter (where done), 0)::bigint as total_takers,
  coalesce(sum(total_passers) filter (where done), 0)::bigint as total_passers
from windowed group by exam_code, exam_fullname, slug"""

CYCLE_COLUMNS = ("id, exam_code, exam_fullname, slug, year, month, total_takers, total_passers, pass_rate, source_url, "
                 "month_no, phase")

STATS = f""", lagged as (
  select *, lag(pass_rate) over w as prev_rate, lag(total_takers) over w as prev_takers,
         min(pass_rate) over (partition by exam_code) as low_value
  from complete window w as (partition by exam_code order by ord)),
marked as (select *, min(ord) filter (where pass_rate = low_value) over (partition by exam_code) as low_ord from lagged),
stats as (
  select exam_code, count(*) as n, {mean('pass_rate')} as avg_rate,
    floor(sum(total_takers) / count(*) + 0.5)::bigint as avg_takers,
    case when count(*) >= 2 then {r('stddev_samp(pass_rate)', 2)} end as vol,
    arg_min(label, ord) as first_label, arg_min(pass_rate, ord) as first_rate, arg_min(total_takers, ord) as first_takers,
    arg_max(label, ord) as last_label, arg_max(pass_rate, ord) as last_rate, arg_max(total_takers, ord) as last_takers,
    (array_agg(prev_rate order by ord desc))[1] as prev_rate, (array_agg(prev_takers order by ord desc))[1] as prev_takers,
    (array_agg(label order by pass_rate desc, ord desc))[1] as high_label,
    (array_agg(short order by pass_rate desc, ord desc))[1] as high_short, max(pass_rate) as high_rate,
    (array_agg(label order by pass_rate, ord))[1] as low_label, min(pass_rate) as low_rate,
    (array_agg(label order by total_takers desc, ord desc))[1] as peak_label,
    (array_agg(short order by total_takers desc, ord desc))[1] as peak_short,
    (array_agg(pass_rate order by total_takers desc, ord desc))[1] as peak_rate, max(total_takers) as peak_takers,
    (array_agg(label order by total_takers, ord))[1] as trough_label, min(total_takers) as trough_takers,
    min(ord) as first_ord, min(low_ord) as low_ord,
    arg_min(label, ord) filter (where ord > low_ord and pass_rate >= low_value + 5) as rec_label,
    arg_min(pass_rate, ord) filter (where ord > low_ord and pass_rate >= low_value + 5) as rec_rate,
    min(year) as year_from, max(year) as year_to, sum(total_takers)::bigint as total_takers,
    sum(coalesce(total_passers, 0))::bigint as total_passers,
    sum(greatest(0, total_takers - coalesce(total_passers, 0)))::bigint as total_failed
  from marked group by exam_code)"""

VOLATILITY = "case when vol < 8 then 'Low' when vol <= 15 then 'Medium' when vol is not null then 'High' end"
CHANGE = r('last_rate - prev_rate', 2)

RATE_INSIGHT = f"""case when n < 2 then null
  when n >= 3 and rec_label is not null and low_ord > first_ord and first_rate > low_rate + 3 then
    'Insight: Pass rates declined toward ' || low_label || ' (' || {pct('low_rate')} || '), then recovered starting '
    || rec_label || ' (' || {pct('rec_rate')} || ').'
  when n >= 3 and rec_label is not null and last_rate >= low_rate + 8 then
    'Insight: Pass rates reached a low of ' || {pct('low_rate')} || ' in ' || low_label || ', then rose to '
    || {pct('last_rate')} || ' by ' || last_label || '.'
  when abs(last_rate - first_rate) >= 3 then
    'Insight: Pass rates ' || case when last_rate > first_rate then 'rose' else 'fell' end || ' from '
    || {pct('first_rate')} || ' (' || first_label || ') to ' || {pct('last_rate')} || ' (' || last_label || ').'
  when vol < 8 then 'Insight: Pass rates stayed relatively stable around ' || {pct('avg_rate')} || ' (σ = '
    || printf('%.2f', vol) || ' pts across ' || n || ' cycles).'
  else 'Insight: Across ' || n || ' complete cycles, pass rates ranged from ' || {pct('low_rate')} || ' (' || low_label
    || ') to ' || {pct('high_rate')} || ', with a 10-year average of ' || {pct('avg_rate')} || '.' end"""

VOLUME_INSIGHT = f"""case when n < 2 then null
  when peak_label <> trough_label and peak_takers - trough_takers >= avg_takers * 0.25::double then
    'Insight: Examinee volume ranged from ' || {num('trough_takers')} || ' (' || trough_label || ') to '
    || {num('peak_takers')} || ' (' || peak_label || '), with a 10-year average of ' || {num('avg_takers')}
    || ' per cycle.'
  when abs(last_takers - first_takers) >= avg_takers * 0.15::double then
    'Insight: Examinee volume ' || case when last_takers > first_takers then 'rose' else 'fell' end || ' from '
    || {num('first_takers')} || ' (' || first_label || ') to ' || {num('last_takers')} || ' (' || last_label || ').'
  when peak_label = last_label then 'Insight: The latest cycle (' || last_label
    || ') also recorded the highest examinee volume in the window (' || {num('peak_takers')} || ').'
  else 'Insight: Examinee volume averaged ' || {num('avg_takers')} || ' per cycle across ' || n
    || ' complete administrations.' end"""

COMBINED_INSIGHT = f"""case when n < 2 then null
  when peak_label <> high_label and peak_short <> high_short then
    'Insight: Peak examinee volume was ' || {num('peak_takers')} || ' in ' || peak_label || ' (pass rate '
    || {pct('peak_rate')} || '), while the highest pass rate was ' || {pct('high_rate')} || ' in ' || high_label || '.'
  else 'Insight: Pass rates ranged from ' || {pct('low_rate')} || ' (' || low_label || ') to ' || {pct('high_rate')}
    || ' (' || high_label || '), with a 10-year average of ' || {pct('avg_rate')} || '.' end"""

ENRICHED = f""", enriched as (
  select exam_code, id, year, month, label as cycle_label, total_takers, total_passers, pass_rate, source_url,
    done as is_complete, case when done then {r('pass_rate - lag(pass_rate) over w', 2)} end as delta_pts, month_no, phase
  from windowed window w as (partition by exam_code, done order by ord))"""

DIFFICULTY = f"""select exam_code, {mean('pass_rate')} as avg_rate, max(pass_rate) as highest_rate,
  min(pass_rate) as lowest_rate, count(pass_rate) as cycles,
  {trend('count(pass_rate)', 'arg_min(pass_rate, ord)', 'arg_max(pass_rate, ord)')} as trend"""

SQL: dict[str, str] = {
    "national_counts": """select p_brand, cast(year(o_orderdate) + 20 as integer) as year,
      cast(month(o_orderdate) as integer) as month_no, l_linestatus, count(*) as takers,
      count(*) filter (where l_returnflag <> 'R') as passers
      from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all""",
    "exam_summary": f"{NATIONAL} {SUMMARY}",
    "exam_cycles": f"{NATIONAL} select {CYCLE_COLUMNS} from ordered",
    "exam_history": f"{NATIONAL} select {CYCLE_COLUMNS} from ordered where done",
    "exam_cycles_in_month": f"{NATIONAL} select {CYCLE_COLUMNS} from ordered where lower(month) like '%may%'",
    "list_cycles": f"""{NATIONAL} select id, exam_code, month, year, total_takers, total_passers, pass_rate, source_url
      from ordered where year between 2016 and 2020""",
    "exam_difficulty": f"""{NATIONAL} {DIFFICULTY} from (select o.exam_code, ord,
      case when done and year >= 2016 then pass_rate end as pass_rate from ordered o) group by exam_code""",
    "compare_exams": f"""{REGISTERED}, st as ({DIFFICULTY} from (select exam_code, ord,
      case when done and year >= 2016 then pass_rate end as pass_rate from ordered) group by exam_code),
      recent as (select exam_code, label, pass_rate, total_takers,
        (row_number() over (partition by exam_code order by ord desc))::integer as no from complete)
      select a.exam_code, a.name as exam_fullname, a.slug, st.avg_rate as avg_10yr, st.trend,
        f.label as latest_cycle, f.pass_rate as latest_rate, x.no as recent_no, x.label as recent_label,
        x.pass_rate as recent_rate, x.total_takers as recent_takers
      from programs a left join st using (exam_code) left join recent f on f.exam_code = a.exam_code and f.no = 1
      left join recent x on x.exam_code = a.exam_code and x.no <= 3""",
    "exam_popularity": f"""{NATIONAL} select exam_code, exam_fullname, slug, total_takers, total_cycles as cycles
      from ({SUMMARY})""",
    "hardest_easiest": f"""{NATIONAL}, s as (select exam_code, replace(exam_fullname, ' Licensure Examination', '')
      as short_name, avg_national_pass_rate from ({SUMMARY}) where complete_cycles > 0)
      select * from (select *, 'hardest' as list from s order by avg_national_pass_rate, exam_code limit 5)
      union all select * from (select *, 'easiest' as list from s order by avg_national_pass_rate desc, exam_code
      limit 3)""",
    "catalog_browse": f"""{REGISTERED}, s as ({SUMMARY}) select a.exam_code, a.name as exam_fullname, a.slug, category,
      (list_position(['education', 'health', 'engineering', 'architecture', 'business', 'social', 'agriculture'],
        category) - 1)::integer as category_order, coalesce(complete_cycles, 0) as complete_cycles,
      avg_national_pass_rate, 15::bigint as shown, 15::bigint as total from programs a left join s using (exam_code)""",
    "enriched_history": f"{NATIONAL} {ENRICHED} select * from enriched",
    "history_report": f"""{NATIONAL} {ENRICHED} select exam_code, year, month, cycle_label as cycle,
      case when is_complete then total_takers end as total_takers,
      case when is_complete and total_passers is not null then greatest(0, total_takers - total_passers) end
        as total_failed,
      case when is_complete then total_passers end as total_passers,
      case when is_complete then {r('100.0 - pass_rate', 2)} end as failed_rate,
      case when is_complete then pass_rate end as pass_rate, delta_pts, is_complete as complete, source_url
      from enriched""",
    "highlights": f"""{NATIONAL} select exam_code, id, label as cycle_label, pass_rate,
      case when not done then null when pass_rate = max(pass_rate) filter (where done) over w then 'highest'
           when pass_rate = min(pass_rate) filter (where done) over w then 'lowest' end as highlight
      from windowed window w as (partition by exam_code)""",
    "coverage": f"""{NATIONAL}, c as (select exam_code, count(*) as cycle_count, count(*) filter (where done)
      as complete_count, min(year) as year_from, max(year) as year_to from windowed group by exam_code)
      select exam_code, cycle_count, complete_count, cycle_count - complete_count as incomplete_count, year_from, year_to,
        case when complete_count > 0 then complete_count else cycle_count end || ' cycle'
        || case when case when complete_count > 0 then complete_count else cycle_count end = 1 then '' else 's' end
        || ' · ' || year_from || '–' || year_to as label,
        case when cycle_count > complete_count then (cycle_count - complete_count) || ' incomplete cycle'
        || case when cycle_count - complete_count = 1 then '' else 's' end || ' excluded from pass-rate averages' end
        as incomplete_note from c""",
    "national_totals": f"""{NATIONAL} {STATS} select exam_code, total_takers, total_passers, total_failed,
      avg_rate as avg_pass_rate from stats""",
    "trend_analytics": f"""{NATIONAL} {STATS}, t as (select *, {trend('n', 'first_rate', 'last_rate')} as badge,
      {CHANGE} as change from stats) select exam_code, avg_rate as avg_pass_rate, vol as volatility_pts,
      {VOLATILITY} as volatility_label, badge as trend_badge,
      case badge when 'Improving' then 'Increasing' when 'Declining' then 'Decreasing' else badge end as trend_direction,
      high_label as highest_label, high_rate as highest_rate, low_label as lowest_label, low_rate as lowest_rate,
      last_label as latest_label, last_rate as latest_rate, change as change_pts,
      case when change is not null then last_label end as change_label, {delta_text('change')} as change_text,
      total_takers, total_passers, total_failed, year_from, year_to, n as cycle_count, {RATE_INSIGHT} as insight
      from t""",
    "volume_analytics": f"""{NATIONAL} {STATS} select exam_code, avg_takers, peak_label, peak_takers,
      trough_label as lowest_label, trough_takers as lowest_takers, last_label as latest_label,
      last_takers as latest_takers, last_takers - prev_takers as change_takers,
      case when prev_takers is not null then last_label end as change_label, total_takers, total_passers, total_failed,
      year_from, year_to, n as cycle_count, {VOLUME_INSIGHT} as insight from stats""",
    "combined_analytics": f"""{NATIONAL} {STATS} select exam_code, avg_rate as avg_pass_rate, high_label as
      highest_label, high_rate as highest_rate, low_label as lowest_label, low_rate as lowest_rate, peak_label,
      peak_takers, trough_label, trough_takers, {CHANGE} as change_pts, year_from, year_to, n as cycle_count,
      {COMBINED_INSIGHT} as insight from stats""",
    "rate_insight": f"{NATIONAL} {STATS} select exam_code, {RATE_INSIGHT} as insight from stats",
    "volume_insight": f"{NATIONAL} {STATS} select exam_code, {VOLUME_INSIGHT} as insight from stats",
    "combined_insight": f"{NATIONAL} {STATS} select exam_code, {COMBINED_INSIGHT} as insight from stats",
    "chart_series": f"""{NATIONAL} select exam_code, id, short as label, label as full_label, abbr || suffix as
      cycle_month, right(year::varchar, 2) as cycle_year, pass_rate as national, total_takers as takers
      from complete""",
    "headline_extremes": f"""{NATIONAL} select exam_code,
      (array_agg(label order by done desc, ord desc))[1] as latest_label,
      (array_agg(pass_rate order by done desc, ord desc))[1] as latest_rate,
      (array_agg(label order by pass_rate desc, ord desc) filter (where done))[1] as highest_label,
      (array_agg(pass_rate order by pass_rate desc, ord desc) filter (where done))[1] as highest_rate,
      (array_agg(label order by pass_rate, ord desc) filter (where done))[1] as lowest_label,
      (array_agg(pass_rate order by pass_rate, ord desc) filter (where done))[1] as lowest_rate
      from windowed group by exam_code""",
}
