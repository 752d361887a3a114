"""DuckDB text shared by the oracle of several queries: the analog views as common table expressions."""

from __future__ import annotations

from .analog import FACTS

HOLDINGS = """holdings as (select l_suppkey as manager, p_brand as stock, last_day(date_trunc('quarter', l_shipdate)::date + interval 2 month) as period,
  l_quantity as shares, l_extendedprice as value from lineitem join part on p_partkey = l_partkey)"""
POSITIONS = f"""{HOLDINGS},
exactly as (select manager, stock, period, sum(shares::decimal(38,6))::double as shares, sum(value::decimal(38,6)) as exact, exact::double as value from holdings group by all),
g as (select manager, stock, period, shares, value, (sum(exact) over (partition by manager, period))::double as total from exactly),
pos as (select * exclude (total), case when total > 0 then value / total else 0 end as weight,
  row_number() over (partition by manager, period order by value desc, stock) as position_rank from g window w as (partition by manager, period)),
idx as (select period, row_number() over (order by period) as idx from (select distinct period from g))"""
ACTIONS = f"""{POSITIONS},
act as (select p.*, b.shares as previous_shares, case when b.shares > 0 then (p.shares - b.shares) / b.shares end as share_delta,
  case when b.shares is null then 'new' when b.shares <= 0 then 'add' when (p.shares - b.shares) / b.shares > 0.05 then 'add'
    when (p.shares - b.shares) / b.shares < -0.05 then 'reduce' else 'flat' end as action
  from pos p join idx i using (period) left join idx j on j.idx = i.idx - 1 left join g b on b.manager = p.manager and b.stock = p.stock and b.period = j.period)"""
STREAKS = """isl as (select manager, stock, period, idx, idx - row_number() over (partition by manager, stock order by idx) as island from g join idx using (period)),
streaks as (select manager, stock, period, row_number() over (partition by manager, stock, island order by idx) as streak from isl)"""
TURNOVER = """marks as (select manager, stock, idx, 1 as now, 0 as was from g join idx using (period) union all select manager, stock, idx + 1, 0, 1 from g join idx using (period)),
sides as (select manager, stock, idx, max(now) as now, max(was) as was from marks group by all),
turn as (select s.manager, i.period, case when max(was) = 1 then count(*) filter (now <> was)::double / count(*) end as turnover from sides s join idx i using (idx) group by s.manager, i.period having max(now) = 1)"""
PROFILES = f"""{STREAKS}, {TURNOVER},
prof as (select p.manager, p.period, sum(case when position_rank <= 10 then weight end) as top_ten, count(*) as names, avg(streak) as mean_streak
  from pos p join streaks using (manager, stock, period) group by all),
profiles as (select prof.*, turnover, case when coalesce(turnover, 0) >= 0.6 then 'high_turnover' when top_ten >= 0.5 and names <= 25 then 'value_concentrated' when mean_streak >= 4 then 'long_term' else 'unknown' end as kind,
  case when coalesce(turnover, 0) >= 0.6 then 0.3 when top_ten >= 0.5 and names <= 25 then 1.0 when mean_streak >= 4 then 1.0 else 0.6 end as manager_weight
  from prof left join turn using (manager, period))"""
SIGNALS = f"""{ACTIONS}, {PROFILES},
sig as (select act.*, streak, kind, manager_weight, turnover, value / shares as price,
  greatest(least(weight * 4, 1) + case when position_rank <= 10 then 0.4 else 0 end + case when weight >= 0.05 then 0.3 else 0 end + case when streak >= 4 then 0.3 else 0 end
    + case when action in ('new', 'add') then 0.2 when action = 'reduce' then -0.2 else 0 end, 0) as signal
  from act join streaks using (manager, stock, period) join profiles using (manager, period))"""
WIDE = "wide as (select l_suppkey as stock, year(l_shipdate) as y, " + ", ".join(f'{e} as "{k}"' for k, e in FACTS.items()) + " from lineitem group by all)"
FACT_ROWS = WIDE + ",\nfacts as (" + " union all ".join(f"select stock, make_date(y, 12, 31) as period_end, '{k}' as metric_key, \"{k}\" as value, stock * 10000 + y as fact_id, case when y >= 2001 then 'estimate' else 'actual' end as nature from wide" for k in FACTS) + ")"
FILINGS = "filings as (select o_custkey as manager, year(o_orderdate) as period, o_orderdate as filed_at, o_orderkey as filing, o_orderstatus as status, o_totalprice as reported from orders)"
PRICES = "prices as (select user_id as stock, ts::date as day, value as close, event_id from events)"
