"""DuckDB SQL for the queries, written from the operators' definitions."""

from __future__ import annotations

HOURLY = "hourly as (select event_type as tag, date_trunc('hour', ts)::timestamp as hr, avg(value) as v from events group by 1, 2)"
BANDS = """bands as (select event_type as tag, median(value) as med, quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.95) as p95, avg(value) as mu, stddev_samp(value) as sd
    from events where ts < timestamp '2024-01-11' group by 1)"""
Z = f"{HOURLY}, {BANDS}, z as (select h.tag, h.hr, (h.v - b.mu) / nullif(b.sd, 0) as z from hourly h join bands b using (tag))"
PART = "part as (select tag, hr, case tag when 'error' then 0.5 when 'click' then 0.3 else 0.1 end * case when z > 0 then z else 0 end as part from z)"
RAW = f"{Z}, {PART}, raw as (select hr, sum(part) as raw from part group by 1)"
EWMA = "list_reduce(list(value order by ts, event_id), lambda a, v: 0.3 * v + 0.7 * a)"
FLAGGED = f"{Z}, flagged as (select * from z where abs(z) > 1.5)"
EPISODES = f"""{FLAGGED}, marked as (select *, case when date_diff('second', lag(hr) over (partition by tag order by hr), hr) <= 3 * 3600 then 0 else 1 end as new from flagged),
    numbered as (select *, sum(new) over (partition by tag order by hr) as episode from marked),
    episodes as (select tag, episode::bigint as episode, min(hr) as "start", max(hr) as until, count(*) as n, max(abs(z)) as peak from numbered group by 1, 2)"""
SESSIONS = """marked as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events),
    numbered as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from marked)"""
PAIRS = """pairs as (select e.event_id as target_id, i.event_id as precursor_id, i.event_type as tag from events e join events i
    on i.user_id = e.user_id and i.ts < e.ts and i.ts >= e.ts - interval 24 hour where e.event_type = 'error')"""
BACK = f"""{Z}, late as (select * from z where hr >= timestamp '2024-01-11'),
    part as (select tag, hr, case tag when 'error' then 0.5 when 'click' then 0.3 else 0.1 end * case when z > 0 then z else 0 end as part from late where tag <> 'error'),
    alerts as (select hr from (select hr, sum(part) as raw from part group by 1) where 100 / (1 + exp(-(raw - 1))) >= 50),
    evs as (select hr from late where tag = 'error' and z > 1.5),
    near as (select a.hr as a, e.hr as e from alerts a join evs e on a.hr < e.hr and a.hr >= e.hr - interval 6 hour)"""


TAGS = ("click", "error", "purchase", "signup", "view")


def solved(name: str, source: str, k: int, keep: str = "") -> str:
    """CTEs that solve k equations by elimination, without pivoting: source has h_i_j and g_i; the last, name, has d_i. keep: columns that identify a system."""
    out, last = [], source
    for i in range(k):
        rows = ", ".join([*(f"h_{a}_{b} - h_{a}_{i} / h_{i}_{i} * h_{i}_{b} as h_{a}_{b}" for a in range(k) if a != i for b in range(i + 1, k)), *(f"g_{a} - h_{a}_{i} / h_{i}_{i} * g_{i} as g_{a}" for a in range(k) if a != i)])
        own = ", ".join([*(f"h_{i}_{b} / h_{i}_{i} as h_{i}_{b}" for b in range(i + 1, k)), f"g_{i} / h_{i}_{i} as g_{i}"])
        out.append(f"{name}_{i} as materialized (select {keep}{rows}, {own} from {last})")
        last = f"{name}_{i}"
    out.append(f"{name} as materialized (select {keep}{', '.join(f'g_{a} as d_{a}' for a in range(k))} from {last})")
    return ",\n".join(out)


def _features() -> str:
    wide = ", ".join(f"max(z) filter (tag = '{t}') as {t}" for t in TAGS)
    means = ", ".join(f"coalesce(avg({t}) over past, 0) as x{j}" for j, t in enumerate(TAGS, 1))
    return f"""{Z}, wide as (select hr, {wide} from z group by hr),
    feats as materialized (select hr, 1.0::double as x0, {means}, coalesce(max((error > 1.5)::int) over after, 0)::double as y, hr < timestamp '2024-01-11' as fit from wide
        window past as (order by hr range between interval 24 hour preceding and current row), after as (order by hr range between interval 1 microsecond following and interval 6 hour following)),
    spread as materialized (select 0.0 as s0, {', '.join(f'coalesce(var_samp(x{j}), 0) as s{j}' for j in range(1, 6))} from feats where fit)"""


def _newton(k: int) -> str:
    """One step toward the optimum of the penalised logistic model."""
    n = range(6)
    odds = " + ".join(f"b_{j} * x{j}" for j in n)
    sums = ", ".join([*(f"avg((p - y) * x{j}) as q_{j}" for j in n), *(f"avg(p * (1 - p) * x{i} * x{j}) as c_{i}_{j}" for i in n for j in n)])
    ridge = ", ".join([*(f"q_{j} + 0.01 * s{j} * b_{j} as g_{j}" for j in n), *(f"c_{i}_{j} + {f'0.01 * s{i}' if i == j else '0'} as h_{i}_{j}" for i in n for j in n)])
    return f"""sum{k} as materialized (select {sums} from (select feats.*, 1 / (1 + exp(-({odds}))) as p from feats, b{k} where fit)),
    sys{k} as materialized (select {ridge} from sum{k}, b{k}, spread),
    {solved(f'step{k}', f'sys{k}', 6)},
    b{k + 1} as materialized (select {', '.join(f'b_{j} - d_{j} as b_{j}' for j in n)} from b{k}, step{k})"""


STEPS = 10
MODEL = f"{_features()}, b0 as (select {', '.join(f'0.0::double as b_{j}' for j in range(6))}),\n" + ",\n".join(_newton(k) for k in range(STEPS))
ODDS = "(" + " + ".join(f"b_{j} * x{j}" for j in range(6)) + ")"
MEANS = "means as (select " + ", ".join(f"avg(x{j}) as m{j}" for j in range(1, 6)) + " from feats where fit)"
LOSS = "avg(-y * ln(1 / (1 + exp(-({o})))) - (1 - y) * ln(1 - 1 / (1 + exp(-({o})))))"
EFFECT_XS = ("1.0::double", "share", "hour(hr)::double", "load::double")
EFFECT = f"""{Z}, s as (select date_trunc('hour', ts)::timestamp as hr, count(*) filter (event_type = 'signup') / count(*)::double as share, count(*) as load from events group by 1),
    x as (select tag, z as y, {', '.join(f'{x} as x{j}' for j, x in enumerate(EFFECT_XS))} from z join s using (hr) where z is not null),
    gram as materialized (select tag, count(*) as n, sum(y * y) as yy, {', '.join(f'sum(x{i} * x{j}) as h_{i}_{j}' for i in range(4) for j in range(4))}, {', '.join(f'sum(x{j} * y) as g_{j}' for j in range(4))} from x group by tag),
    unit as materialized (select tag, {', '.join(f'h_{i}_{j}' for i in range(4) for j in range(4))}, 0.0 as g_0, 1.0 as g_1, 0.0 as g_2, 0.0 as g_3 from gram),
    {solved('beta', 'gram', 4, 'tag, ')}, {solved('inv', 'unit', 4, 'tag, ')}"""
FOLDS = f"""{HOURLY}, o as (select timestamp '2024-01-11' + k * interval 5 day as origin from (select unnest(range(4)) as k)),
    base as (select origin, event_type as tag, avg(value) as mu, stddev_samp(value) as sd from events, o where ts < origin group by 1, 2),
    z as (select b.origin, h.tag, h.hr, (h.v - b.mu) / nullif(b.sd, 0) as z from hourly h join base b on b.tag = h.tag and h.hr >= b.origin and h.hr < b.origin + interval 5 day),
    part as (select origin, tag, hr, case tag when 'click' then 0.3 else 0.1 end * case when z > 0 then z else 0 end as part from z where tag <> 'error'),
    alerts as (select origin, hr from (select origin, hr, sum(part) as raw from part group by 1, 2) where 100 / (1 + exp(-(raw - 1))) >= 50),
    evs as (select origin, hr from z where tag = 'error' and z > 1.5),
    near as (select a.origin, a.hr as a, e.hr as e from alerts a join evs e on a.origin = e.origin and a.hr < e.hr and a.hr >= e.hr - interval 6 hour),
    led as (select origin, median(h) as lead_hours from (select origin, e, date_diff('hour', min(a), e)::double as h from near group by 1, 2) group by 1),
    c as (select origin, (select count(*) from alerts x where x.origin = o.origin) as alerts, (select count(*) from evs x where x.origin = o.origin) as events,
        (select count(distinct a) from near x where x.origin = o.origin) as true_alerts, (select count(distinct e) from near x where x.origin = o.origin) as warned from o)"""
HOURS = f"""with {Z}, e as (select hr from z where tag = 'error' and z > 1.5),
    l as (select h.hr, exists (select 1 from e where e.hr > h.hr and e.hr <= h.hr + interval 6 hour) as label from (select distinct hr from z) h)
    select count(*) filter (hr >= timestamp '2024-01-11') as hours, count(*) filter (label and hr >= timestamp '2024-01-11') as positives, true as proper,
        (select round(case when r > 0 and r < 1 then -r * ln(r) - (1 - r) * ln(1 - r) else 0 end, 9) + 0.0 from (select avg(label::int) as r from l where hr < timestamp '2024-01-11')) as base_loss, true as learns from l"""


def r(x: str, name: str | None = None, digits: int = 9) -> str:
    return f"round({x}, {digits}) + 0.0 as {name or x}"


SQL: dict[str, str] = {
    "riskiest_hours": f"with {RAW}, k as (select hr, raw, 100 / (1 + exp(-(raw - 1))) as risk from raw) select hr, {r('raw')}, {r('risk')}, case when risk >= 75 then 'HIGH' when risk >= 50 then 'MEDIUM' else 'LOW' end as band from k",
    "a1_scan": "select event_id, value from events where event_type = 'error' and value > 3",
    "a2_delimited_text": f"select event_id, ts, user_id, event_type, {r('value')}, props from events",
    "a2_csv_files": f"select event_id, ts, user_id, event_type, {r('value')}, props from events",
    "a2_json_files": f"select event_id, ts, user_id, event_type, {r('value')}, props from events",
    "a2_json_text": f"select event_id, user_id, event_type, {r('value')} from events",
    "a3_workbooks": f"select event_id, ts, user_id, event_type, {r('value')}, props from events",
    "c6_sketch_tags": "select event_type as tag, count(*) as n, count(distinct user_id) as users, true as quantile_near, true as users_near from events group by 1",
    "c6_sketch_days": "select event_type as tag, date_trunc('day', ts)::timestamp as day, count(*) as n, count(distinct user_id) as users, true as quantile_near, true as users_near from events group by 1, 2",
    "a4_curated_tier": f"with {HOURLY} select tag, hr, {r('v')} from hourly",
    "a5_profile": f"select event_type as tag, count(*) as n, count(value) as known, count(distinct user_id) as users, {r('min(value)', 'lo')}, {r('max(value)', 'hi')} from events group by 1",
    "a6_coverage": f"select event_type as tag, count(distinct date_trunc('hour', ts)) as hours, {r("count(distinct date_trunc('hour', ts)) / 720.0::double", 'coverage')} from events group by 1",
    "a7_gap_fill": f"""with {HOURLY}, grid as (select tag, hr from (select distinct event_type as tag from events), (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30 23:00:00', interval 1 hour)) as hr)),
        j as (select g.tag, g.hr, h.v from grid g left join hourly h on g.tag = h.tag and g.hr = h.hr)
        select tag, hr, round(last_value(v ignore nulls) over (partition by tag order by hr rows unbounded preceding), 9) + 0.0 as v, v is null as filled from j""",
    "a8_keep_first": "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn = 1",
    "a9_stuck": """with f as (select *, case when abs(value - lag(value) over (partition by event_type order by ts, event_id)) <= 0.5 then 0 else 1 end as new from events),
        g as (select *, sum(new) over (partition by event_type order by ts, event_id rows unbounded preceding) as run from f)
        select event_type as tag, run::bigint as run, count(*) as n, min(ts) as "start", max(ts) as until from g group by 1, 2 having count(*) > 1""",
    "a10_json_attribute": "select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1",
    "a11_tolerant": f"select event_id, {r("try_cast(json_extract_string(props, '$.k') as double)", 'k')}, {r("value / nullif(try_cast(json_extract_string(props, '$.k') as double), 0)", 'ratio')} from events",
    "b1_tumbling": f"select date_trunc('hour', ts)::timestamp as \"start\", count(*) as n, {r('avg(value)', 'v')} from events group by 1",
    "b2_sliding": f"select date_trunc('hour', ts)::timestamp - k * interval 1 hour as \"start\", count(*) as n, {r('avg(value)', 'v')} from events, (select unnest([0, 1]) as k) group by 1",
    "b3_sessions": f'with {SESSIONS} select user_id, min(ts) as "start", max(ts) as until, count(*) as n from numbered group by user_id, session',
    "b4_rolling_rows": f"select event_id, {r('avg(value) over (partition by event_type order by ts, event_id rows between 5 preceding and 1 preceding)', 'roll')} from events",
    "b5_rolling_time": f"select event_id, {r('avg(value) over (partition by event_type order by ts range between interval 6 hour preceding and current row)', 'roll')} from events",
    "b6_difference": f"select event_id, {r('value - lag(value, 3) over (partition by event_type order by ts, event_id)', 'diff')} from events",
    "b7_ewma_last": f"select user_id, {r(EWMA, 'ewma')} from events group by 1",
    "b7_ewma_series": """with recursive n as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events),
        e as (select event_id, user_id, k, value as ewma from n where k = 1 union all select n.event_id, n.user_id, n.k, 0.3 * n.value + 0.7 * e.ewma from e join n on n.user_id = e.user_id and n.k = e.k + 1)
        select event_id, user_id, round(ewma, 9) + 0.0 as ewma from e""",
    "b8_pivot": "select date_trunc('day', ts)::timestamp as day, " + ", ".join(f"round(avg(value) filter (event_type = '{t}'), 9) + 0.0 as {t}" for t in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
    "b9_histogram": "select case when value < 0 then 0 when value >= 200 then 9 else floor(value / 25)::bigint + 1 end as bin, count(*) as n from events group by 1",
    "b10_unpivot": f"with {BANDS} " + " union all ".join(f"select tag, '{c}' as name, round({c}, 9) + 0.0 as x from bands" for c in ("med", "p05", "p95", "mu", "sd")),
    "c1_bands": f"with {BANDS} select tag, {r('med')}, {r('p05')}, {r('p95')}, {r('mu')}, {r('sd')} from bands",
    "c2_mad": f"select event_type as tag, {r('median(value)', 'med')}, {r('mad(value)', 'mad')} from events group by 1",
    "c3_deviation": f"with {Z} select tag, hr, {r('z')} from z",
    "c4_shape": f"select event_type as tag, {r('skewness(value)', 'skew')}, {r('kurtosis_pop(value)', 'kurt')} from events group by 1",
    "c5_rolling_z": "select event_id, round((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 9) + 0.0 as z from events window w as (partition by event_type order by ts, event_id rows between 50 preceding and 1 preceding)",
    "c6_quick_p95": f"select event_type as tag, {r('quantile_disc(value, 0.95)', 'p95', 2)} from events group by 1",
    "d1_smoothed": f"with {Z} select tag, hr, {r('avg(z) over (partition by tag order by hr range between interval 23 hour preceding and current row)', 'kpi')} from z",
    "d2_cusum": f"with {Z} select tag, hr, {r('sum(z) over (partition by tag order by hr rows unbounded preceding)', 'cs')} from z",
    "d3_rise": f"with {Z}, c as (select tag, hr, sum(z) over (partition by tag order by hr rows unbounded preceding) as cs from z) select tag, hr, {r('cs - min(cs) over (partition by tag order by hr rows unbounded preceding)', 'rise')} from c",
    "d4_trend": f"with {Z} select tag, {r("regr_slope(z, date_diff('day', date '2024-01-01', hr::date)::double)", 'slope', 6)} from z group by 1",
    "d5_periods": f"""with {Z}, p as (select tag, avg(z) filter (hr < timestamp '2024-01-11') as a, avg(z) filter (hr >= timestamp '2024-01-11') as b from z group by 1)
        select tag, {r('a', 'before')}, {r('b', 'after')}, {r('b - a', 'change')} from p""",
    "e1_lagged_correlation": f"""with {HOURLY}, p as (select c.v as d, e.v as t from hourly c join hourly e on e.tag = 'error' and e.hr = c.hr + interval 1 hour where c.tag = 'click')
        select {r('covar_pop(d, t) / nullif(stddev_pop(d) * stddev_pop(t), 0)', 'r')}, count(*) as n from p""",
    "e2_precursors": f"with {PAIRS} select target_id, precursor_id from pairs where tag = 'click'",
    "e3_precursor_rate": f"""with x as (select event_type = 'error' as target, exists (select 1 from events i where i.user_id = e.user_id and i.event_type = 'click' and i.ts < e.ts and i.ts >= e.ts - interval 24 hour) as hit from events e),
        n as (select count(*) filter (target) as events, count(*) filter (target and hit) as hits, count(*) filter (not target) as others, count(*) filter (not target and hit) as other_hits from x)
        select events, hits, {r('hits::double / nullif(events, 0)', 'rate')}, {r('other_hits::double / nullif(others, 0)', 'base')}, {r('(hits::double / nullif(events, 0)) / nullif(other_hits::double / nullif(others, 0), 0)', 'lift')} from n""",
    "e4_as_of": """select target_id, precursor_id from (select e.event_id as target_id, i.event_id as precursor_id, row_number() over (partition by e.event_id order by i.ts desc nulls last, i.event_id desc) as rn
        from events e left join events i on i.user_id = e.user_id and i.event_type = 'click' and i.ts <= e.ts where e.event_type = 'error') where rn = 1""",
    "e5_fuel_share": f"select date_trunc('hour', ts)::timestamp as hr, {r("count(*) filter (event_type = 'signup') / count(*)::double", 'share')} from events group by 1",
    "e6_fuel_impact": f"""with {Z}, s as (select date_trunc('hour', ts)::timestamp as hr, count(*) filter (event_type = 'signup') / count(*)::double as share from events group by 1),
        b as (select hr, ntile(4) over (order by share, hr) as bucket from s)
        select bucket, tag, count(*) as n, {r('avg(z)', 'mean_z')}, {r('stddev_samp(z)', 'sd_z')} from z join b using (hr) group by 1, 2""",
    "e7_unit_regression": f"""with t as (select user_id, value, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6::double as s from events),
        g as (select user_id, covar_pop(s, value) as c, stddev_pop(s) as a, stddev_pop(value) as b, var_pop(s) as v from t group by 1)
        select user_id, {r('c / nullif(a * b, 0)', 'r')}, {r('c / nullif(v, 0)', 'slope', 8)}, {r('(c / nullif(a * b, 0)) * (c / nullif(a * b, 0))', 'r2')} from g""",
    "f1_z_rule": f"with {FLAGGED} select tag, hr, {r('z')} from flagged",
    "f2_iqr_rule": f"""with q as (select event_type as tag, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1)
        select event_id, tag, {r('value')} from events join q on tag = event_type where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""",
    "f3_mad_rule": f"""with m as (select event_type as tag, median(value) as med, mad(value) as mad from events group by 1)
        select event_id, tag, {r('value')} from events join m on tag = event_type where 0.6745 * abs(value - med) / nullif(mad, 0) > 3.5""",
    "f4_episodes": f'with {EPISODES} select tag, episode, "start", until, n, {r("peak")} from episodes',
    "f5_unit_sessions": f'with {SESSIONS} select user_id, session::bigint as session, min(ts) as "start", max(ts) as until, count(*) as n from numbered group by 1, 2',
    "f6_pareto": f"""with {EPISODES}, n as (select tag, count(*) as episodes from episodes group by 1)
        select tag, episodes, rank() over (order by episodes desc) as place, {r('sum(episodes) over (order by episodes desc, tag rows unbounded preceding) / (sum(episodes) over ())::double', 'share')} from n""",
    "f7_root_causes": f"with {PAIRS} select t.tag, count(target_id) as pairs, count(distinct target_id) as targets from (select unnest(['click', 'purchase', 'signup', 'view']) as tag) t left join pairs p on p.tag = t.tag group by 1",
    "g1_project_filter": f"select o_orderkey, o_custkey, {r('o_totalprice', 'price')} from orders where o_orderstatus = 'F' and o_totalprice > 1000",
    "g2_joins": "select n_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey and o_totalprice > 100000 join nation on n_nationkey = c_nationkey group by 1",
    "g3_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "g3_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "g4_cross": "select r_name, o_orderstatus from region, (select distinct o_orderstatus from orders)",
    "g5_grouping_sets": """select l_returnflag, l_linestatus, year(l_shipdate) as y, count(*) as n, grouping(l_returnflag, l_linestatus, year(l_shipdate))::bigint as g
        from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag, year(l_shipdate)), ())""",
    "g6_cube": f"select l_returnflag, l_linestatus, count(*) as n, {r('sum(l_quantity)', 'quantity', 2)} from lineitem group by cube (l_returnflag, l_linestatus)",
    "g6_rollup": "select l_returnflag, l_linestatus, count(*) as n, grouping(l_linestatus)::bigint as total from lineitem group by rollup (l_returnflag, l_linestatus)",
    "g7_distinct": "select event_type, count(distinct user_id) as users from events group by 1",
    "g7_approx_distinct": "select event_type, count(distinct user_id) as users, true as near from events group by 1",
    "g8_ranking": f"""select event_id, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(10) over w as tile, {r('percent_rank() over w', 'pr')}, {r('cume_dist() over w', 'cd')}
        from events window w as (partition by event_type order by value, event_id)""",
    "g9_top_k": "select event_type, rn, event_id from (select *, row_number() over (partition by event_type order by value desc, event_id) as rn from events) where rn <= 3",
    "g10_sort_limit": f"select o_orderkey, {r('o_totalprice', 'price')} from orders order by o_totalprice desc, o_orderkey limit 10",
    "g11_union": "select user_id from events where event_type = 'click' union select user_id from events where event_type = 'error'",
    "g11_union_all": "select c_nationkey::bigint as k from customer union all select s_nationkey::bigint as k from supplier",
    "g11_intersect": "select c_nationkey::bigint as k from customer intersect select s_nationkey::bigint as k from supplier",
    "g11_except": "select date_trunc('hour', ts)::timestamp as hr from events where event_type = 'view' except select date_trunc('hour', ts)::timestamp from events where event_type = 'error'",
    "g11_except_all": "select date_trunc('hour', ts)::timestamp as hr from events where event_type = 'view' except all select date_trunc('hour', ts)::timestamp from events where event_type = 'error'",
    "g12_math": f"select event_id, {r('exp(-value / 100)', 'e')}, {r('sqrt(value)', 'q')}, {r('greatest(value, 50.0::double)', 'g')}, {r('ln(1 + value)', 'l')} from events",
    "g13_strings_dates": "select year(o_orderdate) as y, month(o_orderdate) as m, upper(substr(o_orderpriority, 1, 3)) as p, count(*) as n, sum(length(o_orderpriority))::bigint as letters from orders group by 1, 2, 3",
    "g14_star": f"""select r_name, {r('sum(l_extendedprice * (1 - l_discount))', 'revenue', 1)}, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""",
    "h1_severity": f"with {RAW} select hr, {r('raw')} from raw",
    "h2_likelihood": f"with {RAW} select hr, {r('raw')}, {r('100 / (1 + exp(-(raw - 1)))', 'risk')} from raw",
    "h3_bands": f"with {RAW}, k as (select 100 / (1 + exp(-(raw - 1))) as risk from raw) select case when risk >= 75 then 'HIGH' when risk >= 50 then 'MEDIUM' else 'LOW' end as band, count(*) as n from k group by 1",
    "h4_back_test": f"with {BACK} select (select count(*) from alerts) as alerts, (select count(*) from evs) as events, (select count(distinct a) from near) as true_alerts, (select count(*) from evs) - (select count(distinct e) from near) as misses",
    "h5_lead_time": f"with {BACK}, f as (select e, min(a) as a from near group by 1) select count(*) as warned, median(date_diff('hour', a, e)::double) as lead_hours from f",
    "h6_precision_recall": f"""with {BACK} select round((select count(distinct a) from near)::double / nullif((select count(*) from alerts), 0), 9) + 0.0 as precision,
        round((select count(distinct e) from near)::double / nullif((select count(*) from evs), 0), 9) + 0.0 as recall""",
    "i1_labels": "select e.event_id, case when exists (select 1 from events x where x.user_id = e.user_id and x.event_type = 'error' and x.ts > e.ts and x.ts <= e.ts + interval 6 hour) then 1 else 0 end::bigint as label from events e",
    "i2_logistic_hours": HOURS,
    "i3_trees_hours": HOURS,
    "i2_logistic": f"with {MODEL} select hr, y as label, {r(f'1 / (1 + exp(-{ODDS}))', 'p')} from feats, b{STEPS} where not fit",
    "i4_ablation": f"with {MODEL}, {MEANS}, loss as (select {LOSS.format(o=ODDS)} as l from feats, b{STEPS} where fit) " + " union all ".join(f"select 'z_{t}' as name, any_value(round(b_{j}, 9) + 0.0) as coefficient, round({LOSS.format(o=f'{ODDS} - b_{j} * (x{j} - m{j})')} - any_value(l), 9) + 0.0 as increase from feats, b{STEPS}, means, loss where fit" for j, t in enumerate(TAGS, 1)),
    "i5_linear_parts": f"with {MODEL}, {MEANS} " + " union all ".join(f"select hr, 'z_{t}' as name, {r(f'b_{j} * (x{j} - m{j})', 'part')}, {r(ODDS, 'log_odds')} from feats, b{STEPS}, means where not fit" for j, t in enumerate(TAGS, 1)),
    "i5_tree_parts_add_up": f"with {Z} select hr, 5::bigint as parts, true as adds_up from z where hr >= timestamp '2024-01-11' group by hr",
    "e6_fuel_effect": f"with {EFFECT} select tag, n, {r('b.d_1', 'share', 6)}, {r('sqrt(i.d_1 * (yy - (b.d_0 * g_0 + b.d_1 * g_1 + b.d_2 * g_2 + b.d_3 * g_3)) / (n - 4))', 'se_share', 6)}, {r('b.d_2', 'hour_of_day', 6)}, {r('b.d_3', 'load', 6)} from gram join beta b using (tag) join inv i using (tag)",
    "h4_rolling_origin": f"with {FOLDS} select origin, alerts, events, true_alerts, events - warned as misses, {r('true_alerts::double / nullif(alerts, 0)', 'precision')}, {r('warned::double / nullif(events, 0)', 'recall')}, lead_hours from c left join led using (origin)",
    "i4_importance_whole": "select 5::bigint as features, 1.0::double as whole, true as shares",
    "i5_contributions": f"with {Z}, {PART}, n as (select *, row_number() over (partition by hr order by part desc, tag) as place from part) select tag, hr, {r('part')}, place from n where place <= 2",
    "j1_stream_tumbling": f"""select * from (select date_trunc('hour', ts)::timestamp as "start", count(*) as n, {r('avg(value)', 'v')} from events group by 1)
        where "start" + interval 1 hour <= (select max(ts) from events) - interval 1 hour""",
    "j2_stream_sessions": f"""with {SESSIONS} select user_id, min(ts) as "start", count(*) as n from numbered group by user_id, session
        having max(ts) + interval 30 minute <= (select max(ts) from events) - interval 1 hour""",
    "j3_stream_dedup": "select event_id, event_type from events",
    "j4_stream_join": f"with {PAIRS} select target_id, precursor_id from pairs where tag = 'click'",
    "j5_stream_ewma": f"select user_id, {r(EWMA, 'ewma')} from events group by 1",
    "j6_late_data": f"""select * from (select date_trunc('hour', ts)::timestamp as "start", count(*) as n, {r('avg(value)', 'v')} from events group by 1)
        where "start" + interval 1 hour <= (select max(ts) from events) - interval 1 hour""",
    "j7_stream_sink": "select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1",
}
