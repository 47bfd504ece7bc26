"""SQL that DuckDB runs on the same tables: common tables, put together as each query needs them."""

from __future__ import annotations

import re

from .fixtures import BASE, COST_PX, INCEPTION, LOTS

PAST = "rows between unbounded preceding and current row"
FUTURE = "rows between current row and unbounded following"
WEEK = "(date + cast((12 - isodow(date)) % 7 as int))::date"
PERIOD = {"week": WEEK, "month": "last_day(date)", "quarter": "last_day((date_trunc('quarter', date) + interval 2 month)::date)", "year": "make_date(year(date), 12, 31)"}
BEFORE = {"week": "(period - 7)::date", "month": "last_day((period - interval 1 month)::date)", "quarter": "last_day((date_trunc('month', period) - interval 3 month)::date)", "year": "make_date(year(period) - 1, 12, 31)"}

#: Common tables by name; those that one mentions come before it.
TABLES = {
    "px": """select concat('S', cast(l_suppkey // 2 as varchar)) as symbol, cast(l_shipdate as date) as date,
        50 + (sum(cast(round(l_extendedprice*100) as bigint))*1.0e0 / count(*)) / 100000.0e0 as close from lineitem group by 1, 2""",
    "quotes": f"""select case o_orderstatus when 'F' then 'USD' when 'O' then 'EUR' else 'GBP' end as ccy, '{BASE}' as base, cast(o_orderdate as date) as date,
        0.8e0 + (sum(cast(round(o_totalprice*100) as bigint))*1.0e0 / count(*)) / 250000000.0e0 as rate from orders group by 1, 2, 3""",
    "dividends": f"""select concat('S', cast(l_suppkey // 2 as varchar)) as symbol, cast(l_shipdate as date) as date,
        sum(cast(round(l_tax*100) as bigint))*1.0e0 / 100.0e0 as amount from lineitem
        where {LOTS} group by 1, 2""",
    "lots": f"""select o_custkey // 100 as desk, l_suppkey // 2 as number, sum(l_quantity::bigint)::bigint as shares, case (l_suppkey // 2) % 3 when 0 then 'CHF' when 1 then 'USD' else 'EUR' end as own
        from lineitem join orders on l_orderkey = o_orderkey where {LOTS} group by 1, 2, 4""",
    "hold": f"""select 'P' || desk as portfolio, 'S' || number as symbol, own as ccy, shares, {COST_PX}e0 as cost_px, own as cost_ccy, shares * {COST_PX}e0 as cost_amount,
        case when number % 7 = 2 then 'USD' else own end as quote_ccy from lots""",
    "ports": f"select distinct 'P' || desk as portfolio, 'Desk ' || desk as label, '{BASE}' as base_ccy, (date '{INCEPTION}' + (desk % 90)::int)::date as inception from lots",
    "legs": """select 'B' || region as benchmark, 'S' || number as symbol, case when k = 1 then 0.6e0 else 0.4e0 end as weight,
        case when region = 3 then 'GBp' when region = 1 then 'USD' else case number % 3 when 0 then 'CHF' when 1 then 'USD' else 'EUR' end end as ccy
        from (select *, row_number() over (partition by region order by number) as k from (select distinct n_regionkey as region, s_suppkey // 2 as number from supplier join nation on s_nationkey = n_nationkey)) where k <= 2""",
    "members": "select distinct 'P' || desk as portfolio, 'B' || (desk % 5) as benchmark from lots union select distinct 'P' || desk, 'B' || ((desk + 2) % 5) from lots",
    "cal": "select distinct portfolio, date from hold join px using (symbol) join ports using (portfolio) where date >= inception - 12",
    "aligned": """select c.portfolio, h.symbol, c.date, px.close, coalesce(d.amount, 0.0e0) as amount from cal c join hold h using (portfolio)
        left join px on px.symbol = h.symbol and px.date = c.date left join dividends d on d.symbol = h.symbol and d.date = c.date""",
    "filled": f"""select portfolio, symbol, date, last_value(close ignore nulls) over (partition by portfolio, symbol order by date {PAST}) as close, amount from aligned""",
    "live": "select filled.* from filled join ports using (portfolio) where date >= inception",
    "rates": f"""select ccy, date, rate from (select c.ccy, d.date, last_value(q.rate ignore nulls) over (partition by c.ccy order by d.date {PAST}) as rate
        from (select distinct ccy from quotes) c cross join (select distinct date from quotes) d left join quotes q on q.ccy = c.ccy and q.date = d.date) where rate is not null""",
    "fx": f"""select portfolio, ccy, date, case when ccy = '{BASE}' then 1.0e0 else coalesce(
          last_value(rate ignore nulls) over (partition by portfolio, ccy order by date {PAST}), first_value(rate ignore nulls) over (partition by portfolio, ccy order by date {FUTURE})) end as rate
        from (select l.portfolio, h.ccy, l.date, r.rate from (select distinct portfolio, date from live) l
          join (select portfolio, ccy from hold union select portfolio, quote_ccy from hold) h using (portfolio) left join rates r on r.ccy = h.ccy and r.date = l.date)""",
    "comp0": "select l.portfolio, l.symbol, l.date, h.ccy, h.shares, l.close, l.amount, f.rate, l.close * f.rate * h.shares as value from live l join hold h using (portfolio, symbol) join fx f on f.portfolio = l.portfolio and f.ccy = h.ccy and f.date = l.date",
    "cash": f"select portfolio, date, coalesce(sum(paid) over (partition by portfolio order by date {PAST}), 0.0e0) as cash from (select portfolio, date, sum(amount * rate * shares) as paid from comp0 group by 1, 2)",
    "comp": "select * from comp0",
    "days": "select portfolio, min(date) as first_day, max(date) as last_day from live group by 1",
    "cap": "select h.portfolio, d.first_day, sum(h.cost_amount * f.rate) as capital from hold h join days d using (portfolio) join fx f on f.portfolio = h.portfolio and f.ccy = h.cost_ccy and f.date = d.first_day group by 1, 2",
    "nav": """select portfolio, date, held + cash as nav, cash from (select portfolio, date, sum(coalesce(value, 0.0e0)) as held from comp0 group by 1, 2) join cash using (portfolio, date)
        union all select portfolio, first_day - 1, capital, 0.0e0 from cap""",
    "ns": "select portfolio as series_id, date, nav as value from nav",
    "s": f"select series_id, date, value from ns union all select symbol, date, close from px where date >= date '{INCEPTION}'",
    "r": "select series_id, date, r from (select series_id, date, value / lag(value) over (partition by series_id order by date) - 1 as r from s) where r is not null",
    "rn": "select *, row_number() over (partition by series_id order by date) - 1 as k, count(*) over (partition by series_id) as n from r",
    "g": """select series_id, v1 / v0 - 1 as total, pow(v1 / v0, 1 / greatest(days / 365.25e0, 1e-9)) - 1 as cagr, greatest(days / 365.25e0, 1e-9) as years, v0, v1, d0, d1
        from (select series_id, arg_min(value, date) as v0, arg_max(value, date) as v1, min(date) as d0, max(date) as d1, max(date) - min(date) as days from s group by 1)""",
    "dd": f"select series_id, date, value, value / max(value) over (partition by series_id order by date {PAST}) - 1 as dd from s",
    "mdd": "select series_id, min(dd) as max_dd, arg_min(date, (dd, date)) as max_dd_date, sqrt(avg(dd * dd)) as ulcer, -avg(dd) as pain from dd group by 1",
    "dd1": f"""select *, case when dd < 0 and coalesce(lag(dd) over w, 0) >= 0 then 1 else 0 end as starts, lead(date) over w as next, max(date) over (partition by series_id) as final,
        max(value) over (partition by series_id order by date rows between unbounded preceding and 1 preceding) as before from dd window w as (partition by series_id order by date)""",
    "dd2": f"""select *, sum(starts) over (partition by series_id order by date {PAST}) as episode,
        last_value(case when before is null or value > before then date end ignore nulls) over (partition by series_id order by date {PAST}) as top from dd1""",
    "epi": """select *, row_number() over (partition by series_id order by depth, start) as rank from (
        select series_id, episode, min(top) as peak, arg_min(date, (dd, date)) as trough, arg_max(coalesce(next, date '9999-01-01'), date) as nx, min(dd) as depth, min(date) as start, max(final) as final
        from dd2 where dd < 0 group by 1, 2)""",
    "episodes": """select series_id, rank, peak, trough, case when nx = date '9999-01-01' then null else nx end as recovery, depth, trough - peak as days_down,
        case when nx = date '9999-01-01' then null else nx - trough end as days_to_recover, (case when nx = date '9999-01-01' then final else nx end) - peak as days_total, nx = date '9999-01-01' as ongoing from epi""",
    "bcal": "select distinct date from px where symbol in (select symbol from legs)",
    "bleg0": f"""select l.symbol, l.ccy, c.date, last_value(px.close ignore nulls) over (partition by l.symbol, l.ccy order by c.date {PAST}) as close
        from (select distinct symbol, ccy from legs) l cross join bcal c left join px on px.symbol = l.symbol and px.date = c.date""",
    "bleg1": "select symbol, case when ccy in ('GBp', 'GBX') then 'GBP' else ccy end as ccy, ccy as quoted, date, case when ccy in ('GBp', 'GBX') then close / 100 else close end as close from bleg0",
    "bfx": f"""select ccy, date, case when ccy = '{BASE}' then 1.0e0 else coalesce(last_value(rate ignore nulls) over (partition by ccy order by date {PAST}), first_value(rate ignore nulls) over (partition by ccy order by date {FUTURE})) end as rate
        from (select distinct b.ccy, b.date, r.rate from bleg1 b left join rates r on r.ccy = b.ccy and r.date = b.date)""",
    "bleg2": "select b.symbol, b.quoted, b.date, b.close * f.rate as leg from bleg1 b join bfx f using (ccy, date)",
    "bleg3": f"""select n.portfolio, l.benchmark, l.symbol, l.weight, n.date, coalesce(last_value(b.leg ignore nulls) over (partition by n.portfolio, l.benchmark, l.symbol order by n.date {PAST}),
          first_value(b.leg ignore nulls) over (partition by n.portfolio, l.benchmark, l.symbol order by n.date {FUTURE})) as v
        from nav n join members m on m.portfolio = n.portfolio join legs l on l.benchmark = m.benchmark left join bleg2 b on b.symbol = l.symbol and b.quoted = l.ccy and b.date = n.date""",
    "bmix": f"select portfolio, benchmark, date, sum(part) as mix from (select *, weight * v / first_value(v) over (partition by portfolio, benchmark, symbol order by date {PAST}) as part from bleg3) group by 1, 2, 3",
    "bench0": f"select portfolio, benchmark, date, mix / first_value(mix) over (partition by portfolio, benchmark order by date {PAST}) * 100 as value from bmix",
    "bench": "select * from bench0",
    "br": "select portfolio, benchmark, date, r as b from (select portfolio, benchmark, date, value / lag(value) over (partition by portfolio, benchmark order by date) - 1 as r from bench) where r is not null",
    "pairs": "select br.portfolio, br.benchmark, br.date, r.r as p, br.b from br join r on r.series_id = br.portfolio and r.date = br.date",
    "cr0": "select portfolio, symbol, date, value, value / lag(value) over (partition by portfolio, symbol order by date) - 1 as r from comp",
    "cr": """select portfolio, symbol, date, r, count(*) over (partition by portfolio, symbol) as rows from (select *, count(r) over (partition by portfolio, date) as have from cr0)
        join (select portfolio, count(distinct symbol) as size from comp group by 1) using (portfolio) where have = size""",
    "cov": "select a.portfolio, a.symbol as i, b.symbol as j, covar_samp(a.r, b.r) * 252 as cov from cr a join cr b using (portfolio, date) where a.rows >= 60 group by 1, 2, 3",
    "win0": "select series_id, date, row_number() over (partition by series_id order by date) - 1 as k from ns",
    "win1": """select series_id, min(date) as d0, max(date) as d1, max(k) as last from win0 group by 1""",
    "win2": """select w.*, p.win, case when p.m is null then d0 when p.m = 0 then date_trunc('year', d1)::date else (d1 - to_months(p.m))::date end as a
        from win1 w, (values ('max', null), ('3y', 36), ('2y', 24), ('1y', 12), ('ytd', 0), ('6m', 6), ('3m', 3)) p(win, m)""",
    "win3": "select w.series_id, w.win, w.last, coalesce(min(case when n.date >= a then k end), 0) as i, w.last as j from win2 w join win0 n using (series_id) group by 1, 2, 3",
    "win4": "select *, case when j - i < 25 then greatest(0, j - 25) else i end as i2 from win3",
    "windows": "select w.series_id, w.win as \"window\", a.date as lo, b.date as hi from win4 w join win0 a on a.series_id = w.series_id and a.k = w.i2 join win0 b on b.series_id = w.series_id and b.k = w.j",
}
#: In the place of lots: what the customers of each region bought.
WIDE = """select n_regionkey::bigint as desk, l_suppkey // 2 as number, sum(l_quantity::bigint)::bigint as shares, case (l_suppkey // 2) % 3 when 0 then 'CHF' when 1 then 'USD' else 'EUR' end as own
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 4"""
for _freq in ("week", "month", "quarter", "year"):
    TABLES |= {
        f"last_{_freq}": f"select series_id, {PERIOD[_freq]} as period, arg_max(value, date) as value from s where value is not null group by 1, 2",
        f"step_{_freq}": f"select *, lag(value) over w as before, lag(period) over w as prev from last_{_freq} window w as (partition by series_id order by period)",
        f"r_{_freq}": f"select series_id, period, value / before - 1 as r from step_{_freq} where prev = {BEFORE[_freq]}",
    }


def _needs(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:from|join)\s*\(?\s*{t}\b", sql)]


def with_tables(sql: str, **own: str) -> str:
    """sql behind the common tables that it and its own tables need."""
    made: dict[str, str] = {}

    def add(text: str) -> None:
        for name in _needs(text):
            if name not in made:
                add(TABLES[name])
                made[name] = TABLES[name]

    for name, text in own.items():
        add(text)
        made[name] = text
    add(sql)
    return sql if not made else "with " + ",\n".join(f"{name} as materialized ({text})" for name, text in made.items()) + "\n" + sql
