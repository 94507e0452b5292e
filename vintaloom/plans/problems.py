"""Queries of the general training-data problems over the engine's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import asof, drift, fill, snapshots, spikes
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fill.filled_cells(table(spark, d, "macro_vintage"), table(spark, d, "feature_result"))


def p1_fill_macro(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_macro(table(spark, d, "macro_vintage")).drop("assumed_available_at")


def p1_fill_features(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_features(table(spark, d, "feature_result"))


def p1_marks(spark: SparkSession, d: str) -> DataFrame:
    """Every macro cell with its marks, and whether it holds a figure after the filling."""
    m = fill.fill_macro(table(spark, d, "macro_vintage"))
    return m.select("vintage_month", "base_month", "series", "value_filled_as", "reason_filled_as", F.coalesce(F.col("filled_by") != "none", F.lit(True)).alias("has_value"), F.col("filled_reason").isNotNull().alias("has_reason"))


def p1_masks(spark: SparkSession, d: str) -> DataFrame:
    """Every feature cell with its masks after the filling, and whether it holds a figure."""
    f = fill.fill_features(table(spark, d, "feature_result"))
    return f.select("window_id", "base_month", "series", "filled_observed", "filled_ffill", "filled_median", F.coalesce("filled_value", "imputed").isNotNull().alias("has_value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "prices")).select("session", "ticker")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "prices")).select("session", "ticker", F.explode("reasons").alias("reason"))


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "macro_vintage").withColumn("ok", fill.usable(F.col("value"), F.col("value_reason")))
    return snapshots.snapshot_changes(m, snapshot="vintage_month", keys=["base_month", "series"], value="value", state="ok")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_changes(spark, d).select("vintage_month", "base_month", "series", "change_kind")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "macro_raw_lines"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.ingest(table(spark, d, "macro_raw_lines"))


def p6_balance(spark: SparkSession, d: str) -> DataFrame:
    return drift.cell_balance(table(spark, d, "macro_raw_lines"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return asof.account_knowledge(t("monthly_account"), t("lambda_selection"), t("macro_vintage")).select("run_id", "holding_month", "strategy_id", "vintage_month", "selection_id")


def p7_fine_shards(spark: SparkSession, d: str) -> DataFrame:
    """p7_found with weekly shards, each dealt out from 50 events on: the cuts change nothing."""
    t = lambda n: table(spark, d, n)
    return asof.account_knowledge(t("monthly_account"), t("lambda_selection"), t("macro_vintage"), shard_days=7, hot_rows=50).select("run_id", "holding_month", "strategy_id", "vintage_month", "selection_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_fill_macro, p1_fill_features, p1_marks, p1_masks, p3_found, p3_reasons, p4_found, p4_changes, p6_found, p6_table, p6_balance, p7_found, p7_fine_shards)}

_PLACEHOLDERS = ", ".join(f"{x:.1f}" for x in fill.PLACEHOLDERS)
_NOTHING = ", ".join(f"'{x}'" for x in fill.NO_ANSWER)
_USABLE = f"""(value is not null and not isnan(value) and value not in ({_PLACEHOLDERS}) and abs(value) < 1e19
  and not regexp_matches(lower(trim(coalesce(value_reason, ''))), '{fill.NOT_OBSERVED}'))"""
_MI = lambda c: f"(substr({c}, 1, 4)::int * 12 + substr({c}, 6, 2)::int - 1)"

_P4 = f"""
with m as (select distinct vintage_month, base_month, series, value, {_USABLE} as ok from macro_vintage),
v as (select vintage_month, lag(vintage_month) over (order by vintage_month) as prev from (select distinct vintage_month from m)),
n as (select v.prev, m.* from m join v using (vintage_month) where v.prev is not null),
o as (select v.vintage_month as at, m.base_month, m.series, m.value, m.ok from m join v on m.vintage_month = v.prev),
j as (select coalesce(n.vintage_month, o.at) as vintage_month, coalesce(n.base_month, o.base_month) as base_month, coalesce(n.series, o.series) as series,
  case when o.at is null then 'added' when n.vintage_month is null then 'removed'
       when n.ok <> o.ok then 'changed'
       when n.ok and abs(n.value - o.value) > 1e-9 * greatest(abs(n.value), abs(o.value)) then 'changed' end as change_kind,
  case when o.ok then o.value end as old_value, case when n.ok then n.value end as new_value
  from n full outer join o on n.vintage_month = o.at and n.base_month = o.base_month and n.series = o.series)
"""

_P3 = """
with l as (select session, ticker, unnest(arg_max(struct_pack(open := open, high := high, low := low, close := close, adj_close := adj_close, volume := volume), retrieved_at)) from prices group by session, ticker),
a as (select *, case when adj_close > 0 and not isinf(adj_close) then ln(adj_close) end as x from l),
b as (select *, lag(x, 1 ignore nulls) over w p1, lag(x, 2 ignore nulls) over w p2, lead(x, 1 ignore nulls) over w n1, lead(x, 2 ignore nulls) over w n2,
  case when adj_close = lag(adj_close) over w then 0 else 1 end as new_a, case when volume = lag(volume) over w and volume > 0 then 0 else 1 end as new_v
  from a window w as (partition by ticker order by session)),
c as (select *, sum(new_a) over w ra, sum(new_v) over w rv from b window w as (partition by ticker order by session)),
e as (select *, count(*) over (partition by ticker, ra) la, count(*) over (partition by ticker, rv) lv from c),
e2 as (select *, coalesce(dayofweek(try_cast(session as date)) + 1, 0) as wd, case when volume > 0 and not isinf(volume) then volume end as vol from e),
s as (select ticker, quantile_cont(x - p1, 0.25) q1, quantile_cont(x - p1, 0.75) q3, median(vol) usual from e2 group by ticker),
sw as (select ticker, wd, count(x - p1) nc, count(vol) nv, quantile_cont(x - p1, 0.25) q1, quantile_cont(x - p1, 0.75) q3, median(vol) usual from e2 group by all),
-- a weekday's figures weigh by its readings against 512 of the ticker's
m as (select sw.ticker, wd, (coalesce(sw.q1, 0) * nc + s.q1 * 512) / (nc + 512) q1, (coalesce(sw.q3, 0) * nc + s.q3 * 512) / (nc + 512) q3, (coalesce(sw.usual, 0) * nv + s.usual * 512) / (nv + 512) usual from sw join s using (ticker)),
k as (select e2.*, usual, q3 + 5.25 * (q3 - q1) hi, q1 - 5.25 * (q3 - q1) lo from e2 join m using (ticker, wd)),
g as (select *,
  (x - p1 > hi or x - p1 < lo) xp1, (x - p2 > hi or x - p2 < lo) xp2, (x - n1 > hi or x - n1 < lo) xn1, (x - n2 > hi or x - n2 < lo) xn2,
  (n1 - p1 > hi or n1 - p1 < lo) np, (p1 - p2 > hi or p1 - p2 < lo) pp,
  not (n1 - p1 > hi or n1 - p1 < lo) and abs(n1 - p1) < 0.5 * greatest(abs(x - n1), abs(x - p1)) back1,
  not (n2 - p1 > hi or n2 - p1 < lo) and abs(n2 - p1) < 0.5 * greatest(abs(x - n2), abs(x - p1)) back2,
  not (n1 - p2 > hi or n1 - p2 < lo) and abs(n1 - p2) < 0.5 * greatest(abs(x - n1), abs(x - p2)) back3 from k)
select session, ticker, adj_close <= 0 or high <= 0 or low <= 0 or volume < 0 or volume = 'inf'::double or high < greatest(open, low, close) or low > least(open, high, close) as impossible,
  (xp1 and xn1 and back1) or (xp1 and xn2 and np and back2) or (xp2 and xn1 and pp and back3) as spike,
  (high > 0 and close > 0 and abs(ln(case when high > 0 and close > 0 then high / close end)) > hi) or (low > 0 and close > 0 and abs(ln(case when low > 0 and close > 0 then low / close end)) > hi) as wide,
  volume > 20 * usual as volume, (new_a = 0 and la >= 6) or (new_v = 0 and lv >= 6) as stuck from g where
  adj_close <= 0 or high <= 0 or low <= 0 or volume < 0 or volume = 'inf'::double or high < greatest(open, low, close) or low > least(open, high, close)
  or (xp1 and xn1 and back1) or (xp1 and xn2 and np and back2) or (xp2 and xn1 and pp and back3)
  or (high > 0 and close > 0 and abs(ln(case when high > 0 and close > 0 then high / close end)) > hi)
  or (low > 0 and close > 0 and abs(ln(case when low > 0 and close > 0 then low / close end)) > hi)
  or volume > 20 * usual or (new_a = 0 and la >= 6) or (new_v = 0 and lv >= 6)
"""

_P1 = f"""m as (select distinct *, {_USABLE} as ok, lower(trim(coalesce(value_reason, ''))) in ({_NOTHING}) as silent, {_MI('base_month')} as mi from macro_vintage),
g as (select *, coalesce(max(case when ok then 1 end) over (partition by vintage_month, series order by mi range between 2 preceding and 1 preceding), 0) as near from m),
f as (select distinct *, imputed is null or isnan(imputed) as gap, {_MI('base_month')} as mi from feature_result),
h as (select *, coalesce(max(case when observed_mask then 1 end) over (partition by window_id, series order by mi range between 2 preceding and 1 preceding), 0) as near from f)"""

SQL: dict[str, str] = {
    "p1_found": f"""
with {_P1}
select 'macro_vintage' as place, vintage_month as scope_key, base_month, series, 'value' as field, case when near = 1 then 'ffill' else 'median' end as filled_as from g where not ok
union all select 'macro_vintage', vintage_month, base_month, series, 'value_reason', 'reason' from g where not ok and silent
union all select 'feature_result', window_id, base_month, series, 'imputed', case when near = 1 then 'ffill' else 'median' end from h where gap""",
    "p1_marks": f"""
with {_P1}
select vintage_month, base_month, series, case when not ok then case when near = 1 then 'ffill' else 'median' end end as value_filled_as, case when not ok and silent then 'reason' end as reason_filled_as,
  coalesce(ok or series in (select series from g where ok) or vintage_month in (select vintage_month from g where ok), false) as has_value, not ok and silent as has_reason from g""",
    "p1_masks": f"""
with {_P1}
select window_id, base_month, series, case when gap then false else observed_mask end as filled_observed, case when gap then near = 1 else ffill_mask end as filled_ffill, case when gap then near = 0 else median_mask end as filled_median,
  not gap or series in (select series from h where observed_mask and not gap) or window_id in (select window_id from h where observed_mask and not gap) as has_value from h""",
    "p3_found": f"select session, ticker from ({_P3})",
    "p3_reasons": f"select session, ticker, unnest(list_filter([case when impossible then 'impossible' end, case when spike then 'spike' end, case when wide then 'range' end, case when volume then 'volume' end, case when stuck then 'stuck' end], lambda x: x is not null)) as reason from ({_P3})",
    "p4_found": _P4 + "select vintage_month, base_month, series, change_kind from j where change_kind is not null",
    "p4_changes": _P4 + "select * from j where change_kind is not null",
    "p6_balance": f"""
with l as (select feed_id, vintage_month, line_no, arg_max(line, (received_at, line)) as line from macro_raw_lines where line is not null and feed_id is not null and vintage_month is not null group by all),
b as (select * from l where not regexp_full_match(line, '[\\s,;|"'']*')), h as (select feed_id, vintage_month, min(line_no) as head, arg_min(line, line_no) as hl from b group by all),
s as (select b.*, hl, list_reverse_sort([{{'n': length(hl) - length(replace(hl, ',', '')), 'i': 0, 's': ','}}, {{'n': length(hl) - length(replace(hl, ';', '')), 'i': -1, 's': ';'}},
  {{'n': length(hl) - length(replace(hl, chr(9), '')), 'i': -2, 's': chr(9)}}, {{'n': length(hl) - length(replace(hl, '|', '')), 'i': -3, 's': '|'}}])[1].s as sep from b join h using (feed_id, vintage_month) where line_no > head),
-- a separator inside quotes gives way to a sign that no line holds
q as (select *, list_aggregate(list_transform(string_split(line, '"'), lambda x, i: case when i % 2 = 0 then replace(x, sep, chr(1)) else x end), 'string_agg', '') as bare from s),
c as (select feed_id, vintage_month, line_no, trim(replace(unnest(string_split(bare, sep)), chr(1), sep)) as cell, unnest(generate_series(1, len(string_split(bare, sep)))) as i from q),
k as (select feed_id, vintage_month, line_no, lower(any_value(cell) filter (i = 1)) as key from c group by all),
d as (select c.* from c join k using (feed_id, vintage_month, line_no) where not starts_with(key, 'transform') and not starts_with(key, 'group') and i > 1 and lower(cell) not in ({', '.join(f"'{x}'" for x in drift.EMPTY_CELLS)}))
select feed_id, vintage_month, count(*) as figures, count(*) filter (regexp_matches(cell, '{drift.PLAIN}')) as typed, count(*) filter (not regexp_matches(cell, '{drift.PLAIN}')) as rescued,
  round(sum(case when regexp_matches(cell, '{drift.PLAIN}') then cell::double end), 3) as plain_sum from d group by all""",
    "p7_found": """
with a as (select distinct run_id, holding_month, strategy_id, signal_series, decision_at from monthly_account),
r as (select series, vintage_month, min(assumed_available_at) as at from macro_vintage group by all),
s as (select distinct run_id, selection_id, selection_end_at as at from lambda_selection where selection_end_at is not null),
v as (select a.run_id, a.holding_month, a.strategy_id, max(r.vintage_month) as vm from a join r on r.series = a.signal_series and r.at < a.decision_at group by all),
l as (select a.run_id, a.holding_month, a.strategy_id, max(struct_pack(at := s.at, id := s.selection_id)).id as sid from a join s on s.run_id = a.run_id and s.at < a.decision_at group by all)
select a.run_id, a.holding_month, a.strategy_id, coalesce(vm, '') as vintage_month, coalesce(sid, -1)::bigint as selection_id
from a left join v using (run_id, holding_month, strategy_id) left join l using (run_id, holding_month, strategy_id)""",
}
SQL["p7_fine_shards"] = SQL["p7_found"]

_RAW = """l as (select feed_id, vintage_month, line_no, arg_max(line, (received_at, line)) as line from macro_raw_lines where line is not null and feed_id is not null and vintage_month is not null group by all),
b as (select * from l where not regexp_full_match(line, '[\\s,;|"'']*')), h as (select feed_id, vintage_month, min(line_no) as head, arg_min(line, line_no) as hl from b group by all),
cn as (select *, length(hl) - length(replace(hl, ',', '')) as c1, length(hl) - length(replace(hl, ';', '')) as c2, length(hl) - length(replace(hl, chr(9), '')) as c3, length(hl) - length(replace(hl, '|', '')) as c4 from h),
sp as (select *, case greatest(c1, c2, c3, c4) when c1 then ',' when c2 then ';' when c3 then chr(9) else '|' end as sep from cn),
q as (select b.*, head, sep, list_aggregate(list_transform(string_split(line, '"'), lambda x, i: case when i % 2 = 0 then replace(x, sep, chr(1)) else x end), 'string_agg', '') as bare from b join sp using (feed_id, vintage_month)),
c as (select feed_id, vintage_month, line_no, line_no = head as is_head, trim(replace(unnest(string_split(bare, sep)), chr(1), sep)) as cell, unnest(generate_series(1, len(string_split(bare, sep)))) as i from q)"""
_HOW = rf"""case when lower(cell) in ({', '.join(f"'{x}'" for x in drift.EMPTY_CELLS)}) then null when regexp_matches(cell, '{drift.PLAIN}') then 'plain' when regexp_matches(cell, '^[+-]?\d{{1,3}}(,\d{{3}})+(\.\d+)?$') then 'thousands'
  when regexp_matches(cell, '^[+-]?\d{{1,3}}(\.\d{{3}})*,\d+$') then 'comma' else '#' || lower(regexp_replace(regexp_replace(cell, '\d+([.,]\d+)*([eE][+-]?\d+)?', '9', 'g'), '\s+', '', 'g')) end"""
_FIGURE = r"regexp_extract(regexp_replace(cell, '\s+', '', 'g'), '([+-]?[\d.,]*\d([eE][+-]?\d+)?)', 1)"
SQL["p6_found"] = rf"""
with {_RAW},
nm as (select feed_id, vintage_month, i, cell as field from c where is_head and cell <> '' qualify row_number() over (partition by feed_id, vintage_month, cell order by i) = 1),
ky as (select feed_id, vintage_month, line_no, any_value(cell) filter (i = 1) as key from c where not is_head group by all),
n as (select c.feed_id, c.vintage_month, field, i, cell, case when key ilike 'transform%' then 'tcode' when key ilike 'group%' then 'grp' else 'data' end as kind,
  case when regexp_matches(key, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') then split_part(key, '/', 3) || '-' || lpad(split_part(key, '/', 1), 2, '0') when regexp_matches(key, '^\d{{4}}-\d{{1,2}}') then substr(key, 1, 4) || '-' || lpad(regexp_extract(key, '^\d{{4}}-(\d{{1,2}})', 1), 2, '0') end as bm
  from c join nm using (feed_id, vintage_month, i) join ky using (feed_id, vintage_month, line_no) where not is_head),
w as (select *, {_HOW} as fh, case when i = 1 then '@' || case when regexp_matches(cell, '^\d{{4}}') then 'y' else 'm' end || regexp_replace(regexp_replace(cell, '\d+', '9', 'g'), '[^9]', '/', 'g') end as dh from n),
x as (select *, case when kind = 'data' then coalesce(dh, fh) end as how, case when fh is not null and i > 1 then try_cast(case when fh = 'comma' then replace(replace({_FIGURE}, '.', ''), ',', '.') else replace({_FIGURE}, ',', '') end as double) end as num from w),
fc as (select feed_id, vintage_month, field, how, count(*) as k from x where how is not null group by all), fm as (select feed_id, vintage_month, field, arg_max(how, (k, how)) as most, bool_or(how = 'thousands') as th from fc group by all),
fa as (select feed_id, vintage_month, field, min(i) = 1 as is_date, bool_or(kind = 'data' and how = 'plain' and abs(num) >= 1000) as big, max(num) filter (kind = 'tcode') as tcode, max(num) filter (kind = 'grp') as grp from x group by all),
fd as (select fa.*, case when th and most = 'plain' and not coalesce(big, false) then 'thousands' else most end as how from fa left join fm using (feed_id, vintage_month, field)),
st as (select feed_id, vintage_month as prev, lead(vintage_month) over (partition by feed_id order by vintage_month) as nxt from (select distinct feed_id, vintage_month from fd)),
o as (select st.nxt, fd.* from fd join st on st.feed_id = fd.feed_id and st.prev = fd.vintage_month where st.nxt is not null), w2 as (select st.prev, fd.* from fd join st on st.feed_id = fd.feed_id and st.nxt = fd.vintage_month),
gone as (select o.feed_id, o.nxt, o.vintage_month as prev, field, is_date, how, tcode, grp from o where not exists (select 1 from w2 where w2.feed_id = o.feed_id and w2.vintage_month = o.nxt and w2.field = o.field)),
fresh as (select w2.feed_id, vintage_month as nxt, prev, field, is_date, how, tcode, grp from w2 where not exists (select 1 from o where o.feed_id = w2.feed_id and o.nxt = w2.vintage_month and o.field = w2.field)),
fg as (select distinct feed_id, vintage_month, field, bm, round(num, 9) as v from x where kind = 'data' and i > 1 and num is not null and bm is not null),
go as (select g.feed_id, g.nxt, g.field as former, bm, v from gone g join fg on fg.feed_id = g.feed_id and fg.vintage_month = g.prev and fg.field = g.field), fr as (select f.feed_id, f.nxt, f.field, bm, v from fresh f join fg on fg.feed_id = f.feed_id and fg.vintage_month = f.nxt and fg.field = f.field),
sm as (select feed_id, nxt, former, field, count(distinct go.bm) as same from go join fr using (feed_id, nxt, bm, v) group by all having count(distinct go.bm) >= 2),
cm as (select sm.*, (select count(*) from (select bm from go where go.feed_id = sm.feed_id and go.nxt = sm.nxt and go.former = sm.former intersect select bm from fr where fr.feed_id = sm.feed_id and fr.nxt = sm.nxt and fr.field = sm.field)) as common from sm),
bt as (select *, row_number() over (partition by feed_id, nxt, field order by same / common desc, same desc, former, field) as r1, row_number() over (partition by feed_id, nxt, former order by same / common desc, same desc, former, field) as r2 from cm where same >= 0.7 * common),
rn as (select feed_id, nxt, former, field from bt where r1 = 1 and r2 = 1 union all select g.feed_id, g.nxt, g.field, f.field from gone g join fresh f using (feed_id, nxt) where g.is_date and f.is_date),
pr as (select o.feed_id, o.nxt, o.field, '' as former, o.how oh, w2.how nh, o.tcode ot, w2.tcode nt, o.grp og, w2.grp ng from o join w2 on w2.feed_id = o.feed_id and w2.vintage_month = o.nxt and w2.field = o.field
  union all select rn.feed_id, rn.nxt, rn.field, rn.former, g.how, f.how, g.tcode, f.tcode, g.grp, f.grp from rn join gone g on g.feed_id = rn.feed_id and g.nxt = rn.nxt and g.field = rn.former join fresh f on f.feed_id = rn.feed_id and f.nxt = rn.nxt and f.field = rn.field),
al as (select feed_id, nxt, field, 'renamed' as change_kind, former from rn union all select feed_id, nxt, field, 'retyped', '' from pr where oh <> nh union all select feed_id, nxt, field, 'tcode', '' from pr where ot <> nt union all select feed_id, nxt, field, 'group', '' from pr where og <> ng
  union all select feed_id, nxt, field, 'added', '' from fresh f where not exists (select 1 from rn where rn.feed_id = f.feed_id and rn.nxt = f.nxt and rn.field = f.field) union all select feed_id, nxt, field, 'removed', '' from gone g where not exists (select 1 from rn where rn.feed_id = g.feed_id and rn.nxt = g.nxt and rn.former = g.field))
select feed_id, nxt as vintage_month, field, change_kind, former as former_field from al"""
