"""Queries of the relational operators (scans, constraints, calendar, transforms), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.months import add_month, is_month, month_index
from ..operators import constraints as C, timing as T, transforms as X, windows as D
from ..operators.spikes import latest_readings
from ..sources import views as V
from ..sources.datasets import official_closes as closes
from ..sources.files import month_of_name
from ..sources.tables import table

PX = """px as (select strftime(l_shipdate, '%Y-%m') as month, substr(o_orderpriority, 1, 1) || l_linestatus as ticker, sum(l_extendedprice) / sum(l_quantity) as px
  from lineitem join orders on l_orderkey = o_orderkey group by all)"""
MACRO = """macro as (select strftime(o_orderdate, '%Y-%m') as month, c_nationkey as series, sum(o_totalprice) as value, c_nationkey % 7 + 1 as tcode, n_regionkey + 2 as grp
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""


def MI(c: str) -> str:
    return f"(substr({c}, 1, 4)::int * 12 + substr({c}, 6, 2)::int - 1)"


def IM(e: str) -> str:
    return f"printf('%04d-%02d', (({e}) // 12)::int, (({e}) % 12 + 1)::int)"


RET = PX + f""", ret as (select month, ticker, r from (select month, ticker, case when lead({MI('month')}) over w = {MI('month')} + 1 then lead(px) over w end / px - 1 as r from px window w as (partition by ticker order by month)) where r is not null)"""
SPINE = f"""edges as (select series, min({MI('month')}) a, max({MI('month')}) b, max(tcode) tcode from macro group by series),
  sp as (select series, {IM('i')} as month, i, tcode from (select series, tcode, unnest(generate_series(a, b)) as i from edges)),
  full_m as (select sp.series, sp.month, sp.i, sp.tcode, m.value from sp left join macro m using (series, month))"""
LATEST = "lp as (select session, ticker, unnest(arg_max(struct_pack(open := open, high := high, low := low, close := close, adj_close := adj_close, volume := volume, finalized := finalized), retrieved_at)) from prices group by session, ticker)"


def r8(c: str, name: str | None = None):
    return F.round(F.col(c), 8).alias(name or c)


def monthly_returns(s: SparkSession, d: str) -> DataFrame:
    p = latest_readings(table(s, d, "prices")).filter("adj_close > 0")
    px = p.join(F.broadcast(T.first_sessions(p)), "session").select("month", "ticker", "adj_close")
    w = W.partitionBy("ticker").orderBy("month")
    nxt = F.when(F.lead("month").over(w) == add_month(F.col("month"), 1), F.lead("adj_close").over(w))
    return px.withColumn("r", nxt / F.col("adj_close") - 1).filter("r is not null").select("month", "ticker", r8("r"))


def price_violations(s, d):
    p = table(s, d, "prices").distinct()
    return C.violations(p, C.price_rules())


def price_coverage(s, d):
    return table(s, d, "prices").groupBy("ticker").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count_distinct("session").alias("n_sessions"))


def key_violations(s, d):
    return C.key_violations(table(s, d, "prices").distinct(), ["session", "ticker"])


def checked_join(s, d):
    px = V.asset_prices(s, d)
    rank = px.select("month", "ticker", F.rank().over(W.partitionBy("month").orderBy(F.round("px", 6).desc())).alias("place"))
    return C.checked_join(px.select("month", "ticker", r8("px")), rank, ["month", "ticker"])


def panel_gaps(s, d):
    return C.missing_cells(V.macro_panel(s, d), "month", "series")


def null_reasons(s, d):
    m = table(s, d, "macro_vintage").distinct()
    return C.null_without_reason(m, "value", "value_reason", ["vintage_month"])


def vintage_catalog(s, d):
    return table(s, d, "macro_vintage").groupBy("series").agg(F.min("vintage_month").alias("first_vintage"), F.max("vintage_month").alias("last_vintage"), F.count_distinct("vintage_month").alias("n_vintages"), F.max("macro_group").cast("int").alias("macro_group"))


def group_alias(s, d):
    m = table(s, d, "macro_vintage").filter("series is not null").select("series", "macro_group").distinct()
    groups = m.filter("macro_group is not null").groupBy("series").agg(F.min("macro_group").alias("grp"))
    return C.group_of_series(m.select("series").distinct(), groups)


def code_domains(s, d):
    return C.domain_violations(table(s, d, "macro_vintage").distinct(), {"tcode": range(1, 8), "macro_group": range(1, 9)})


def forecast_panel(s, d):
    f = table(s, d, "forecasts").select("run_id", "decision_month", "ticker", "model").distinct()
    return C.panel_faults(f, ["run_id", "decision_month", "ticker"], {"model": ["naive", "ridge", "bl", "mvo"]})


def account_gaps(s, d):
    a = table(s, d, "monthly_account").select("run_id", "strategy_id", "holding_month").distinct()
    return C.month_gaps(a, ["run_id", "strategy_id"], "holding_month")


def first_session_faults(s, d):
    """Months of a ticker, from its first to its last, whose first session has no usable final price: no other date may stand in."""
    p = latest_readings(table(s, d, "prices"))
    final = table(s, d, "prices").groupBy("session", "ticker").agg(F.max_by(F.coalesce("finalized", F.lit(False)), F.struct("retrieved_at", "finalized")).alias("final"))
    return C.first_session_faults(p.join(final, ["session", "ticker"]), T.first_sessions(p))


def file_vintages(s, d):
    f = table(s, d, "macro_raw_lines").select("file_name").distinct()
    return f.select("file_name", month_of_name(F.col("file_name")).alias("vintage"))


def final_sessions(s, d):
    """Per session, readings taken after the official close, before it, and on days the exchange was shut."""
    p = table(s, d, "prices").distinct().join(F.broadcast(closes(s)), "session", "left")  # some ten thousand sessions of a fixed calendar
    late = F.col("retrieved_at").cast("timestamp") >= F.col("close_at")
    return p.groupBy("session").agg(F.count_if(late).alias("final"), F.count_if(~late).alias("early"), F.count_if(F.col("close_at").isNull()).alias("shut"))


def lambda_evidence(s, d):
    """Selections and whether their evidence had ended before the decision of their month; without an end it never counts."""
    first = T.first_sessions(T.exchange_sessions(s)).select(F.col("month").alias("decision_month"), T.decision_time(F.col("session")).alias("decision_at"))
    sel = table(s, d, "lambda_selection").select("selection_id", "run_id", "decision_month", "selection_end_at").distinct()
    usable = D.usable_selections(sel.withColumn("selection_end_at", F.col("selection_end_at").cast("timestamp")), first)
    j = sel.join(usable.select("selection_id", F.lit(True).alias("usable")).distinct(), "selection_id", "left")
    return j.select("selection_id", "run_id", "decision_month", F.coalesce("usable", F.lit(False)).alias("usable"))


def month_literals(s, d):
    f = table(s, d, "lambda_selection").select("decision_month").distinct()
    return f.select("decision_month", is_month(F.col("decision_month")).alias("ok"), month_index(F.col("decision_month")).cast("int").alias("mi"), add_month(F.col("decision_month"), -14).alias("back14"))


def calendar_spine(s, d):
    m = V.macro_panel(s, d).select("series", "month", "value")
    return T.spine(m, ["series"], "month").select("series", "month", F.round("value", 4).alias("value"))


def asof_vintage(s, d):
    m = table(s, d, "monthly_account").select(F.col("holding_month").alias("month")).distinct()
    return T.latest_before(m, table(s, d, "macro_vintage"), 2)


def training_windows(s, d):
    m = table(s, d, "monthly_account").select(F.col("holding_month").alias("month")).distinct()
    return T.training_windows(m, "month")


def forward_folds(s, d):
    m = table(s, d, "monthly_account").select(F.col("holding_month").alias("month")).distinct()
    return T.forward_folds(m, "month")


def decision_ledger(s, d):
    m = table(s, d, "monthly_account").select(F.col("holding_month").alias("month")).distinct()
    sessions = T.exchange_sessions(s).filter("session < '2026-01-01'")
    ledger = T.decision_ledger(m, table(s, d, "macro_vintage"), sessions)
    return ledger.select("month", F.col("decision_at").cast("timestamp_ntz").alias("decision_at"), "vintage", "cutoff", "n_rows", F.col("training_rows")[47]["target_month"].alias("last_target"), F.col("training_rows")[47]["condition_base_month"].alias("last_base"), "targets_ended", "bases_known", "vintage_available")


def first_sessions(s, d):
    return T.first_sessions(table(s, d, "prices"))


def holding_days(s, d):
    a = table(s, d, "monthly_account").distinct()
    return a.select("run_id", "holding_month", "strategy_id", T.holding_days(F.col("execution_at"), F.col("target_end")).alias("days"))


def availability_times(s, d):
    v = table(s, d, "macro_vintage").select("vintage_month").distinct()
    return v.select("vintage_month", T.assumed_available_at(F.col("vintage_month"), 2).cast("timestamp_ntz").alias("available_at"))


def tcode_transforms(s, d):
    return X.transform_series(V.macro_panel(s, d), ["series"], "month", "value", "tcode").select("series", "month", "tcode", F.round("y", 6).alias("y"))


def bounded_ffill_median(s, d):
    x = X.impute_bounded(V.macro_panel(s, d), ["series"], "month", "value", 2)
    return x.select("series", "month", F.round("imputed", 4).alias("imputed"), "observed", "ffill", "median_fill")


def imputation_counts(s, d):
    f = table(s, d, "feature_result").distinct()
    c = lambda m: F.count_if(F.coalesce(F.col(m), F.lit(False)))
    return f.groupBy("window_id").agg(c("observed_mask").alias("observed"), c("ffill_mask").alias("ffill"), c("median_mask").alias("median"), F.count("*").alias("cells"))


def selection_reasons(s, d):
    m = V.macro_panel(s, d)
    return X.selection_reasons(m, "series", "value", "grp", 80).select("series", "observed", r8("missing_rate"), "reasons", "selected")


def standardized(s, d):
    z = X.standardize(V.macro_panel(s, d), ["series"], "value")
    return z.select("series", "month", r8("z"))


SERIES = range(25)  # the nations of the panel


def macro_pivot(s, d):
    m = V.macro_panel(s, d).withColumn("series", F.concat(F.lit("s"), F.col("series").cast("string")))
    p = m.groupBy("month").pivot("series", [f"s{i}" for i in SERIES]).agg(F.sum("value"))
    return p.select("month", *[F.round(f"s{i}", 4).alias(f"s{i}") for i in SERIES])


def macro_unpivot(s, d):
    p = macro_pivot(s, d)
    return p.unpivot(["month"], [f"s{i}" for i in SERIES], "series", "value").filter("value is not null")


def overlay_updates(s, d):
    """All vintages laid over each other in order: the last one that holds an observation counts."""
    m = table(s, d, "macro_vintage").filter("series is not null").select("vintage_month", "base_month", "series", "value").distinct()
    return C.overlay_all(m, ["base_month", "series"], "vintage_month").select("base_month", "series", "vintage_month")


def common_months(s, d):
    """Months that every strategy of a run holds: the intersection over all its variants."""
    a = table(s, d, "monthly_account").select("run_id", "strategy_id", "holding_month").distinct()
    return C.common_to_all(a, ["run_id"], "strategy_id", "holding_month")


def panel_except(s, d):
    """Cells of the panel that hold no value against cells of its complete spine."""
    m = V.macro_panel(s, d).select("month", "series")
    return C.differences(T.spine(m, ["series"], "month").select("month", "series"), m)


def strategy_pivot(s, d):
    a = table(s, d, "monthly_account").select("run_id", "holding_month", "strategy_id", "net_return").distinct()
    a = a.withColumn("model", F.split("strategy_id", "_").getItem(0)).groupBy("holding_month").pivot("model", ["naive", "ridge", "bl", "mvo"]).agg(F.avg("net_return"))
    return a.select("holding_month", *[r8(c) for c in ("naive", "ridge", "bl", "mvo")])


QUERIES = {f.__name__: f for f in (
    monthly_returns, price_violations, price_coverage, key_violations, checked_join, panel_gaps, null_reasons, vintage_catalog, group_alias, file_vintages, final_sessions, lambda_evidence, month_literals, calendar_spine, asof_vintage,
    training_windows, forward_folds, decision_ledger, first_sessions, holding_days, availability_times, tcode_transforms, bounded_ffill_median, imputation_counts, selection_reasons,
    standardized, code_domains, forecast_panel, account_gaps, first_session_faults, macro_pivot, macro_unpivot, overlay_updates, common_months, panel_except, strategy_pivot,
)}

# weekday holidays near a month's first session decide the instants: all of them, as dates
_HOLIDAYS = sorted(str(x) for y in range(1990, 2026) for x in T.exchange_holidays(y))
# half days by their rule: the day after the fourth Thursday of November, December 24 and July 3
_CAL = f"""hol as (select unnest([{', '.join("'" + h + "'::date" for h in _HOLIDAYS)}]) as d),
  days as (select d::date as d from (select unnest(generate_series(date '1990-01-01', date '2025-12-31', interval 1 day)) as d) where dayofweek(d) between 1 and 5 and d::date not in (select d from hol)),
  half as (select d from days where (month(d) = 12 and day(d) = 24) or (month(d) = 7 and day(d) = 3) or (month(d) = 11 and dayofweek(d) = 5 and day(d) between 23 and 29))"""
_DM = "dm as (select distinct holding_month as month from monthly_account)"
_FIN = lambda c: f"({c} is not null and not isnan({c}) and not isinf({c}) and {c} > 0)"
_PIVOT = f"with {MACRO} select month, " + ", ".join(f"round(sum(value) filter (series = {i}), 4) as s{i}" for i in SERIES) + " from macro group by month"
SQL = {
    "monthly_returns": f"""with {LATEST}, ok as (select * from lp where adj_close > 0), fs as (select substr(session, 1, 7) as month, min(session) as session from ok group by 1),
  p as (select month, ticker, adj_close from ok join fs using (session)),
  n as (select *, lead(month) over w as nm, lead(adj_close) over w as na from p window w as (partition by ticker order by month))
select month, ticker, round(na / adj_close - 1, 8) as r from n where {MI('nm')} = {MI('month')} + 1""",
    "price_violations": f"""with p as (select distinct * from prices) select count(*) as n_rows,
  count(*) filter (not coalesce({' and '.join(_FIN(c) for c in ('open', 'high', 'low', 'close', 'adj_close'))}, false)) as bad_price,
  count(*) filter (not coalesce(volume >= 0 and not isinf(volume) and not isnan(volume), false)) as bad_volume,
  count(*) filter (not coalesce(high >= greatest(open, close, low) - 1e-8, false)) as bad_high, count(*) filter (not coalesce(low <= least(open, close, high) + 1e-8, false)) as bad_low,
  count(*) filter (not coalesce(finalized, false)) as not_final from p""",
    "price_coverage": "select ticker, min(session) as first_session, max(session) as last_session, count(distinct session) as n_sessions from prices group by ticker",
    "key_violations": "select session, ticker, count(*) as n_rows from (select distinct * from prices) group by all having count(*) > 1 or session is null or ticker is null",
    "checked_join": f"with {PX} select month, ticker, round(px, 8) as px, rank() over (partition by month order by round(px, 6) desc)::int as place from px",
    "panel_gaps": f"with {MACRO} select month, series from (select distinct month from macro), (select distinct series from macro) except select month, series from macro",
    "null_reasons": "select vintage_month, count(*) filter (value is null) as nulls, count(*) filter (value is null and trim(coalesce(value_reason, '')) = '') as unexplained from (select distinct * from macro_vintage) group by 1",
    "vintage_catalog": "select series, min(vintage_month) as first_vintage, max(vintage_month) as last_vintage, count(distinct vintage_month) as n_vintages, max(macro_group)::int as macro_group from macro_vintage group by series",
    "group_alias": f"""with al(old, new) as (values {', '.join(f"('{a}', '{b}')" for a, b in C.ALIASES.items())}), g as (select upper(series) as k, min(macro_group) as grp from macro_vintage where macro_group is not null and series is not null group by 1)
select s.series, coalesce(al.new, s.series) as reference, g.grp::int as grp, al.new is not null as alias from (select distinct series from macro_vintage where series is not null) s left join al on al.old = s.series left join g on g.k = upper(coalesce(al.new, s.series))""",
    "month_literals": f"""with m as (select distinct decision_month, coalesce(regexp_matches(decision_month, '^\\d{{4}}-(0[1-9]|1[0-2])$'), false) as ok from lambda_selection)
select decision_month, ok, case when ok then {MI('decision_month')} end as mi, case when ok then {IM(MI('decision_month') + ' - 14')} end as back14 from m""",
    "calendar_spine": f"with {MACRO}, {SPINE} select series, month, round(value, 4) as value from full_m",
    "asof_vintage": f"with {_DM}, v as (select distinct vintage_month from macro_vintage) select month, (select max(vintage_month) from v where {MI('vintage_month')} <= {MI('month')} - 2) as vintage from dm",
    "training_windows": f"with {_DM}, t as (select month, {MI('month')} + o as i, o + 49 as position from dm, (select unnest(generate_series(-49, -2)) as o)) select month, position::int as position, {IM('i')} as target_month, {IM('i - 3')} as predictor_base_month, {IM('i - 2')} as condition_base_month from t",
    "forward_folds": f"with {_DM}, t as (select month, {MI('month')} - 49 as a, k as fold, k + 23 as n from dm, (select unnest(generate_series(0, 23)) as k)) select month, fold::int as fold, n::int as rows, {IM('a')} as first_target, {IM('a + n - 1')} as last_target, {IM('a + n + 1')} as validation_month from t",
    "decision_ledger": f"""with {_DM}, v as (select distinct vintage_month from macro_vintage),
  hol as (select unnest([{', '.join("'" + h + "'::date" for h in _HOLIDAYS)}]) as d),
  days as (select d::date as d from (select unnest(generate_series(date '1990-01-01', date '2025-12-31', interval 1 day)) as d) where dayofweek(d) between 1 and 5 and d::date not in (select d from hol)),
  fs as (select strftime(d, '%Y-%m') as m, min(d) as d from days group by 1),
  ut as (select m, {MI('m')} as i, ((d || ' 09:00:00')::timestamp at time zone 'America/New_York') at time zone 'UTC' as opens, ((d || ' 16:00:00')::timestamp at time zone 'America/New_York') at time zone 'UTC' as closes from fs),
  k as (select month, {MI('month')} as i, (select max(vintage_month) from v where {MI('vintage_month')} <= {MI('month')} - 2) as vintage from dm),
  t as (select k.month, k.i + o as s, u.closes as ends from k, (select unnest(generate_series(-49, -2)) as o) left join ut u on u.i = k.i + o + 1),
  g as (select month, count(*) as n_rows, max(s) as last_s, max(ends) as ended, count(*) filter (ends is null) as missing from t group by month)
select k.month, u.opens as decision_at, vintage, {IM('k.i - 3')} as cutoff, n_rows, {IM('last_s')} as last_target, {IM('last_s - 2')} as last_base, coalesce(missing = 0 and ended < u.opens, false) as targets_ended, last_s - 2 <= k.i - 3 as bases_known,
  coalesce((({IM(MI('vintage') + ' + 2')} || '-01 00:00:00')::timestamp at time zone 'America/New_York') at time zone 'UTC' < u.opens, false) as vintage_available
from k join g using (month) left join ut u on u.m = k.month""",
    "file_vintages": """with f as (select distinct file_name from macro_raw_lines), g as (select file_name, regexp_extract(file_name, '(\\d{4})[-m](\\d{1,2})', ['y', 'm']) as x from f)
select file_name, case when x.y <> '' then x.y || '-' || lpad(x.m, 2, '0') end as vintage from g""",
    "final_sessions": f"""with {_CAL}, c as (select d::varchar as session, ((d || case when d in (select d from half) then ' 13:00:00' else ' 16:00:00' end)::timestamp at time zone 'America/New_York') at time zone 'UTC' as close_at from days)
select session, count(*) filter (retrieved_at >= close_at) as final, count(*) filter (retrieved_at < close_at) as early, count(*) filter (close_at is null) as shut from (select distinct * from prices) left join c using (session) group by session""",
    "lambda_evidence": f"""with {_CAL}, fs as (select strftime(d, '%Y-%m') as decision_month, ((min(d) || ' 09:00:00')::timestamp at time zone 'America/New_York') at time zone 'UTC' as decision_at from days group by 1)
select distinct selection_id, run_id, decision_month, coalesce(selection_end_at < decision_at, false) as usable from lambda_selection left join fs using (decision_month)""",
    "first_sessions": "select substr(session, 1, 7) as month, min(session) as session from prices group by 1",
    "holding_days": "select run_id, holding_month, strategy_id, date_diff('day', (execution_at at time zone 'UTC' at time zone 'America/New_York')::date, (target_end at time zone 'UTC' at time zone 'America/New_York')::date)::int as days from (select distinct * from monthly_account)",
    "availability_times": f"with v as (select distinct vintage_month from macro_vintage) select vintage_month, (({IM(MI('vintage_month') + ' + 2')} || '-01 00:00:00')::timestamp at time zone 'America/New_York') at time zone 'UTC' as available_at from v",
    "tcode_transforms": f"""with {MACRO}, {SPINE}, l as (select *, case when value > 0 then ln(value) end as l from full_m),
  g as (select *, lag(value) over w x1, lag(value, 2) over w x2, lag(l) over w l1, lag(l, 2) over w l2 from l window w as (partition by series order by month)),
  h as (select *, value / nullif(x1, 0) - 1 as g0, x1 / nullif(x2, 0) - 1 as g1 from g)
select series, month, tcode, round(case tcode when 1 then value when 2 then value - x1 when 3 then value - 2 * x1 + x2 when 4 then l when 5 then l - l1 when 6 then l - 2 * l1 + l2 when 7 then g0 - g1 end, 6) as y from h""",
    "bounded_ffill_median": f"""with {MACRO}, {SPINE}, c as (select *, last_value(value ignore nulls) over (partition by series order by month rows between 2 preceding and 1 preceding) as carry, median(value) over (partition by series) as med from full_m)
select series, month, round(coalesce(value, carry, med), 4) as imputed, value is not null as observed, value is null and carry is not null as ffill, value is null and carry is null and med is not null as median_fill from c""",
    "imputation_counts": "select window_id, count(*) filter (observed_mask) as observed, count(*) filter (ffill_mask) as ffill, count(*) filter (median_mask) as median, count(*) as cells from (select distinct * from feature_result) group by 1",
    "selection_reasons": f"""with {MACRO}, s as (select series, max(grp) g, count(value) observed, count(distinct value) dif from macro group by 1), t as (select *, 1 - observed / 80.0 as mr from s)
select series, observed, round(mr, 8)::double as missing_rate, array_to_string(list_filter([case when g = 6 then 'excluded_group' end, case when observed = 0 then 'no_observations' end, case when observed > 0 and dif = 1 then 'constant' end, case when mr > 0.2 then 'missing_rate' end], lambda x: x is not null), ',') as reasons,
  not (g = 6 or observed = 0 or (observed > 0 and dif = 1) or mr > 0.2) as selected from t""",
    "standardized": f"with {MACRO} select series, month, round((value - avg(value) over (partition by series)) / nullif(stddev_pop(value) over (partition by series), 0), 8) as z from macro",
    "macro_pivot": _PIVOT,
    "macro_unpivot": f"select month, series, value from ({_PIVOT}) unpivot (value for series in ({', '.join(f's{i}' for i in SERIES)}))",
    "overlay_updates": "select base_month, series, max(vintage_month) as vintage_month from macro_vintage where series is not null group by all",
    "common_months": """with a as (select distinct run_id, strategy_id, holding_month from monthly_account)
select run_id, holding_month from a r where not exists (select 1 from a v where v.run_id = r.run_id and not exists (select 1 from a x where x.run_id = v.run_id and x.strategy_id = v.strategy_id and x.holding_month = r.holding_month)) group by all""",
    "panel_except": f"with {MACRO}, {SPINE} select month, series, 'left' as side from full_m where value is null",
    "code_domains": """with m as (select distinct * from macro_vintage), x as (select 'tcode' as col, tcode::varchar as value, coalesce(tcode between 1 and 7, false) as ok from m union all select 'macro_group', macro_group::varchar, coalesce(macro_group between 1 and 8, false) from m)
select col as "column", value, count(*) as n_rows from x where not ok group by all""",
    "forecast_panel": """with f as (select distinct run_id, decision_month, ticker, model from forecasts), k as (select distinct run_id, decision_month, ticker from f), w as (select k.*, model from k, (select unnest(['naive', 'ridge', 'bl', 'mvo']) as model))
select w.*, 'missing' as fault from w where not exists (select 1 from f where f.run_id is not distinct from w.run_id and f.decision_month is not distinct from w.decision_month and f.ticker is not distinct from w.ticker and f.model = w.model)
union all select f.run_id, f.decision_month, f.ticker, f.model, 'unexpected' from f where model is null or model not in ('naive', 'ridge', 'bl', 'mvo')""",
    "account_gaps": f"""with a as (select distinct run_id, strategy_id, holding_month from monthly_account), g as (select *, lag(holding_month) over w as previous, {MI('holding_month')} - lag({MI('holding_month')}) over w as gap from a window w as (partition by run_id, strategy_id order by holding_month))
select run_id, strategy_id, holding_month, previous, gap::int as gap from g where gap <> 1""",
    "first_session_faults": f"""with l as (select session, ticker, arg_max(adj_close, retrieved_at) as px, arg_max(coalesce(finalized, false), (retrieved_at, finalized)) as final from prices group by all),
  fs as (select substr(session, 1, 7) as month, min(session) as session from prices group by 1), e as (select ticker, min(session) as a, max(session) as b from l group by 1),
  w as (select ticker, month, session from e join fs on fs.session >= substr(e.a, 1, 7) and fs.session <= e.b)
select w.ticker, w.month, case when l.session is null then case when w.session < e.a then 'partial_listing_month' else 'first_session_missing' end when not final then 'not_final' else 'bad_price' end as fault
from w join e using (ticker) left join l using (session, ticker) where l.session is null or not final or px is null or isnan(px) or isinf(px) or px <= 0""",
    "strategy_pivot": "with a as (select distinct run_id, holding_month, strategy_id, net_return, split_part(strategy_id, '_', 1) as m from monthly_account) select holding_month, " + ", ".join(f"round(avg(net_return) filter (m = '{m}'), 8) as {m}" for m in ("naive", "ridge", "bl", "mvo")) + " from a group by 1",
}
