"""Decision windows: features, regimes and forecasts fitted on a window's own training rows, one group a window.

A window is (decision_month, window): the outer window of a decision has window = decision_month, an inner one
the month it is tried on. It holds `rows` targets from first_target on; the features of target s are those of base
month s - lag - 1 (predictor) and s - lag (condition), the query is base month window - lag - 1, and no later base
month is read. All windows are fitted in parallel in one plan; a group is bounded by the calendar and the panel.
Fitted states are rows of plain arrays: stored as tables, they transform new months and feed every later step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.months import index_month, month_index
from . import numeric as N
from .constraints import ContractError


@dataclass(frozen=True)
class Settings:
    train: int = 48
    lag: int = 2
    missing_rate: float = 0.2
    limit: int = 2
    variance: float = 0.95
    k: int = 5
    seed: int = 0
    starts: int = 20
    least_members: int = 6
    fallback: str = "pooled"
    shrink: float = 0.1
    eps: float = 1e-8
    tau: float = 0.05
    omega: float = 1.0
    delta: float = 3.0
    lambdas: tuple[float, ...] = field(default_factory=N.lambda_grid)
    models: tuple[str, ...] = ("naive", "ridge", "bl", "mvo")


def sensitivity_variants(base: Settings = Settings()) -> dict[str, tuple[Settings, dict, str]]:
    """One change at a time: name -> (settings, account options, curve 'plain' or 'scaled')."""
    paid = lambda bps: {"cost_bps": bps, "borrow": 0.02, "financing": 0.02}
    fits = {
        "lag_1": {"lag": 1}, "lag_3": {"lag": 3}, "missing_rate_005": {"missing_rate": 0.05}, "ffill_limit_0": {"limit": 0}, "pca_090": {"variance": 0.9}, "pca_099": {"variance": 0.99},
        "fallback_regime_mean": {"fallback": "regime_mean"}, "validation_forward": {}, "cov_shrink_0": {"shrink": 0.0}, "cov_shrink_025": {"shrink": 0.25}, "omega_scale_05": {"omega": 0.5}, "omega_scale_2": {"omega": 2.0},
    }
    out = {name: (replace(base, **change), {}, "plain") for name, change in fits.items()}
    out |= {"cost_10bp": (base, paid(10.0), "plain"), "cost_25bp": (base, paid(25.0), "plain")}
    return out | {"gross_cap_1": (base, {"scaled": {"cap": 1.0}}, "scaled"), "vol_lookback_12": (base, {"scaled": {"lookback": 12}}, "scaled")}


# --- one window, in numpy


def carry_and_fill(values: np.ndarray, medians: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(filled, how) of a months x series matrix without month gaps: 0 observed, 1 carried over at most `limit` months, 2 the median."""
    out, how = values.copy(), np.where(np.isfinite(values), 0, 2)
    for back in range(1, limit + 1):
        past = np.full_like(values, np.nan)
        past[back:] = values[:-back]
        take = (how == 2) & np.isfinite(past)
        out[take], how[take] = past[take], 1
    return np.where(how == 2, medians[None], out), how


def _grid(panel: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
    return panel.reindex(range(first, last + 1))


def fit_features(panel: pd.DataFrame, fit: Sequence[int], groups: dict, s: Settings) -> dict:
    """Selection, imputation, scaling and components from the fit months only; panel is month number x series.

    Up to `limit` months before the first fit month may be carried on; months inside the span that aren't fit
    months are blank. Selected series have an allowed group, observations, some variation and few gaps.
    """
    fit = sorted(fit)
    own = panel.reindex(fit)
    why = {}
    for c in panel.columns:
        seen = own[c].dropna()
        faults = [
            ("excluded_group", groups.get(c) == 6), ("no_observations", seen.empty), ("constant", len(seen) > 0 and seen.nunique() == 1), ("missing_rate", own[c].isna().mean() > s.missing_rate),
        ]
        why[c] = [name for name, bad in faults if bad]
    columns = [c for c in panel.columns if not why[c]]
    if not columns:
        raise ContractError("no usable series in a window")
    span = _grid(panel[columns], fit[0] - s.limit, fit[-1])
    span.loc[[m for m in span.index if m >= fit[0] and m not in set(fit)]] = np.nan
    medians = own[columns].median().to_numpy()
    filled, how = carry_and_fill(span.to_numpy(dtype=float), medians, s.limit)
    at = [m - span.index[0] for m in fit]
    x = filled[at]
    mean, scale = x.mean(axis=0), x.std(axis=0)
    if (scale <= 0).any():
        raise ContractError("a selected series has no variation once filled")
    z = (x - mean) / scale
    scores, components, ratio = N.principal_components(z, s.variance)
    return {
        "columns": columns, "fit": fit, "medians": medians, "mean": mean, "scale": scale, "center": z.mean(axis=0), "components": components, "ratio": ratio, "filled": x, "scores": scores, "limit": s.limit,
        "counts": [int((how[at] == k).sum()) for k in range(3)], "reasons": why,
    }


def transform_features(state: dict, panel: pd.DataFrame, months: Sequence[int]) -> np.ndarray:
    """Scores of months under a fitted state; fit months replay exactly what was fitted."""
    span = _grid(panel.reindex(columns=state["columns"]), min(months) - state["limit"], max(months))
    filled, _ = carry_and_fill(span.to_numpy(dtype=float), np.asarray(state["medians"]), state["limit"])
    place = {m: i for i, m in enumerate(state["fit"])}
    x = np.array([state["filled"][place[m]] if m in place else filled[m - span.index[0]] for m in months])
    return ((x - state["mean"]) / state["scale"] - state["center"]) @ np.asarray(state["components"]).T


def inverse_features(state: dict, scores: np.ndarray) -> np.ndarray:
    """Scores back in the units of the series."""
    return (np.asarray(scores) @ np.asarray(state["components"]) + np.asarray(state["center"])) * np.asarray(state["scale"]) + np.asarray(state["mean"])


def _soft(d: np.ndarray) -> np.ndarray:
    total = d.sum()
    return np.full(len(d), 1 / len(d)) if total == 0 else (1 - d / total) / (len(d) - 1)


def _cosine(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    nx, nc = np.linalg.norm(x), np.linalg.norm(c, axis=1)
    d = np.clip(1 - (c @ x) / np.where(nc * nx == 0, 1, nc * nx), 0, 2)
    return np.where((nc == 0) & (nx == 0), 0.0, np.where((nc == 0) | (nx == 0), 1.0, d))


def regime_probabilities(x: np.ndarray, stage1: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Soft membership of one point in regimes 0..k: the crisis share from Euclidean distances to the two stage-one centers, the rest from angles."""
    p0 = _soft(np.linalg.norm(stage1 - x, axis=1))[0]
    normal = _soft(_cosine(x, centers))
    if p0 >= 1:
        return np.array([1.0, *np.zeros(len(normal))])
    p = np.array([-normal.max() * np.log1p(-p0) / np.log(2), *normal])
    return p / p.sum()


def transition_matrix(labels: np.ndarray, months: Sequence[int], k: int) -> tuple[np.ndarray, int]:
    """(rates, skipped): moves between months that follow each other; a regime never left stays where it is."""
    n = np.zeros((k, k))
    skipped = 0
    for a, b, i, j in zip(labels[:-1], labels[1:], months[:-1], months[1:]):
        if j == i + 1:
            n[a, b] += 1
        else:
            skipped += 1
    out = n.sum(axis=1, keepdims=True)
    return np.where(out > 0, n / np.where(out > 0, out, 1), np.eye(k)), skipped


def centers_of(scores: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(stage1, centers) of given labels: means of crisis and the rest, and mean directions of regimes 1..k; an empty regime has a zero center."""
    rest = scores[labels != 0]
    zero = np.zeros(scores.shape[1])
    stage1 = np.array([scores[labels == 0].mean(axis=0) if (labels == 0).any() else zero, rest.mean(axis=0) if len(rest) else zero])
    unit = lambda v: v / (np.linalg.norm(v, axis=-1, keepdims=True) + (np.linalg.norm(v, axis=-1, keepdims=True) == 0))
    return stage1, np.array([unit(unit(scores[labels == r]).mean(axis=0)) if (labels == r).any() else zero for r in range(1, k + 1)])


def assemble(scores: np.ndarray, current: np.ndarray, labels: np.ndarray, months: Sequence[int], k: int, centers: tuple | None = None) -> dict:
    """The part of a state that follows from labels: centers, transitions, current and next probabilities."""
    stage1, normal = centers or centers_of(scores, labels, k)
    move, skipped = transition_matrix(labels, months, k + 1)
    now = regime_probabilities(current, stage1, normal)
    then = now @ move
    return {"stage1": stage1, "centers": normal, "transition": move, "skipped": skipped, "current_p": now, "next_p": then / then.sum()}


def fit_state(panel: pd.DataFrame, first_target: int, rows: int, window: int, groups: dict, s: Settings) -> dict:
    fit = [first_target - s.lag + i for i in range(rows)]
    f = fit_features(panel, fit, groups, s)
    labels, _, stage1, centers = N.two_stage_centers(f["scores"], s.k, s.seed, s.starts)
    current = transform_features(f, panel, [window - s.lag - 1])[0]
    out = f | {"labels": labels, "predictors": transform_features(f, panel, [m - 1 for m in fit]), "current": current}
    return out | assemble(f["scores"], current, labels, fit, s.k, (stage1, centers))


def ridge_predictions(x: np.ndarray, y: np.ndarray, query: np.ndarray, lambdas: np.ndarray) -> np.ndarray:
    """Predictions at the query, penalties x assets."""
    out = np.empty((len(lambdas), y.shape[1]))
    for j in range(y.shape[1]):
        coef, icpt, _ = N.ridge_path(x, y[:, j], lambdas)
        out[:, j] = coef @ query + icpt
    return out


def ridge_fit(x: np.ndarray, y: np.ndarray, query: np.ndarray, s: Settings, fixed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(predictions, penalties) an asset: a fixed penalty, or that of least leave-one-out error."""
    pred, lam = np.empty(y.shape[1]), np.empty(y.shape[1])
    for j in range(y.shape[1]):
        grid = np.asarray(s.lambdas if fixed is None else [fixed[j]])
        coef, icpt, mse = N.ridge_path(x, y[:, j], grid)
        i = N.choose_lambda(grid, mse) if fixed is None else 0
        pred[j], lam[j] = coef[i] @ query + icpt[i], grid[i]
    return pred, lam


def by_regime(x: np.ndarray, y: np.ndarray, labels: np.ndarray, s: Settings, fit) -> list[tuple[int, str, int, int, object]]:
    """(regime, fallback, members, used, fit of the rows used) for regimes 1..k; a regime with few members falls back to all rows, or to means (fit None)."""
    pooled, out = None, []
    for r in range(1, s.k + 1):
        inside = labels == r
        n = int(inside.sum())
        if n >= s.least_members:
            out.append((r, "none", n, n, fit(x[inside], y[inside])))
        elif s.fallback == "regime_mean":
            rows = inside if n else np.ones(len(y), dtype=bool)
            out.append((r, "regime_mean" if n else "pooled_mean", n, int(rows.sum()), y[rows].mean(axis=0)))
        else:
            pooled = fit(x, y) if pooled is None else pooled
            out.append((r, "pooled", n, len(y), pooled))
    return out


def forecast(x: np.ndarray, y: np.ndarray, query: np.ndarray, labels: np.ndarray, p: np.ndarray, s: Settings, fixed: np.ndarray | None = None) -> list[tuple]:
    """Rows (model, asset number, regime or None, value, score_kind, raw_n, effective_n, lambda, fallback, status, reason).

    Rows with a regime are conditional forecasts, those without the final ones. ridge: sum over regimes 1..k of the next
    probability times the regime's prediction, not renormalised, so the crisis share stays in cash. naive and bl
    take the regime of greatest next probability, ties to the smallest; mvo takes none.
    """
    a = y.shape[1]
    p = N.require_probabilities(p, 1e-9)
    modal = int(np.argmax(p))
    inside = y[labels == modal]
    n = len(inside)
    out: list[tuple] = []

    def add(model, regime, values, kind, raw=None, used=None, lam=None, fallback="none", status="ok", reason=""):
        each = lambda v, j: v[j] if isinstance(v, (list, np.ndarray)) else v
        out.extend((model, j, regime, float(values[j]), kind, raw, used, None if lam is None else float(lam[j]), fallback, each(status, j), each(reason, j)) for j in range(a))

    if "naive" in s.models:
        flat = [n < 2 or inside[:, j].max() == inside[:, j].min() for j in range(a)]
        value = [0.0 if flat[j] else inside[:, j].mean() / inside[:, j].std(ddof=1) for j in range(a)]
        status = ["undefined" if f else "ok" for f in flat]
        reason = ["fewer_than_two" if n < 2 else "constant" if f else "" for f in flat]
        add("naive", modal, value, "conditional_sharpe", n, n, status=status, reason=reason)
        add("naive", None, value, "conditional_sharpe", status=status, reason=reason)
    if "ridge" in s.models:
        total, used = np.zeros(a), False
        for r, fallback, raw, eff, got in by_regime(x, y, labels, s, lambda u, v: ridge_fit(u, v, query, s, fixed)):
            pred, lam = got if isinstance(got, tuple) else (got, None)
            reason = "" if fallback == "none" else f"small_regime_{fallback}"
            add("ridge", r, pred, "expected_return", raw, eff, lam, fallback, "ok" if fallback == "none" else "fallback", reason)
            total, used = total + p[r] * pred, used or (fallback != "none" and p[r] > 0)
        reason = "no_normal_probability" if p[1:].sum() == 0 else "regime_fallback" if used else ""
        add("ridge", None, total, "expected_return", status="fallback" if used else "ok", reason=reason)
    if {"bl", "mvo"} & set(s.models):
        mean, c = y.mean(axis=0), np.atleast_2d(np.cov(y.T))
        cov = N.require_spd((1 - s.shrink) * c + s.shrink * np.diag(np.diag(c)) + s.eps * np.eye(a))
        if "bl" in s.models:
            few = n < 2
            q = mean if few else inside.mean(axis=0)
            post = N.black_litterman(mean, cov, q, np.eye(a), s.omega * np.diag(np.diag(cov)) / max(n, 1), s.tau)
            how = {"fallback": "prior_mean" if few else "none", "status": "fallback" if few else "ok", "reason": "few_members_prior_mean" if few else ""}
            add("bl", modal, q, "expected_return", n, len(y) if few else n, **how)
            add("bl", None, N.utility_direction(post, cov, s.delta), "utility_weight", **how)
        if "mvo" in s.models:
            add("mvo", None, N.utility_direction(mean, cov, s.delta), "utility_weight")
    return out


# --- all windows


KEYS = ["decision_month", "window"]
_V, _M = "array<double>", "array<array<double>>"
STATE_SCHEMA = (
    "decision_month string, window string, first_target string, rows int, columns array<string>, fit_months array<string>, medians " + _V + ", mean " + _V + ", scale " + _V + ", center " + _V + ", components " + _M + ", ratio " + _V
    + ", filled " + _M + ", scores " + _M + ", counts array<int>, labels array<int>, predictors " + _M + ", current " + _V + ", stage1 " + _M + ", centers " + _M + ", transition " + _M + ", skipped int, current_p " + _V + ", next_p " + _V + ", state_id string, reason string"
)


def outer_windows(decisions: DataFrame, month: str = "month", s: Settings = Settings()) -> DataFrame:
    d = month_index(F.col(month))
    return decisions.select(F.col(month).alias("decision_month"), F.col(month).alias("window"), index_month(d - s.train - 1).alias("first_target"), F.lit(s.train).alias("rows")).distinct()


def inner_windows(decisions: DataFrame, month: str = "month", s: Settings = Settings(), first: int = 23) -> DataFrame:
    from .timing import forward_folds

    return forward_folds(decisions, month, s.train, first).select(F.col(month).alias("decision_month"), F.col("validation_month").alias("window"), "first_target", "rows")


def _id(state: dict) -> str:
    """A digest of a state's content."""
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    return hashlib.sha256(json.dumps({k: plain(v) for k, v in state.items() if k not in ("state_id", "reason")}, sort_keys=True).encode()).hexdigest()


def _name(i: int) -> str:
    return f"{i // 12:04d}-{i % 12 + 1:02d}"


def _number(m: str) -> int:
    return int(m[:4]) * 12 + int(m[5:]) - 1


def _wide(pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    wide = pdf.assign(i=pdf["base_month"].map(_number)).pivot_table(index="i", columns="series", values="y", aggfunc="max", dropna=False)
    return wide.sort_index(axis=1), {str(k): v for k, v in pdf.groupby("series")["grp"].max().items()}


def window_states(panel: DataFrame, windows: DataFrame, s: Settings = Settings(), strict: bool = True) -> DataFrame:
    """One fitted state a window (STATE_SCHEMA) from a transformed panel (base_month, series, y, grp; with a column vintage, the window's own).

    A window that can't be fitted (no usable series, say) is an error, or with strict=False a row that holds only
    its keys and the reason. Base months after window - lag - 1
    never reach the fit; transformation codes look back only, so cutting before or after them is the same.
    """
    on = ["vintage"] if "vintage" in panel.columns and "vintage" in windows.columns else []
    first = month_index(F.col("first_target")) - s.lag - 1 - s.limit
    need = windows.withColumn("base_month", F.explode(F.transform(F.sequence(first, month_index(F.col("window")) - s.lag - 1), index_month)))
    rows = need.join(panel.select("base_month", F.col("series").cast("string").alias("series"), "y", "grp", *on), ["base_month", *on])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        wide, groups = _wide(pdf)
        names = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
        try:
            st = fit_state(wide, _number(one["first_target"]), int(one["rows"]), _number(one["window"]), groups, s)
        except ContractError as e:
            if strict:
                raise
            return pd.DataFrame([{"decision_month": one["decision_month"], "window": one["window"], "first_target": one["first_target"], "rows": int(one["rows"]), "reason": str(e)}]).reindex(columns=names).astype(object).where(lambda d: d.notna(), None)
        row = {k: st[k] for k in ("columns", "medians", "mean", "scale", "center", "components", "ratio", "filled", "scores", "counts", "labels", "predictors", "current", "stage1", "centers", "transition", "skipped", "current_p", "next_p")}
        row |= {"decision_month": one["decision_month"], "window": one["window"], "first_target": one["first_target"], "rows": int(one["rows"]), "fit_months": [_name(m) for m in st["fit"]]}
        row = {k: [list(r) for r in v] if isinstance(v, np.ndarray) and v.ndim == 2 else list(v) if isinstance(v, np.ndarray) else v for k, v in row.items()}
        row["state_id"], row["reason"] = _id(row), None
        return pd.DataFrame([row])[names]

    return rows.groupBy(*KEYS).applyInPandas(fit, STATE_SCHEMA)


def _matrix(v) -> np.ndarray:
    return np.array([np.asarray(r, dtype=float) for r in v]) if len(v) else np.zeros((0, 0))


def require_intact(states: DataFrame) -> DataFrame:
    """(decision_month, window): stored states whose content isn't what their state_id says."""

    def check(batches):
        for pdf in batches:
            plain = lambda v: [plain(x) for x in v] if hasattr(v, "__len__") and not isinstance(v, str) else v.item() if hasattr(v, "item") else v
            bad = [_id({k: plain(v) for k, v in r.items()}) != r["state_id"] for r in pdf.to_dict("records")]
            yield pdf[KEYS][bad]

    return states.mapInPandas(check, "decision_month string, window string")


def with_labels(states: DataFrame, seeds: Sequence[int], k: int = 5) -> DataFrame:
    """Every state with its memberships permuted by each seed (column seed): centers, transitions and probabilities are made anew, features stay."""

    def run(batches):
        for pdf in batches:
            for seed in seeds:
                rows = []
                for r in pdf.to_dict("records"):
                    labels = np.random.default_rng(seed).permutation(np.asarray(r["labels"]))
                    new = assemble(_matrix(r["scores"]), np.asarray(r["current"]), labels, [_number(m) for m in r["fit_months"]], k)
                    r = r | {"labels": labels.tolist(), "seed": seed} | {c: [list(x) for x in v] if isinstance(v, np.ndarray) and v.ndim == 2 else list(v) if isinstance(v, np.ndarray) else v for c, v in new.items()}
                    rows.append(r | {"state_id": f"{r['state_id']}-{seed}"})
                yield pd.DataFrame(rows)[[*pdf.columns, "seed"]]

    return states.mapInPandas(run, STATE_SCHEMA + ", seed int")


FORECAST_SCHEMA = "decision_month string, window string, model string, ticker string, regime int, value double, score_kind string, raw_n int, effective_n int, lambda double, fallback string, status string, reason string"


def with_returns(states: DataFrame, returns: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """states with column y, the returns (month, ticker, r) of their targets."""
    t = states.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: index_month(month_index(F.col("first_target")) + i))).alias("month"))
    y = t.join(returns, "month").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("month", "ticker", "r"))).alias("y"))
    return states.join(y, list(by))


def _targets(r: dict) -> tuple[np.ndarray, list[str], list[str]]:
    """(rows x assets, assets with every target, assets without)."""
    y = pd.DataFrame([(e["month"], e["ticker"], e["r"]) for e in r["y"]], columns=["m", "t", "r"]).pivot_table(index="m", columns="t", values="r", aggfunc="max", dropna=False)
    want = [_name(_number(r["first_target"]) + i) for i in range(int(r["rows"]))]
    y = y.reindex(want)
    full = [t for t in y.columns if y[t].notna().all()]
    return y[full].to_numpy(dtype=float), full, [t for t in y.columns if t not in full]


def window_forecasts(states: DataFrame, returns: DataFrame, s: Settings = Settings(), fixed: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Forecasts of every window (FORECAST_SCHEMA): conditional rows with a regime, final rows without.

    fixed: (decision_month, ticker, lambda) chosen elsewhere, for past-only validation. A ticker that lacks a
    target's return has a final row of status 'missing_history' without a value for every model.
    """
    extra = list(extra)
    data = with_returns(states, returns, [*KEYS, *extra])
    given = fixed is not None
    if given:
        data = data.join(fixed.groupBy("decision_month").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "lambda"))).alias("fixed")), "decision_month")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                y, full, rest = _targets(r)
                lam = np.array([dict(r["fixed"])[t] for t in full]) if given else None
                key = (r["decision_month"], r["window"])
                tail = tuple(r[c] for c in extra)
                if full:
                    got = forecast(_matrix(r["predictors"]), y, np.asarray(r["current"]), np.asarray(r["labels"]), np.asarray(r["next_p"]), s, lam)
                    out += [(*key, m, full[j], *v, *tail) for m, j, *v in got]
                out += [(*key, m, t, None, None, "none", None, None, None, "none", "missing_history", "a_target_has_no_return", *tail) for m in s.models for t in rest]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FORECAST_SCHEMA.split(", ")] + extra)

    kinds = dict(states.dtypes)
    return data.mapInPandas(run, FORECAST_SCHEMA + "".join(f", {c} {kinds[c]}" for c in extra))


def forward_errors(states: DataFrame, returns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(decision_month, ticker, lambda, mse, months): mean squared error over a decision's inner windows of the final ridge forecast for every penalty."""
    data = with_returns(states, returns)

    def run(batches):
        lams = np.asarray(s.lambdas)
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                y, full, _ = _targets(r)
                if not full:
                    continue
                x, query, p = _matrix(r["predictors"]), np.asarray(r["current"]), np.asarray(r["next_p"])
                total = np.zeros((len(lams), len(full)))
                for k, _, _, _, got in by_regime(x, y, np.asarray(r["labels"]), s, lambda u, v: ridge_predictions(u, v, query, lams)):
                    total = total + p[k] * got
                out += [(r["decision_month"], r["window"], t, float(lams[i]), float(total[i, j])) for i in range(len(lams)) for j, t in enumerate(full)]
            yield pd.DataFrame(out, columns=["decision_month", "month", "ticker", "lambda", "value"])

    tried = data.mapInPandas(run, "decision_month string, month string, ticker string, lambda double, value double")
    seen = tried.join(returns, ["month", "ticker"])
    return seen.groupBy("decision_month", "ticker", "lambda").agg(F.avg(F.pow(F.col("value") - F.col("r"), 2)).alias("mse"), F.count("*").alias("months"))


def forward_lambdas(errors: DataFrame, months: int = 24) -> DataFrame:
    """(decision_month, ticker, lambda): least error over all `months` inner months; a penalty that misses a month can't be chosen."""
    return N.least_error(errors.filter(F.col("months") == months), ["decision_month", "ticker"], "lambda", "mse")


def usable_selections(selections: DataFrame, ledger: DataFrame) -> DataFrame:
    """Selections (decision_month, ticker, lambda, selection_end_at) whose evidence ended before the decision (ledger: decision_month, decision_at)."""
    return selections.join(ledger.select("decision_month", "decision_at"), "decision_month").filter(F.col("selection_end_at") < F.col("decision_at")).drop("decision_at")


def match_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(decision_month, regime, previous_regime, chain, cost, status): regimes of each window matched to those of the window before.

    Centers are compared in units of the series, divided by the scales of the later window, over the series both
    hold; regime 0 stays 0. Windows without a common series start new chains ('disconnected'). Chains follow the
    windows in order, which the calendar bounds.
    """
    by = list(by)
    kinds = dict(states.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before, chains = [], None, {}
        for r in pdf.sort_values("decision_month").to_dict("records"):
            st = {k: np.asarray(r[k]) for k in ("mean", "scale", "center")} | {"components": _matrix(r["components"])}
            pts = pd.DataFrame(inverse_features(st, np.vstack([_matrix(r["stage1"])[:1], _matrix(r["centers"])])), columns=list(r["columns"]))
            scale = pd.Series(st["scale"], index=list(r["columns"]))
            common = [c for c in pts.columns if before is not None and c in before.columns]
            if not common:
                mapping, cost, status = list(range(len(pts))), 0.0, "first" if before is None else "disconnected"
                chains = {k: f"{r['decision_month']}-R{k}" for k in range(len(pts))}
            else:
                best, cost = N.match_centers((before[common] / scale[common]).to_numpy()[1:], (pts[common] / scale[common]).to_numpy()[1:])
                mapping, status = [0, *(b + 1 for b in best)], "matched"
                chains = {k: chains[mapping[k]] for k in range(len(pts))}
            out += [(*[r[c] for c in by], r["decision_month"], k, None if status != "matched" else mapping[k], chains[k], cost, status) for k in range(len(pts))]
            before = pts
        return pd.DataFrame(out, columns=[*by, "decision_month", "regime", "previous_regime", "chain", "cost", "status"])

    schema = "".join(f"{c} {kinds[c]}, " for c in by) + "decision_month string, regime int, previous_regime int, chain string, cost double, status string"
    return states.groupBy(*by).applyInPandas(run, schema)


def state_rows(states: DataFrame) -> DataFrame:
    """(decision_month, window, position, base_month, label): the memberships of every window as rows."""
    return states.select(*KEYS, F.posexplode(F.arrays_zip("fit_months", "labels")).alias("position", "z")).select(*KEYS, "position", F.col("z.fit_months").alias("base_month"), F.col("z.labels").alias("label"))


def probability_rows(states: DataFrame) -> DataFrame:
    """(decision_month, window, regime, current_probability, next_probability) as rows."""
    return states.select(*KEYS, F.posexplode(F.arrays_zip("current_p", "next_p")).alias("regime", "z")).select(*KEYS, "regime", F.col("z.current_p").alias("current_probability"), F.col("z.next_p").alias("next_probability"))


def full_sample(panel: DataFrame, s: Settings = Settings(), most: int = 10) -> DataFrame:
    """The ex-post study of one panel (base_month, series, y, grp): rows of kind 'month' (label, mixture_label, p ARRAY), 'elbow' (k, value) and 'explained' (k, value).

    One partition of all months, the Euclidean objective for 1..most clusters, soft memberships, and a Gaussian
    mixture aligned with the labels. A single group, bounded by the calendar and the panel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, groups = _wide(pdf)
        months = list(range(int(wide.index.min()), int(wide.index.max()) + 1))
        f = fit_features(wide, months, groups, s)
        x = f["scores"]
        labels, _, stage1, centers = N.two_stage_centers(x, s.k, s.seed, s.starts)
        means, resp = N.gaussian_mixture(x, labels)
        best, _ = N.match_centers(np.array([x[labels == r].mean(axis=0) for r in range(int(labels.max()) + 1)]), means)
        mixture = np.asarray(best)[resp.argmax(axis=1)]
        rows = [("month", _name(m), None, None, int(labels[i]), int(mixture[i]), regime_probabilities(x[i], stage1, centers).tolist()) for i, m in enumerate(months)]
        rows += [("elbow", None, k, N.kmeans(x, k, False, s.seed, 5)[2], None, None, None) for k in range(1, min(most, len(x)) + 1)]
        rows += [("explained", None, k + 1, float(v), None, None, None) for k, v in enumerate(f["ratio"])]
        return pd.DataFrame(rows, columns=["kind", "month", "k", "value", "label", "mixture_label", "p"])

    return panel.select("base_month", F.col("series").cast("string").alias("series"), "y", "grp").groupBy().applyInPandas(run, "kind string, month string, k int, value double, label int, mixture_label int, p array<double>")
