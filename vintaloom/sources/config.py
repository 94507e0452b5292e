"""Run configurations: TOML files with fixed sections, strict types and known keys only."""

from __future__ import annotations

import re
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from ..operators import numeric as N
from ..operators.constraints import ContractError
from ..operators.portfolio import SIZES, SIZINGS
from ..operators.windows import Settings, sensitivity_variants

MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


@dataclass(frozen=True)
class Data:
    root: str = "data"
    tickers: tuple = ("SPY", "XLB", "XLE", "XLF", "XLI", "XLK", "XLP", "XLU", "XLV", "XLY")
    fixed_vintage: str = "2023-02"
    start_date: str = "1993-01-01"
    end_date: str = "2026-09-16"
    yahoo_dataset_id: str = ""
    fred_dataset_id: str = ""
    nber_dataset_id: str = ""
    yahoo_source: str = ""
    fred_source: str = ""
    retry_delays: tuple = (2.0, 5.0, 10.0)
    timeout_seconds: float = 60.0


@dataclass(frozen=True)
class Research:
    profile: str = "vintage_lagged"
    start_month: str = "2003-02"
    end_month: str = "2022-12"
    train_months: int = 48
    lag_months: int = 2
    missing_rate: float = 0.2
    ffill_limit: int = 2
    pca_variance: float = 0.95
    k_normal: int = 5
    n_init: int = 20
    max_iter: int = 300
    tol: float = 1e-6
    seed: int = 0
    lambda_min: float = 1e-4
    lambda_max: float = 1e4
    lambda_count: int = 41
    min_regime_samples: int = 6
    fallback: str = "pooled"
    validation: str = "loo"
    cov_shrink: float = 0.1
    cov_eps: float = 1e-8
    tau: float = 0.05
    omega_scale: float = 1.0
    delta: float = 3.0
    models: tuple = ("naive", "ridge", "bl", "mvo")
    strategies: tuple = SIZINGS
    selection_sizes: tuple = SIZES


@dataclass(frozen=True)
class Portfolio:
    transaction_cost_bps: float = 0.0
    borrow_rate: float = 0.0
    financing_rate: float = 0.0
    cash_rate: float = 0.0
    vol_target: float = 0.1
    vol_lookback: int = 36
    gross_cap: float = 2.0
    main_table_scaled: bool = False


@dataclass(frozen=True)
class Suite:
    control_repetitions: int = 100
    bootstrap_repetitions: int = 1000
    bootstrap_block_months: int = 12
    bootstrap_seed: int = 0
    bootstrap_sensitivity_blocks: tuple = (6, 24)
    auxiliary_seed: int = 1
    sensitivity_variants: tuple = tuple(sensitivity_variants())
    representative_strategy: str = "lo"
    representative_size: int = 2


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    research: Research = field(default_factory=Research)
    portfolio: Portfolio = field(default_factory=Portfolio)
    suite: Suite = field(default_factory=Suite)
    output_root: str = "runs"

    def settings(self) -> Settings:
        r = self.research
        return Settings(
            r.train_months, r.lag_months, r.missing_rate, r.ffill_limit, r.pca_variance, r.k_normal, r.seed, r.n_init, r.min_regime_samples, r.fallback, r.cov_shrink, r.cov_eps, r.tau, r.omega_scale, r.delta,
            N.lambda_grid(r.lambda_min, r.lambda_max, r.lambda_count), tuple(r.models),
        )

    def costs(self) -> dict:
        p = self.portfolio
        return {"cost_bps": p.transaction_cost_bps, "borrow": p.borrow_rate, "financing": p.financing_rate, "cash_rate": p.cash_rate}

    def record(self) -> dict:
        return asdict(self)


def _typed(kind: type, name: str, value: object, default: object) -> object:
    want = type(default)
    if want is tuple and isinstance(value, list):
        inner = {type(v) for v in default}
        if any(type(v) not in inner for v in value):
            raise ContractError(f"{kind.__name__}.{name}: items must be {sorted(t.__name__ for t in inner)}")
        return tuple(value)
    if want is float and type(value) is int:
        return float(value)
    if type(value) is not want:
        raise ContractError(f"{kind.__name__}.{name} must be {want.__name__}, not {type(value).__name__}")
    return value


def _section(kind: type, raw: object):
    if not isinstance(raw, dict):
        raise ContractError(f"{kind.__name__} must be a table")
    known = {f.name: getattr(kind(), f.name) for f in fields(kind)}
    if unknown := sorted(set(raw) - set(known)):
        raise ContractError(f"{kind.__name__}: unknown keys {unknown}")
    return kind(**{k: _typed(kind, k, v, known[k]) for k, v in raw.items()})


def validate(c: Config) -> Config:
    """c itself, or ContractError naming every rule it breaks."""
    d, r, p, s = c.data, c.research, c.portfolio, c.suite
    distinct = lambda xs: len(set(xs)) == len(xs) > 0
    rules = {
        "tickers are distinct": distinct(d.tickers),
        "dataset ids are SHA-256 or empty": all(re.fullmatch("([0-9a-f]{64})?", x) for x in (d.yahoo_dataset_id, d.fred_dataset_id, d.nber_dataset_id)),
        "months are yyyy-MM": all(MONTH.fullmatch(m) for m in (d.fixed_vintage, r.start_month, r.end_month)),
        "months are in order": r.start_month <= r.end_month, "dates are in order": d.start_date < d.end_date,
        "at most three delays, none negative": len(d.retry_delays) <= 3 and all(x >= 0 for x in d.retry_delays), "the timeout is positive": d.timeout_seconds > 0,
        "profile is known": r.profile in ("fixed_snapshot", "vintage_lagged"), "48 training months": r.train_months == 48, "lag is 1, 2 or 3": r.lag_months in (1, 2, 3),
        "gaps": 0 <= r.missing_rate < 1 and 0 <= r.ffill_limit <= 2, "variance share": 0 < r.pca_variance <= 1, "five normal regimes": r.k_normal == 5,
        "starts, iterations, tolerance and seed": r.n_init > 0 and r.max_iter > 0 and r.tol > 0 and r.seed >= 0, "penalties": 0 < r.lambda_min <= r.lambda_max and r.lambda_count >= 2,
        "fallback": r.min_regime_samples >= 2 and r.fallback in ("pooled", "regime_mean"), "validation": r.validation in ("loo", "blocked"),
        "covariance and views": 0 <= r.cov_shrink <= 1 and min(r.cov_eps, r.tau, r.omega_scale, r.delta) > 0,
        "models": distinct(r.models) and set(r.models) <= {"naive", "ridge", "bl", "mvo"}, "strategies": distinct(r.strategies) and set(r.strategies) <= set(SIZINGS), "sizes": distinct(r.selection_sizes) and set(r.selection_sizes) <= set(SIZES),
        "costs aren't negative": min(p.transaction_cost_bps, p.borrow_rate, p.financing_rate) >= 0, "volatility scaling": p.vol_target > 0 and 2 <= p.vol_lookback <= r.train_months and p.gross_cap > 0,
        "suite counts are positive": min(s.control_repetitions, s.bootstrap_repetitions, s.bootstrap_block_months) > 0, "suite seeds": s.bootstrap_seed >= 0 and s.auxiliary_seed >= 0,
        "block lengths": distinct(s.bootstrap_sensitivity_blocks) and min(s.bootstrap_sensitivity_blocks) > 0, "variants": distinct(s.sensitivity_variants) and set(s.sensitivity_variants) <= set(sensitivity_variants()),
        "representative strategy": s.representative_strategy in r.strategies and s.representative_size in r.selection_sizes,
    }
    broken = [name for name, ok in rules.items() if not ok]
    if broken:
        raise ContractError(f"configuration breaks: {broken}")
    return c


def load_config(path: str) -> Config:
    """The configuration of a TOML file; relative folders are taken from the file's own."""
    with open(path, "rb") as f:
        try:
            raw = tomllib.load(f)
        except tomllib.TOMLDecodeError as e:
            raise ContractError(f"{path}: {e}") from e
    sections = {"data": Data, "research": Research, "portfolio": Portfolio, "suite": Suite}
    if unknown := sorted(set(raw) - set(sections) - {"output_root"}):
        raise ContractError(f"unknown sections {unknown}")
    parts = {name: _section(kind, raw.get(name, {})) for name, kind in sections.items()}
    base = Path(path).resolve().parent
    parts["data"] = Data(**(asdict(parts["data"]) | {"root": str((base / parts["data"].root).resolve())}))
    return validate(Config(**parts, output_root=str((base / str(raw.get("output_root", "runs"))).resolve())))
