"""Content-addressed provider snapshots: accepting prepared ones, loading pinned ones, checking all of it offline."""

from __future__ import annotations

import csv
import io
import shutil
import sys
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.months import month_index
from ..operators import constraints as C, timing as T
from ..operators.constraints import ContractError
from . import files
from .sinks import publish

# The folders of the three providers below a data root, and the request that a price snapshot must state.
PRICES, MACRO, INDICATOR = "yahoo", "fred", "nber"
PRICE_REQUEST = {"auto_adjust": False, "actions": True}


def stage(root: str, provider: str) -> Path:
    """A new folder beside the provider's, to be filled and then published."""
    folder = Path(root) / "raw" / f".{provider}-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return folder


def publish_snapshot(staged: Path, root: str, provider: str, facts: dict) -> dict:
    """Write the manifest and give the folder its final name, its dataset id; an id that exists already is an error."""
    manifest = files.build_manifest(str(staged), provider) | {"python": sys.version.split()[0], "facts": facts}
    publish(str(staged / "manifest.json"), files.canonical_json(manifest).encode())
    target = Path(root) / "raw" / provider / manifest["dataset_id"]
    if target.exists():
        shutil.rmtree(staged)
        raise ContractError(f"{provider}: dataset {manifest['dataset_id']} exists already")
    target.parent.mkdir(parents=True, exist_ok=True)
    staged.rename(target)
    return manifest


def unfinished(root: str) -> list[str]:
    """Staged folders that were never published."""
    raw = Path(root) / "raw"
    return sorted(p.name for p in raw.iterdir() if p.name.startswith(".")) if raw.is_dir() else []


def resolve(root: str, provider: str, dataset_id: str = "") -> str:
    """The checked folder of a pinned dataset, or of the only one."""
    folder = files.resolve_dataset(str(Path(root) / "raw"), provider, dataset_id or None)
    if files.verify_manifest(folder)["dataset_id"] != Path(folder).name:
        raise ContractError(f"{provider}: the folder's name isn't its content")
    return folder


def accept_prices(spark: SparkSession, root: str, source: str, tickers: Sequence[str]) -> dict:
    """Publish a prepared folder of one CSV a ticker with manifest.json (tickers, parameters, fetched_at_utc), if its tickers and request are as agreed and its prices valid."""
    told = files.read_json(str(Path(source) / "manifest.json"))
    if list(told.get("tickers", [])) != list(tickers):
        raise ContractError("the snapshot's tickers differ")
    if wrong := {k: told.get("parameters", {}).get(k) for k, v in PRICE_REQUEST.items() if told.get("parameters", {}).get(k) != v}:
        raise ContractError(f"the snapshot's request differs: {wrong}")
    at = pd.to_datetime(told["fetched_at_utc"], format="%Y%m%dT%H%M%SZ").strftime("%Y-%m-%d %H:%M:%S")
    paths = [Path(source) / f"{t}.csv" for t in tickers]
    if missing := [p.name for p in paths if not p.is_file()]:
        raise ContractError(f"the snapshot lacks {missing}")
    prices = files.read_prices(spark, [str(p) for p in paths], at, official_closes(spark))
    check_prices(prices, tickers)
    staged = stage(root, PRICES)
    for p in [*paths, Path(source) / "manifest.json"]:
        shutil.copyfile(p, staged / (p.name if p.suffix == ".csv" else "source_manifest.json"))
    cover = prices.agg(F.min("session"), F.max("session"), F.count("*")).first()
    return publish_snapshot(staged, root, PRICES, {"retrieved_at": at, "tickers": list(tickers), "first_session": cover[0], "last_session": cover[1], "rows": cover[2]})


def official_closes(spark: SparkSession) -> DataFrame:
    """(session, close_at): closes of the New York exchange as UTC instants, with summer time and half days."""
    return T.exchange_sessions(spark).select("session", T.closing_time(F.col("session"), F.col("close_hour")).alias("close_at"))


def check_prices(prices: DataFrame, tickers: Sequence[str]) -> dict:
    """Counts of broken rules, all 0, or ContractError: key, tickers, rules of a final row, sessions of the calendar."""
    C.require_unique(prices, ["session", "ticker"])
    have = {r[0] for r in prices.select("ticker").distinct().limit(len(tickers) + 1).collect()}
    if have != set(tickers):
        raise ContractError(f"tickers are {sorted(have)}")
    rules = {k: v for k, v in C.price_rules().items() if k != "not_final"}
    broken = C.violations(prices, rules).first().asDict()
    foreign = prices.select("session").distinct().join(T.exchange_sessions(prices.sparkSession).select("session"), "session", "left_anti").count()
    if foreign or any(v for k, v in broken.items() if k != "n_rows"):
        raise ContractError(f"prices break rules: {broken}, {foreign} sessions off the calendar")
    return broken


def load_prices(spark: SparkSession, root: str, dataset_id: str = "") -> DataFrame:
    folder = resolve(root, PRICES, dataset_id)
    facts = files.read_json(f"{folder}/manifest.json")["facts"]
    return files.read_prices(spark, [f"{folder}/{t}.csv" for t in facts["tickers"]], facts["retrieved_at"], official_closes(spark))


def parse_macro(content: bytes, vintage: str) -> pd.DataFrame:
    """(base_month, series, value, tcode) of one vintage file under the strict contract.

    An error: no header, a repeated or empty name, no Transform line right below the header, a code outside 1 to 7, a date that
    isn't a first of a month, months that repeat or leave a gap, text or an infinite figure in a cell.
    """
    rows = [r for r in csv.reader(io.StringIO(content.decode("cp1252"))) if any(c.strip() for c in r)]
    fault = lambda what: ContractError(f"vintage {vintage}: {what}")
    if len(rows) < 3:
        raise fault("no header, code line and data")
    head, codes, body = rows[0], rows[1], rows[2:]
    names = head[1:]
    if len(set(names)) != len(names) or "" in names:
        raise fault("repeated or empty series name")
    if not codes[0].lower().startswith("transform") or len(codes) != len(head):
        raise fault("no line of transformation codes")
    try:
        tcode = [int(float(c)) for c in codes[1:]]
        months = pd.to_datetime([r[0] for r in body], format="mixed")
        cells = [[float(c) if c.strip() else None for c in r[1:]] for r in body]
    except ValueError as e:
        raise fault(str(e)) from e
    if not set(tcode) <= set(range(1, 8)):
        raise fault("a code outside 1 to 7")
    number = [m.year * 12 + m.month - 1 for m in months]
    if any(m.day != 1 for m in months) or number != list(range(number[0], number[0] + len(number))):
        raise fault("base months repeat, leave a gap or aren't firsts of a month")
    if any(len(r) != len(names) for r in cells) or any(v is not None and v in (float("inf"), float("-inf")) for r in cells for v in r):
        raise fault("a line of another width or an infinite figure")
    base = [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in number]
    return pd.DataFrame([(b, s, None if v is None or v != v else v, t) for b, r in zip(base, cells) for s, v, t in zip(names, r, tcode)], columns=["base_month", "series", "value", "tcode"])


def read_groups(z: zipfile.ZipFile) -> dict[str, int]:
    """Upper-cased series -> group from an archive's appendix files (columns group and fred, or series); a series with two groups is an error."""
    out: dict[str, int] = {}
    for info in files.safe_members(z):
        if "appendix" in info.filename.lower() and info.filename.lower().endswith(".csv"):
            for r in csv.DictReader(io.StringIO(z.read(info).decode("cp1252"))):
                r = {(k or "").strip().lower(): (v or "").strip() for k, v in r.items()}
                name, group = (r.get("fred") or r.get("series") or "").upper(), r.get("group", "")
                if name and group.isdigit():
                    if out.setdefault(name, int(group)) != int(group):
                        raise ContractError(f"series {name} has two groups")
    return out


def accept_macro(root: str, source: str) -> dict:
    """Publish a prepared folder of vintage archives (ZIP with one CSV a vintage and appendix files), if every vintage keeps the contract, no vintage occurs twice, months have no gap and every series has a group."""
    archives = sorted(Path(source).glob("*.zip"))
    seen: dict[str, str] = {}
    groups: dict[str, int] = {}
    series: set[str] = set()
    for path in archives:
        with zipfile.ZipFile(path) as z:
            for k, g in read_groups(z).items():
                if groups.setdefault(k, g) != g:
                    raise ContractError(f"series {k} has two groups")
            for info in files.safe_members(z):
                month = vintage_of(info.filename)
                if month and "appendix" not in info.filename.lower():
                    if month in seen:
                        raise ContractError(f"vintage {month} occurs twice")
                    seen[month] = path.name
                    series |= set(parse_macro(z.read(info), month)["series"])
    if not seen:
        raise ContractError("no vintage found")
    numbers = sorted(int(m[:4]) * 12 + int(m[5:]) for m in seen)
    if numbers != list(range(numbers[0], numbers[-1] + 1)):
        raise ContractError("vintages leave a gap")
    if lost := sorted(s for s in series if C.ALIASES.get(s, s).upper() not in groups):
        raise ContractError(f"series without a group: {lost}")
    staged = stage(root, MACRO)
    for p in archives:
        shutil.copyfile(p, staged / p.name)
    return publish_snapshot(staged, root, MACRO, {"vintages": sorted(seen), "series": len(series)})


def vintage_of(name: str) -> str | None:
    import re

    m = re.search(r"(\d{4})[-m](\d{1,2})", Path(name).name)
    return f"{m[1]}-{int(m[2]):02d}" if m and name.lower().endswith(".csv") else None


def load_macro(spark: SparkSession, root: str, dataset_id: str = "", lag: int = 2, vintage: str | None = None) -> DataFrame:
    """(vintage_month, base_month, series, value, tcode, macro_group, assumed_available_at) of a pinned snapshot, all vintages or one. Each archive is parsed in one task."""
    folder = resolve(root, MACRO, dataset_id)

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    groups = read_groups(z)
                    for info in files.safe_members(z):
                        month = vintage_of(info.filename)
                        if month and "appendix" not in info.filename.lower() and vintage in (None, month):
                            out = parse_macro(z.read(info), month)
                            yield out.assign(vintage_month=month, macro_group=[groups.get(C.ALIASES.get(s, s).upper()) for s in out["series"]])

    schema = "base_month string, series string, value double, tcode int, vintage_month string, macro_group int"
    rows = spark.read.format("binaryFile").load(f"{folder}/*.zip").select("content").mapInPandas(run, schema)
    return rows.select("vintage_month", "base_month", "series", "value", "tcode", "macro_group", T.assumed_available_at(F.col("vintage_month"), lag).alias("assumed_available_at"))


def accept_indicator(spark: SparkSession, root: str, source: str) -> dict:
    n = files.read_indicator(spark, source).count()
    staged = stage(root, INDICATOR)
    shutil.copyfile(source, staged / "indicator.csv")
    return publish_snapshot(staged, root, INDICATOR, {"months": n})


def load_indicator(spark: SparkSession, root: str, dataset_id: str = "") -> DataFrame:
    return files.read_indicator(spark, f"{resolve(root, INDICATOR, dataset_id)}/indicator.csv")


def indicator_for(indicator: DataFrame, months: DataFrame) -> DataFrame:
    """(month, flag) for every month asked for, or ContractError if one is missing."""
    j = months.select("month").distinct().join(indicator, "month", "left")
    if not j.filter("flag is null").isEmpty():
        raise ContractError("the indicator doesn't cover all months")
    return j


def returns_of(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """(month, ticker, r): from the first session of a month to that of the next, both with a final price above 0; no other date stands in."""
    firsts = T.first_sessions(sessions)
    good = prices.filter(F.col("finalized") & (F.col("adj_close") > 0) & (F.col("adj_close") < float("inf")))
    px = good.join(F.broadcast(firsts), "session").select(month_index(F.col("month")).alias("i"), "month", "ticker", "adj_close")  # one row a month
    nxt = px.select((F.col("i") - 1).alias("i"), "ticker", F.col("adj_close").alias("after"))
    return px.join(nxt, ["i", "ticker"]).select("month", "ticker", (F.col("after") / F.col("adj_close") - 1).alias("r"))


def feasible_start(returns: DataFrame, vintages: DataFrame, train: int, lag: int) -> str | None:
    """The first month for which every ticker has all training returns and a vintage of the lag is known."""
    r = returns.groupBy("ticker").agg(F.min(month_index(F.col("month"))).alias("a")).agg(F.max("a").alias("a")).first()
    v = vintages.agg(F.min(month_index(F.col("vintage_month")))).first()[0]
    if r["a"] is None or v is None:
        return None
    i = max(r["a"] + train + 1, v + lag)
    return f"{i // 12:04d}-{i % 12 + 1:02d}"


def validate_all(spark: SparkSession, config) -> dict:
    """Check every pinned dataset offline: manifests, prices, all vintages, indicator, returns of the range."""
    d, r = config.data, config.research
    prices = load_prices(spark, d.root, d.yahoo_dataset_id)
    quality = check_prices(prices, d.tickers)
    macro = load_macro(spark, d.root, d.fred_dataset_id, r.lag_months)
    returns = returns_of(prices, T.exchange_sessions(spark))
    n = returns.filter(F.col("month").between(r.start_month, r.end_month)).count()
    return {
        "prices": quality, "macro_vintages": macro.select("vintage_month").distinct().count(), "indicator_months": load_indicator(spark, d.root, d.nber_dataset_id).count(),
        "returns": n, "first_decision": feasible_start(returns, macro.select("vintage_month").distinct(), r.train_months, r.lag_months), "unfinished": unfinished(d.root),
    }
