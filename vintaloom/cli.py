"""Command line: check datasets, run backtests, suites or single queries into checked run folders, verify and report. Exit codes: 0 done, 2 wrong arguments or configuration, 3 a run that failed, 4 a verification that failed."""

from __future__ import annotations

import argparse
import json
import sys

from .operators.constraints import ContractError
from .plans import engine, models, panels, problems, streams
from .session import get_session, ship
from .sources import datasets
from .sources.config import load_config
from .sources.sinks import RunFolder


def catalog() -> dict:
    return {name: f for m in (problems, panels, models, streams) for name, f in m.QUERIES.items()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vintaloom")
    sub = p.add_subparsers(dest="verb", required=True)
    data = sub.add_parser("data").add_subparsers(dest="action", required=True)
    check = data.add_parser("validate")
    check.add_argument("--config", required=True)
    take = data.add_parser("accept")
    take.add_argument("--config", required=True)
    take.add_argument("--provider", required=True, choices=(datasets.PRICES, datasets.MACRO, datasets.INDICATOR))
    take.add_argument("--source", required=True)
    run = sub.add_parser("run")
    run.add_argument("--output", required=True)
    run.add_argument("--config")
    run.add_argument("--data")
    run.add_argument("--queries", nargs="+")
    run.add_argument("--smoke", action="store_true")
    suite = sub.add_parser("suite")
    suite.add_argument("--config", required=True)
    suite.add_argument("--output", required=True)
    suite.add_argument("--smoke", action="store_true")
    sub.add_parser("verify").add_argument("--run", required=True)
    report = sub.add_parser("report")
    report.add_argument("--run", required=True)
    report.add_argument("--output")
    sub.add_parser("list")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if a.verb == "list":
        print(*sorted(catalog()), sep="\n")
        return 0
    if a.verb == "run" and not (a.config or (a.data and a.queries)):
        print("run needs --config, or --data and --queries", file=sys.stderr)
        return 2
    config = None
    if getattr(a, "config", None):
        try:
            config = load_config(a.config)
        except (ContractError, OSError) as e:
            print(e, file=sys.stderr)
            return 2
    spark = get_session()
    ship(spark)
    if a.verb in ("verify", "report"):
        return _finished(spark, a)
    if a.verb == "run" and not config:
        return _queries(spark, a)
    try:
        if a.verb == "data":
            if a.action == "validate":
                out = datasets.validate_all(spark, config)
            elif a.provider == datasets.PRICES:
                out = datasets.accept_prices(spark, config.data.root, a.source, config.data.tickers)
            elif a.provider == datasets.MACRO:
                out = datasets.accept_macro(config.data.root, a.source)
            else:
                out = datasets.accept_indicator(spark, config.data.root, a.source)
        else:
            out = (engine.run if a.verb == "run" else engine.suite)(spark, config, a.output, a.smoke)
    except Exception as e:  # noqa: BLE001 - whatever ended it is reported
        print(e, file=sys.stderr)
        return 3
    print(json.dumps(out, sort_keys=True, default=str))
    return 0


def _queries(spark, a) -> int:
    known = catalog()
    unknown = [q for q in a.queries if q not in known]
    if unknown:
        print(f"unknown queries: {unknown}", file=sys.stderr)
        return 2
    folder = RunFolder(a.output, a.output.rstrip("/").rpartition("/")[2], {"data": a.data, "queries": a.queries})
    try:
        for q in a.queries:
            df = known[q](spark, a.data)
            folder.write(q, df, df.columns, [], nullable=df.columns)
    except Exception as e:  # noqa: BLE001 - the run's record keeps whatever ended it
        folder.close(str(e)[:2000])
        print(e, file=sys.stderr)
        return 3
    folder.close()
    return 0


def _finished(spark, a) -> int:
    try:
        manifest = RunFolder.verify(spark, a.run)
        if a.verb == "verify" and "states" in manifest["tables"]:
            out = engine.verify(spark, a.run)
            print(json.dumps(out, sort_keys=True))
            return 0 if out["status"] == "succeeded" else 4
        if a.verb == "report" and a.output:
            print(engine.report(spark, a.run, a.output))
            return 0
    except (ContractError, OSError, KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 4
    if a.verb == "report":
        print(f"# {manifest['run_id']}\n\n| table | rows |\n|-|-|")
        print(*[f"| {n} | {t['rows']} |" for n, t in sorted(manifest["tables"].items())], sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
