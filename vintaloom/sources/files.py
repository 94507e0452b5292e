"""Scans of raw files: price and indicator CSVs, zipped vintages, strict JSON and content-addressed datasets."""

from __future__ import annotations

import hashlib
import io
import json
import math
import zipfile
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.constraints import ContractError

# The columns of a price file and the limits of an archive member.
PRICE_SCHEMA = "date string, open double, high double, low double, close double, adj_close double, volume double, dividends double, splits double, capital_gains double"
MAX_MEMBER, MAX_RATIO = 100_000_000, 1000


def read_prices(spark: SparkSession, paths: list[str], retrieved_at: str, closes: DataFrame | None = None) -> DataFrame:
    """Per-ticker CSV files as one table; the ticker is the file's name.

    Columns may come in any order, any case and with blanks; absent event columns become NULL. A session is
    final if its official close (closes: session, close_at; default 16:00 in New York) isn't later than retrieved_at.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8")
    out = None
    for path in paths:
        f = raw.csv(path)
        f = f.toDF(*[c.replace("﻿", "").strip().lower().replace(" ", "_").replace("stock_splits", "splits") for c in f.columns])
        f = f.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ContractError("no price files")
    names = [c.split()[0] for c in PRICE_SCHEMA.split(", ")][1:]
    missing = [c for c in ("date", *names[:6]) if c not in out.columns]
    if missing:
        raise ContractError(f"price files lack {missing}")
    out = out.select(F.substring("date", 1, 10).alias("session"), "ticker", *[(F.col(c).cast("double") if c in out.columns else F.lit(None).cast("double")).alias(c) for c in names])
    at = F.lit(retrieved_at).cast("timestamp")
    if closes is None:
        return out.withColumn("finalized", F.to_utc_timestamp(F.to_timestamp(F.concat("session", F.lit(" 16:00:00"))), "America/New_York") <= at).withColumn("retrieved_at", at)
    return out.join(closes, "session", "left").withColumn("finalized", F.coalesce(F.col("close_at") <= at, F.lit(False))).withColumn("retrieved_at", at).drop("close_at")


def read_indicator(spark: SparkSession, path: str) -> DataFrame:
    """(month, flag) of a two-column CSV of first-of-month dates and 0 or 1; months must be dense and unique."""
    raw = spark.read.option("header", True).csv(path)
    if len(raw.columns) != 2:
        raise ContractError("an indicator file has two columns")
    d = raw.toDF("date", "flag").select(F.substring("date", 1, 7).alias("month"), F.substring("date", 9, 2).alias("day"), F.col("flag").try_cast("double").cast("int").alias("flag"))
    n, months, lo, hi, bad = d.agg(F.count("*"), F.count_distinct("month"), F.min("month"), F.max("month"), F.count_if((F.col("day") != "01") | F.col("flag").isNull() | ~F.col("flag").isin(0, 1))).first()
    if bad or n != months or (n and (int(hi[:4]) * 12 + int(hi[5:]) - int(lo[:4]) * 12 - int(lo[5:]) + 1) != n):
        raise ContractError("an indicator holds 0 or 1 for every month from its first to its last")
    return d.select("month", "flag")


def month_of_name(name: Column) -> Column:
    """yyyy-MM out of a file name such as 2015-07.csv or macro_2015m7.csv; NULL if there is none."""
    y, m = F.regexp_extract(name, r"(\d{4})[-m](\d{1,2})", 1), F.regexp_extract(name, r"(\d{4})[-m](\d{1,2})", 2)
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0")))


def read_zipped_lines(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """Text lines of all CSV members of ZIP archives, in the shape of macro_raw_lines.

    Each archive is opened in one task. Members that leave the archive's folder, are links, repeat, or are
    larger than MAX_MEMBER or MAX_RATIO times their compressed size are refused.
    """

    def run(batches):
        for pdf in batches:
            for name, content, at in zip(pdf["path"], pdf["content"], pdf["modificationTime"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in safe_members(z):
                        if info.filename.lower().endswith(".csv"):
                            body = z.read(info).decode(encoding).splitlines()
                            yield pd.DataFrame({"feed_id": Path(name).stem, "file_name": info.filename, "received_at": at, "line_no": range(1, len(body) + 1), "line": body})

    out = spark.read.format("binaryFile").load(path).select("path", "content", "modificationTime").mapInPandas(run, "feed_id string, file_name string, received_at timestamp, line_no int, line string")
    return out.withColumn("vintage_month", month_of_name(F.col("file_name")))


def safe_members(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    seen, out = set(), []
    for info in z.infolist():
        p = PurePosixPath(info.filename)
        if p.is_absolute() or ".." in p.parts or "\\" in info.filename or info.filename in seen or (info.external_attr >> 16) & 0o170000 == 0o120000:
            raise ContractError(f"unsafe archive member {info.filename!r}")
        if info.file_size > MAX_MEMBER or info.file_size > MAX_RATIO * max(1, info.compress_size):
            raise ContractError(f"archive member {info.filename!r} is too large")
        seen.add(info.filename)
        if not info.is_dir():
            out.append(info)
    return out


def read_json(path: str) -> object:
    """A JSON document of finite numbers; NaN, Infinity and overflowing exponents are refused."""

    def number(text: str) -> float:
        x = float(text)
        if not math.isfinite(x):
            raise ContractError(f"{path}: {text} is not finite")
        return x

    def constant(text: str) -> None:
        raise ContractError(f"{path}: {text} is not JSON")

    return json.loads(Path(path).read_text("utf-8"), parse_float=number, parse_constant=constant)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def content_id(value: object) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def file_digest(path: Path) -> str:
    """SHA-256 of a file, read piece by piece."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def build_manifest(folder: str, provider: str) -> dict:
    """Sizes and hashes of all files of a dataset folder, and the dataset's id made from them."""
    root = Path(folder)
    files = [{"name": str(p.relative_to(root)), "size": p.stat().st_size, "sha256": file_digest(p)} for p in sorted(root.rglob("*")) if p.is_file() and p.name != "manifest.json"]
    return {"provider": provider, "files": files, "dataset_id": content_id({"provider": provider, "files": files})}


def verify_manifest(folder: str) -> dict:
    """The folder's manifest.json, or ContractError if any file was added, lost or changed."""
    stored = read_json(str(Path(folder) / "manifest.json"))
    if not isinstance(stored, dict) or any(stored.get(k) != v for k, v in build_manifest(folder, str(stored.get("provider"))).items()):
        raise ContractError(f"{folder} doesn't match its manifest")
    return stored


def resolve_dataset(root: str, provider: str, dataset_id: str | None = None) -> str:
    """The folder of a dataset by its id; without an id there must be exactly one (the latest is never guessed)."""
    found = sorted(p.name for p in (Path(root) / provider).iterdir() if p.is_dir()) if (Path(root) / provider).is_dir() else []
    if dataset_id is None and len(found) != 1:
        raise ContractError(f"{provider}: name one of {len(found)} datasets")
    if dataset_id is not None and dataset_id not in found:
        raise ContractError(f"{provider}: no dataset {dataset_id}")
    return str(Path(root) / provider / (dataset_id or found[0]))
