import json
import zipfile

import pytest

from vintaloom import cli
from vintaloom.operators import drift
from vintaloom.operators.constraints import ContractError
from vintaloom.sources import files, sinks
from vintaloom.streaming import windows


def test_prices_and_indicator(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2023-01-03,100,101,99,100,100,5\n", "utf-8-sig")
    (tmp_path / "BBB.csv").write_text("Date,Close,Open,High,Low,Adj Close,Volume,Dividends\n2023-01-04,100,100,101,99,100,5,0.5\n")
    got = {r["ticker"]: r for r in files.read_prices(spark, [str(tmp_path / "AAA.csv"), str(tmp_path / "BBB.csv")], "2023-01-04 12:00:00").collect()}
    assert got["AAA"]["dividends"] is None and got["BBB"]["dividends"] == 0.5 and (got["AAA"]["finalized"], got["BBB"]["finalized"]) == (True, False)
    (tmp_path / "n.csv").write_text("d,v\n2020-01-01,0\n2020-02-01,1\n")
    assert files.read_indicator(spark, str(tmp_path / "n.csv")).count() == 2
    (tmp_path / "m.csv").write_text("d,v\n2020-01-01,0\n2020-03-01,1\n")
    with pytest.raises(ContractError):
        files.read_indicator(spark, str(tmp_path / "m.csv"))


def test_zipped_vintages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("x/2020-01.csv", "sasdate,A\nTransform:,2\n1/1/2020,5\n2/1/2020,6\n")
    t = drift.ingest(files.read_zipped_lines(spark, str(tmp_path / "feed.zip"))).collect()
    assert {(r["vintage_month"], r["base_month"], r["value"], r["tcode"]) for r in t} == {("2020-01", "2020-01", 5.0, 2), ("2020-01", "2020-02", 6.0, 2)}
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../2020-01.csv", "a")
    with zipfile.ZipFile(tmp_path / "bad.zip") as z, pytest.raises(ContractError):
        files.safe_members(z)


def test_json_and_manifests(tmp_path):
    for text in ('{"a": NaN}', '{"a": 1e999}'):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(ContractError):
            files.read_json(str(tmp_path / "x.json"))
    d = tmp_path / "p" / "one"
    d.mkdir(parents=True)
    (d / "f").write_text("1")
    (d / "manifest.json").write_text(json.dumps(files.build_manifest(str(d), "p")))
    assert files.verify_manifest(files.resolve_dataset(str(tmp_path), "p"))["provider"] == "p"
    (d / "f").write_text("2")
    with pytest.raises(ContractError):
        files.verify_manifest(str(d))
    (tmp_path / "p" / "two").mkdir()
    with pytest.raises(ContractError):
        files.resolve_dataset(str(tmp_path), "p")


def test_run_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    run = sinks.RunFolder(str(tmp_path / "r"), "r", {})
    run.write("t", df, ["k", "v"], ["k"], nullable=["v"])
    run.write("c", df.filter("k = 1"), ["k", "v"], ["k"], form="csv")
    for bad in (df, df.union(df).na.fill(0.0), df.na.fill(float("inf"))):
        with pytest.raises(ContractError):
            run.write("bad", bad, ["k", "v"], ["k"])
    run.close()
    assert set(sinks.RunFolder.verify(spark, str(tmp_path / "r"))["tables"]) == {"t", "c"}
    df.write.mode("append").parquet(str(tmp_path / "r" / "t"))
    with pytest.raises(ContractError):
        sinks.RunFolder.verify(spark, str(tmp_path / "r"))


def test_command_line(spark, small, tmp_path, capsys):
    out = str(tmp_path / "run")
    assert cli.main(["run", "--data", small, "--output", out, "--queries", "nope"]) == 2 and cli.main(["walk"]) == 2
    assert cli.main(["run", "--data", small, "--output", out, "--queries", "first_sessions"]) == 0
    assert cli.main(["report", "--run", out]) == 0 and "first_sessions" in capsys.readouterr().out
    assert cli.main(["verify", "--run", str(tmp_path / "none")]) == 4


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "e"))
    stream = windows.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert {key(r) for r in spark.table("w").collect()} == {key(r) for r in windows.event_windows(events, late=None).collect()}
