"""The command line and the report sinks."""

from __future__ import annotations

import zipfile
from xml.etree import ElementTree

import pytest

from quantlake.cli import main
from quantlake.sources import sinks
from tests.test_storage import Fake


def test_verbs(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "lake")]
    assert main([*root, "sync", "--dataset", "nothing"], spark) == 2
    assert main([*root, "sync", "--dataset", "daily", "--start", "2024-13-01"], spark) == 2
    assert main([*root, "sync", "--dataset", "daily"], spark) == 2
    assert main([*root, "sync", "--dataset", "daily", "--start", "2024-01-01", "--end", "2024-01-02"], spark, Fake(2)) == 0
    assert main([*root, "init-db"], spark) == 0
    assert main([*root, "validate", "--dataset", "daily"], spark) == 0
    assert main([*root, "validate", "--dataset", "moneyflow"], spark) == 1
    assert main([*root, "status"], spark) == 0 and '"status": "success"' in capsys.readouterr().out
    assert main([*root, "consolidate-bronze", "--dataset", "daily"], spark) == 0
    assert main([*root, "repair-security-codes", "--dataset", "daily"], spark) == 0 and "daily\t2\t2\t0" in capsys.readouterr().out
    phased = [*root, "sync-phased", "--dataset", "daily", "--start", "20240101", "--end", "20240102", "--checkpoint", str(tmp_path / "c.json")]
    assert main([*phased, "--dry-run"], spark, Fake()) == 0 and "daily:20240101:20240101" in capsys.readouterr().out
    assert main(phased, spark, Fake(fail=True)) == 1 and main([*phased, "--bronze-only"], spark, Fake()) == 0


def test_settings_of_a_file(spark, tmp_path, capsys):
    at = tmp_path / "settings.json"
    at.write_text('{"data_root": "lake", "default_start_date": "20240101", "default_end_date": "20240102", "datasets": {"adj_factor": false}}')
    assert main(["--config", str(at), "sync-phased", "--group", "market", "--dry-run"], spark, Fake()) == 0
    out = capsys.readouterr().out
    assert "daily:20240102:20240102" in out and "adj_factor" not in out
    assert main(["--config", str(tmp_path / "none.json"), "status"], spark) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.5), ("a", None)], "k string, v double")
    sinks.write_csv(df, tmp_path / "r.csv", ["k"])
    assert (tmp_path / "r.csv").read_text(encoding="utf-8").startswith(sinks.BOM + "k,v")
    assert sinks.read_csv(spark, tmp_path / "r.csv").count() == 2
    with pytest.raises(ValueError, match="at most 1 rows"):
        sinks.write_csv(df, tmp_path / "x.csv", most=1)
    assert not (tmp_path / "x.csv").exists()
    nav = spark.createDataFrame([(s, d, v) for s, k in (("a<b", 1.0), ("c", 2.0)) for d, v in (("20240101", k), ("20240102", k * 1.1), ("20240103", None))], "s string, d string, v double")
    sinks.line_chart(nav, tmp_path / "nav.svg", "d", "v", "s", "Net & gross")
    picture = ElementTree.parse(tmp_path / "nav.svg").getroot()
    assert len(picture.findall("{*}polyline")) == 2 and "Net & gross" in "".join(picture.itertext())
    sinks.bundle([tmp_path / "r.csv", tmp_path / "nav.svg"], tmp_path / "all.zip")
    assert zipfile.ZipFile(tmp_path / "all.zip").namelist() == ["nav.svg", "r.csv"]
    (tmp_path / "all.zip").unlink()
    assert sinks.markdown(df.orderBy("k")).splitlines()[2] == "| a |  |"
    before = sinks.snapshot([tmp_path / "r.csv", tmp_path / "m.json"])
    sinks.write_json({"run": sinks.run_id({"a": 1})}, tmp_path / "m.json")
    assert sinks.changed(before, sinks.snapshot([tmp_path / "r.csv", tmp_path / "m.json"])) == [(str(tmp_path / "m.json"), "added")]
    assert sinks.run_id({"a": 1, "b": 2}) == sinks.run_id({"b": 2, "a": 1}) != sinks.run_id({"a": 2})
