"""The command line."""

import json

import pytest

from holdfast import __main__ as cli
from holdfast.sources import io

SF = "/root/testdata/sf0.001"


def test_splits_are_written(spark, tmp_path):
    config = {"orders": {"time": {"date": "o_orderdate", "groups": ["o_custkey", "o_orderpriority"]}, "random_grouped": {"key": "o_custkey", "fractions": {"train": 0.8, "val": 0.1, "test": 0.1}}}, "all_unified": {"time": {}}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    done = cli.write_splits(spark, f"{SF}/orders.parquet", f"{tmp_path}/out", config, None, [])
    assert sorted(p.rsplit("/", 1)[1] for p in done) == ["random_grouped", "time"]
    assert io.find_splits(spark, f"{tmp_path}/out/orders") == ["random_grouped", "time"]
    for p in done:
        assert sum(spark.read.parquet(f"{p}/{s}.parquet").count() for s in ("train", "val", "test")) == spark.read.parquet(f"{SF}/orders.parquet").count()
        assert json.loads((tmp_path / "out/orders" / p.rsplit("/", 1)[1] / "stats.json").read_text())["family"] in p


def test_lists(capsys):
    cli.main(["splits", "--list-splits"])
    assert capsys.readouterr().out.split() == ["random_grouped", "time"]
    cli.main(["query", "--list"])
    assert "spl_time_grouped" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        cli.main([])


def test_shared_folder_without_the_setting():
    from types import SimpleNamespace

    from holdfast.sources import shared

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(applicationId="app-x", master="local[4]"))
    assert shared.shared_dir(unset) == shared.shared_dir(unset) and shared.shared_dir(unset).startswith("file:///")
    given = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "hdfs://n/c/"), sparkContext=None)
    assert shared.shared_dir(given) == "hdfs://n/c"
