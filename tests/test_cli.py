"""The command line: layers are built once, found fresh, and found stale when their source changes."""

import datetime as dt

from panelspan import cli
from panelspan.sources.specs import dataset


def test_build_check_and_a_changed_source(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    start = dt.datetime(2024, 1, 1)
    cells = [("kelmarsh", e, start + dt.timedelta(minutes=10 * i), float(i)) for e in dataset("kelmarsh").entities for i in range(12)]
    obs = spark.createDataFrame(cells, "dataset string, turbine_id string, timestamp timestamp_ntz, target_kw double")
    obs.coalesce(1).write.parquet(f"{tmp_path}/obs")
    run = lambda command: cli.main([command, "kelmarsh", "--observations", f"{tmp_path}/obs", "--root", f"{tmp_path}/out", "--history", "30m", "--forecast", "20m"])
    said = lambda: [line.split(maxsplit=3)[1:3] for line in capsys.readouterr().out.splitlines()]

    assert run("check") == 1 and said() == [["gold", "missing"], ["task", "missing"]]
    assert run("build") == 0 and run("check") == 0 and said() == [["gold", "fresh"], ["task", "fresh"]]
    files = sorted(p.name for p in (tmp_path / "out/kelmarsh/gold_base/series").iterdir())
    assert run("build") == 0 and sorted(p.name for p in (tmp_path / "out/kelmarsh/gold_base/series").iterdir()) == files
    obs.limit(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/obs")
    assert run("check") == 1 and said() == [["gold", "stale"], ["task", "stale"]]


def test_bad_arguments():
    assert cli.main(["build", "nowhere"]) == 2
