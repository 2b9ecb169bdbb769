"""Raw file sources, layers and streaming twins."""

import datetime as dt

from pyspark.sql import functions as F

from panelspan.plans import raw
from panelspan.sources import files, layers
from panelspan.streaming import revisions
from tests.conftest import rows

# fixed values: the header lines of both exports; the rows are made up
SCADA = """# An export
#
# Turbine: Unit 1
# Time zone: UTC
# Date and time,Power (kW),Wind speed (m/s),Blade (°)
2024-01-01 00:00:00,100,8.0,
2024-01-01 00:00:00,,8.2,0.9

# a remark
2024-01-01 00:10:00,110,8.4,1
"""
STATUS = """# Status export
#
# Unit Meter production: NaN kWh
Timestamp start,Timestamp end,Duration,Status,Code,Message,Comment,Service contract category,IEC category,Global contract category,Custom contract category
2024-01-01 00:10:00,,00:10:00,Communication,9997,"Data, missing",,External,Warning,,
"""


def test_banner_tables(spark, tmp_path):
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "Turbine_Data_Unit_1_2024-01-01_-_2024-12-31_7.csv").write_text(SCADA)
    (folder / "other.csv").write_text("# Device: Meter\n# Device type: Grid Meter\n# Date and time,Energy (kWh)\n2024-01-01 00:00:00,5\n")
    got = rows(files.read_banner_tables(spark, str(folder)), "source_file", "source_row")
    assert [(r["turbine"], r["device"], r["Power (kW)"], r["Blade (°)"], r["Energy (kWh)"]) for r in got] == [
        ("Unit 1", None, "100", None, None), ("Unit 1", None, None, "0.9", None), ("Unit 1", None, "110", "1", None), (None, "Meter", None, None, "5"),
    ]
    assert got[0]["source_file"].startswith("set/Turbine_Data")
    facts = files.file_name_facts(files.list_files(spark, str(folder)))
    assert rows(facts.filter("kind is not null"))[0]["entity"] == "Unit 1"
    assert files.release_of(facts, {"new": "2024-12-31"}) == "new"


def test_status_log_without_turbine(spark, tmp_path):
    (tmp_path / "s.csv").write_text(STATUS)
    r = files.read_status_logs(spark, str(tmp_path / "s.csv")).first()
    assert (r["asset_id"], r["asset_type"], r["turbine_id"], r["Message"], r["end_ts"]) == ("Unit Meter", "asset", "Unit Meter", "Data, missing", None)


def test_latin_fallback_and_day_clock(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("TurbID,Day,Tmstamp,Wspd,n°\n1,1,00:00,NaN,é\n1,1,00:10,5,x\n".encode("latin-1"))
    assert [r["n°"] for r in rows(files.read_csv_text(spark, str(p)), "Tmstamp")] == ["é", "x"]
    got = files.read_day_clock(spark, str(p), ["Wspd"])
    assert [(r["timestamp"], r["Wspd"]) for r in rows(got, "clock")] == [(dt.datetime(2020, 5, 1), None), (dt.datetime(2020, 5, 1, 0, 10), 5.0)]
    assert files.time_audit(got).first()["passed"] is False


def test_station_tables_order(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.csv").write_text(f"TimeStamp,StationId,v\n2024-01-01 00:00:00,1,{n}\n")
    got = rows(files.read_station_tables(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]), "__source_file_idx")
    assert [r["v"] for r in got] == ["a", "b"]


def test_layers(spark, tmp_path):
    df = layers.aligned(spark.range(2).withColumn("x", F.lit("7")), {"x": "int", "gone": "string"})
    layers.write(df.limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["x", "gone"]
    layers.write_report(spark, {"b": 1, "a": 2}, str(tmp_path / "r"))
    assert layers.read_report(spark, str(tmp_path / "r")) == {"a": 2, "b": 1}
    assert layers.status(None, "x")[0] == "missing" and layers.status("x", "x")[0] == "fresh" and layers.status("x", "y")[0] == "stale"
    assert layers.fingerprint({"a": 1, "b": 2}) == layers.fingerprint({"b": 2, "a": 1})
    listing = files.list_files(spark, str(tmp_path / "t"))
    assert layers.source_fingerprint(listing).first()[0] == layers.source_fingerprint(listing.orderBy(F.desc("path"))).first()[0]


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_equal_batches(spark, sf):
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(sf + "/events*.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    drain(revisions.latest(stream, ["user_id"], "ts", ["value"]), "latest", "complete")
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, revisions.latest(batch, ["user_id"], "ts", ["value"]).collect()))
    drain(revisions.running_report(stream, "event_type", "value"), "report", "complete")
    assert spark.table("report").agg(F.sum("row_count")).first()[0] == batch.count()
    drain(revisions.bucket_means(stream, "event_type", "ts", "value", 60, "1 hour"), "buckets", "append")
    whole = revisions.bucket_means(batch, "event_type", "ts", "value", 60, "1 hour")
    got = {(r[0], r[1]): r[3] for r in spark.table("buckets").collect()}
    want = {(r[0], r[1]): r[3] for r in whole.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    drain(revisions.deduplicated(stream, ["event_id"], "ts", "1 hour"), "once", "append")
    assert spark.table("once").count() == batch.select("event_id").distinct().count()


def test_status_logs_are_one_file_an_asset(spark, tmp_path):
    """Partitions that stay apart: banner and body, which were dealt before they met, must be dealt together."""
    events = spark.range(500).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") >= 0, F.col("id") % 20).alias("user_id"), F.lit("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    small = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = files.read_status_logs(spark, raw.status_logs(spark, str(tmp_path))).select("source_file", "asset_id", "Code").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r["source_file"] for r in got}) == 5
    assert {(r["asset_id"], int(r["Code"])) for r in got} == {(f"Unit {i % 5}", i) for i in range(500)}
