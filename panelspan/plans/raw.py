"""Raw exports made from the driver's tables, for the queries that read files: written to the shared folder, read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspan.plans.views import table
from panelspan.session import scratch_path
from panelspan.sources.files import STATUS_COLUMNS


def text_files(lines: DataFrame, label: str) -> str:
    """Lines (file, line_no, line) as one text file each; the path pattern that finds them.

    Under its new name no earlier deal counts as one by file: a union of parts that were each dealt by file would pass
    for one, without a shuffle of its own, and the parts of a file end in several when their partitions are coalesced apart.
    """
    path = scratch_path(lines.sparkSession, label)
    lines.withColumn("file", F.coalesce("file", F.lit(""))).repartition("file").sortWithinPartitions("file", "line_no").select("file", "line").write.partitionBy("file").text(path)
    return f"{path}/*/*.txt"


def csv_files(rows: DataFrame, label: str, encoding: str = "UTF-8") -> str:
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("header", True).option("encoding", encoding).csv(path)
    return path


def _with_banner(body: DataFrame, banner: list) -> DataFrame:
    """Body lines (file, line_no from 0, line) below banner lines, which are columns over file."""
    n = len(banner)
    head = body.select("file").distinct().select("file", F.posexplode(F.array(*banner)).alias("line_no", "line"))
    return head.unionByName(body.withColumn("line_no", F.col("line_no") + n))


def banner_exports(spark: SparkSession, sf_dir: str) -> str:
    """events as one banner table a type; those of errors have a column less, and each has a blank line and a remark."""
    e = table(spark, sf_dir, "events")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.when(F.col("event_type") == "error", F.concat_ws(",", at, F.col("value").cast("string"))).otherwise(F.concat_ws(",", at, F.col("value").cast("string"), F.col("user_id").cast("string")))
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    body = e.select(F.col("event_type").alias("file"), n.alias("line_no"), line.alias("line"))
    header = F.when(F.col("file") == "error", F.lit("# Date and time,Power (kW)")).otherwise(F.lit("# Date and time,Power (kW),Wind speed (m/s)"))
    return text_files(_with_banner(body, [F.lit("# An export"), F.concat(F.lit("# Turbine: Unit "), "file"), header, F.lit(""), F.lit("# a remark")]), "banner")


def status_logs(spark: SparkSession, sf_dir: str) -> str:
    """events as status logs of five assets, named as turbines if even; errors stay open."""
    e = table(spark, sf_dir, "events").withColumn("file", (F.col("user_id") % 5).cast("string"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    end = F.when(F.col("event_type") == "error", F.lit("")).otherwise(at(F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + 600)))
    line = F.concat(at("ts"), F.lit(","), end, F.lit(",00:10:00,"), "event_type", F.lit(","), F.col("event_id").cast("string"), F.lit(',"Data, as said",,External,Warning,,'))
    body = e.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("event_id")) - 1).alias("line_no"), line.alias("line"))
    name = F.when(F.col("file").cast("int") % 2 == 0, F.concat(F.lit("# Turbine: Unit "), "file")).otherwise(F.concat(F.lit("# Unit "), "file", F.lit(" production: 5 kWh")))
    return text_files(_with_banner(body, [F.lit("# Status"), name, F.lit(",".join(STATUS_COLUMNS))]), "status")


def station_exports(spark: SparkSession, sf_dir: str) -> list[str]:
    """events as station tables, one a type: 21 stations in ten-minute steps, where several readings of a step are duplicates."""
    e = table(spark, sf_dir, "events")
    step = F.date_format(F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600) * 600), "yyyy-MM-dd HH:mm:ss")
    rows = e.select("event_type", F.concat(F.lit("S"), (F.col("user_id") % 22).cast("string")).alias("StationId"), step.alias("TimeStamp"), F.round("value").cast("string").alias("wtc_ActPower_mean"), (F.col("event_id") % 2).cast("string").alias("wtc_AcWindSp_mean"))
    return [csv_files(rows.filter(F.col("event_type") == t).drop("event_type"), f"station-{t}") for t in ("click", "error", "purchase", "signup", "view")]


def day_clock_export(spark: SparkSession, sf_dir: str) -> str:
    """lineitem as a day/clock panel of five entities: ten-minute steps by row, with readings out of every range."""
    li = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy((F.col("l_orderkey") % 5)).orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")) - 1
    r = li.select((F.col("l_orderkey") % 5 + 1).cast("string").alias("TurbID"), place.alias("p"), "l_quantity", "l_tax", "l_discount", "l_linenumber").filter("p < 288")
    clock = F.format_string("%02d:%02d", F.floor(F.col("p") % 144 / 6).cast("int"), (F.col("p") % 6 * 10).cast("int"))
    text = lambda c: c.cast("string")
    rows = r.select(
        "TurbID", (F.floor(F.col("p") / 144) + 1).cast("string").alias("Day"), clock.alias("Tmstamp"),
        text(F.col("l_quantity") / 5).alias("Wspd"), text(F.col("l_quantity") * 16 - 400).alias("Wdir"), text(F.col("l_linenumber") * 200.0 - 500).alias("Ndir"),
        text(F.col("l_tax") * 1200).alias("Pab1"), F.lit("0.5").alias("Pab2"), F.when(F.col("l_linenumber") == 3, "NaN").otherwise("1.0").alias("Pab3"),
        text(F.col("l_quantity") * 10 - 100).alias("Patv"),
    )
    return csv_files(rows, "day-clock")


#: The same rows in SQL: (TurbID, p, wspd, wdir, ndir, pab1, pab3, patv).
DAY_CLOCK_SQL = """
WITH raw AS (
  SELECT (l_orderkey % 5 + 1)::VARCHAR AS turbine_id, row_number() OVER (PARTITION BY l_orderkey % 5 ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey) - 1 AS p,
    l_quantity / 5 AS wspd, l_quantity * 16 - 400 AS wdir, l_linenumber * 200.0 - 500 AS ndir, l_tax * 1200 AS pab1, CASE WHEN l_linenumber <> 3 THEN 1.0 END AS pab3, l_quantity * 10 - 100 AS patv FROM lineitem
), d AS (
  SELECT *, TIMESTAMP '2020-05-01' + to_minutes(p * 10) AS timestamp, patv <= 0 AND wspd > 2.5 AS f1, pab1 > 89 AS f2, ndir < -720 OR ndir > 720 AS f3, wdir < -180 OR wdir > 180 AS f4 FROM raw WHERE p < 288
)"""
