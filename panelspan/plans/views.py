"""The driver's tables seen as panels, intervals, registries and duplicate readings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: F401 (queries take Window from here)
from pyspark.sql import functions as F

from panelspan.functions import timeutil as T
from panelspan.operators import panel as P

HOURLY, HISTORY, FORECAST = 60, 24, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, minutes: int = HOURLY, entity: str = "event_type") -> DataFrame:
    """events as readings: the mean value of an entity in each bucket."""
    e = table(spark, sf_dir, "events").select(F.expr(entity).cast("string").alias("turbine_id"), T.floor_to("ts", minutes).alias("timestamp"), "value")
    return e.groupBy(F.lit("events").alias("dataset"), "turbine_id", "timestamp").agg(F.round(F.avg("value"), 6).alias("target_kw"))


def panel(spark: SparkSession, sf_dir: str, minutes: int = HOURLY, entity: str = "event_type", layout: str = "farm") -> DataFrame:
    return P.fill_grid(observations(spark, sf_dir, minutes, entity), None, minutes, layout)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as status intervals of a user: value minutes long, open-ended for errors."""
    e = table(spark, sf_dir, "events")
    end = F.when(F.col("event_type") != "error", F.timestamp_seconds(T.seconds("ts") + F.floor(F.col("value") * 60).cast("long")).cast("timestamp_ntz"))
    return e.select((F.col("user_id") % 50).cast("string").alias("key"), F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start_ts"), end.alias("end_ts"), F.col("event_type").alias("status"), "event_id")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as an entity registry with positions."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.format_string("T%05d", "s_suppkey").alias("turbine_id"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") * 10).cast("double").alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("elevation"), (F.lit(80.0) + F.col("s_nationkey")).alias("rotor"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as repeated readings of (l_partkey, l_suppkey), with a total order of its rows."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    order = F.format_string("%012d-%03d-%014d-%08d-%04d-%04d", F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), cents("l_extendedprice"), cents("l_quantity"), cents("l_discount"), cents("l_tax"))
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_partkey", "l_suppkey", cents("l_quantity").alias("quantity"), F.when(cents("l_discount") > 0, cents("l_discount")).alias("discount"), "l_returnflag", F.concat(F.lit(" "), "l_linestatus").alias("linestatus"), order.alias("row_order"))


def tidy(df: DataFrame) -> DataFrame:
    """Times as text, doubles to 6 digits, integers as long, lists as comma text: the same in both engines."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        return c.alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def panel_sql(minutes: int = HOURLY, entity: str = "event_type", layout: str = "farm") -> str:
    """The panel's common table expressions: obs, panel."""
    bounds = "SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM obs" if layout == "farm" else "SELECT turbine_id, min(timestamp) AS lo, max(timestamp) AS hi FROM obs GROUP BY 1"
    source = "(SELECT DISTINCT turbine_id FROM obs), bounds" if layout == "farm" else "bounds"
    return f"""
WITH obs AS (
  SELECT 'events' AS dataset, ({entity})::VARCHAR AS turbine_id, time_bucket(INTERVAL '{minutes} minutes', ts) AS timestamp, round(avg(value), 6) AS target_kw
  FROM events GROUP BY 1, 2, 3
), bounds AS ({bounds}), axis AS (
  SELECT 'events' AS dataset, turbine_id, unnest(generate_series(lo, hi, INTERVAL '{minutes} minutes')) AS timestamp FROM {source}
), panel AS (
  SELECT axis.dataset, axis.turbine_id, axis.timestamp, target_kw, obs.turbine_id IS NOT NULL AS is_observed,
    concat_ws('|', CASE WHEN obs.turbine_id IS NULL THEN 'missing_row' END, CASE WHEN target_kw IS NULL THEN 'missing_target' END) AS quality_flags
  FROM axis LEFT JOIN obs ON obs.turbine_id = axis.turbine_id AND obs.timestamp = axis.timestamp
)"""


def at(column: str) -> str:
    """A time as text, in SQL."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


SUMMARY_SQL = """, summary AS (
  SELECT timestamp, sum(is_observed::INT)::INT AS observed, count(target_kw)::INT AS with_target, max((quality_flags <> '')::INT) AS flagged FROM panel GROUP BY 1
)"""


def windows_sql(history: int = HISTORY, forecast: int = FORECAST) -> str:
    """The farm windows of summary, as common table expressions."""
    return f""", framed AS (
  SELECT row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n,
    first(timestamp) OVER h AS input_start_ts, last(timestamp) OVER h AS input_end_ts, first(timestamp) OVER f AS output_start_ts, last(timestamp) OVER f AS output_end_ts,
    list(observed) OVER h AS io, list(observed) OVER f AS oo, list(with_target) OVER h AS it, list(with_target) OVER f AS ot,
    min(observed) OVER h AS mio, min(observed) OVER f AS moo, min(with_target) OVER h AS mit, min(with_target) OVER f AS mot, greatest(max(flagged) OVER h, max(flagged) OVER f) AS fl
  FROM summary
  WINDOW h AS (ORDER BY timestamp ROWS BETWEEN {history - 1} PRECEDING AND CURRENT ROW), f AS (ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {forecast} FOLLOWING)
), windows AS (
  SELECT *, i - {history - 1} AS window_id, mit = 5 AS ci, mot = 5 AS co, mio = 5 AS si, moo = 5 AS so,
    concat_ws('|', CASE WHEN mit <> 5 THEN 'partial_input' END, CASE WHEN mot <> 5 THEN 'partial_output' END, CASE WHEN fl > 0 THEN 'row_quality_issues' END) AS flags
  FROM framed WHERE i >= {history - 1} AND i <= n - {forecast} - 1
)"""


WINDOWS_SQL = windows_sql()

ELIGIBLE_SQL = f""", clean AS (
  SELECT *, (is_observed AND target_kw IS NOT NULL AND quality_flags = '')::INT AS ok, row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp) AS rn FROM panel
), marked AS (
  SELECT *, sum(ok) OVER (PARTITION BY turbine_id ORDER BY timestamp ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW) AS hs,
    sum(ok) OVER (PARTITION BY turbine_id ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {FORECAST} FOLLOWING) AS fs FROM clean
), anchors AS (
  SELECT turbine_id, timestamp AS anchor_ts, target_kw AS predicted, rn FROM marked WHERE hs = {HISTORY} AND fs = {FORECAST}
), predictions AS (
  SELECT a.turbine_id, a.anchor_ts, c.rn - a.rn AS horizon, c.target_kw AS actual, a.predicted FROM anchors AS a JOIN clean AS c ON c.turbine_id = a.turbine_id AND c.rn > a.rn AND c.rn <= a.rn + {FORECAST}
)"""

INTERVALS_SQL = """
WITH iv AS (
  SELECT (user_id % 50)::VARCHAR AS key, date_trunc('second', ts) AS start_ts, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) + to_seconds(floor(value * 60)::BIGINT) END AS end_ts, event_type AS status, event_id FROM events
), nx AS (
  SELECT *, min(start_ts) OVER (PARTITION BY key ORDER BY start_ts RANGE BETWEEN INTERVAL '1 microsecond' FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, max(coalesce(end_ts, start_ts)) OVER (PARTITION BY key) AS bound FROM iv
), ev AS (
  SELECT *, CASE WHEN end_ts > start_ts THEN end_ts WHEN nxt > start_ts THEN nxt
    ELSE time_bucket(INTERVAL '60 minutes', bound - INTERVAL '1 microsecond') + INTERVAL '120 minutes' END AS effective_end FROM nx
)"""

READINGS_SQL = """
WITH readings AS (
  SELECT l_partkey, l_suppkey, round(l_quantity * 100)::BIGINT AS quantity, CASE WHEN round(l_discount * 100)::BIGINT > 0 THEN round(l_discount * 100)::BIGINT END AS discount, l_returnflag, ' ' || l_linestatus AS linestatus,
    printf('%012d-%03d-%014d-%08d-%04d-%04d', l_orderkey::BIGINT, l_linenumber::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_quantity * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT) AS row_order FROM lineitem
)"""
