"""Queries of sources, sinks, gold builds, protocols and layers over raw files made from the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspan import api
from panelspan.functions import runs
from panelspan.functions import scalars as M
from panelspan.functions import timeutil as T
from panelspan.operators import cleaning as C
from panelspan.operators import geometry as G
from panelspan.operators import gold as D
from panelspan.operators import lookup as L
from panelspan.operators import metrics as K
from panelspan.operators import panel as P
from panelspan.operators import policy as Y
from panelspan.operators import protocols as O
from panelspan.operators import reshape as R
from panelspan.plans import raw
from panelspan.plans import views as V
from panelspan.plans.catalogue import query
from panelspan.plans.views import HOURLY, at, panel_sql
from panelspan.session import scratch_path
from panelspan.sources import files, layers, specs
from panelspan.streaming import revisions

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

# sources


@query(
    """SELECT 'Unit ' || event_type AS turbine, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, round(value, 6) AS power, CASE WHEN event_type <> 'error' THEN user_id::DOUBLE END AS speed,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 4 AS source_row FROM events"""
)
def banner_scan(spark, sf):
    rows = files.read_banner_tables(spark, raw.banner_exports(spark, sf))
    return rows.select("turbine", F.col("Date and time").alias("time"), M.lenient_double("Power (kW)").alias("power"), M.lenient_double("Wind speed (m/s)").alias("speed"), "source_row")


@query(
    """SELECT 'Unit ' || (user_id % 5) AS asset_id, CASE WHEN user_id % 5 % 2 = 0 THEN 'turbine' ELSE 'asset' END AS asset_type, event_id::VARCHAR AS code, event_type AS status, 'Data, as said' AS message,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_ts, CASE WHEN event_type <> 'error' THEN strftime(ts + INTERVAL '10 minutes', '%Y-%m-%d %H:%M:%S') END AS end_ts FROM events"""
)
def status_log_scan(spark, sf):
    rows = files.read_status_logs(spark, raw.status_logs(spark, sf))
    return rows.select("asset_id", "asset_type", F.col("Code").alias("code"), F.col("Status").alias("status"), F.col("Message").alias("message"), "start_ts", "end_ts")


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN 'é ' ELSE 'ü ' END || c_mktsegment AS segment FROM customer")
def csv_fallback_scan(spark, sf):
    """Half of the rows in UTF-8 files, half in Latin-1 ones: each file is read in its own encoding."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "é ").otherwise("ü "), "c_mktsegment").alias("segment"))
    return files.read_csv_text(spark, [raw.csv_files(c.filter("id % 2 = 0"), "utf8"), raw.csv_files(c.filter("id % 2 = 1"), "latin", "ISO-8859-1")])


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders")
def csv_projection(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "NaN").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return files.read_csv_text(spark, raw.csv_files(o, "orders"), columns=["o_orderkey", "o_orderstatus"])


@query("SELECT n_nationkey::VARCHAR AS turbine_id, n_name AS name, n_regionkey::DOUBLE AS x FROM nation")
def small_csv_scan(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias(" turbine_id "), F.col("n_name").alias("name"), F.col("n_regionkey").alias("x"))
    rows = files.read_csv_text(spark, raw.csv_files(n, "static"))
    return rows.select("turbine_id", "name", M.lenient_double("x").alias("x"))


@query("SELECT 'Turbine_Data' AS kind, 'Unit ' || r_regionkey AS entity, '2020-01-01' AS first_day, '202' || r_regionkey || '-12-31' AS last_day, r_regionkey = 4 AS newest FROM region")
def file_facts(spark, sf):
    """Files published whole, listed, and read by their names alone; the release is the one with their last day."""
    root = scratch_path(spark, "exports")
    for r in V.table(spark, sf, "region").select("r_regionkey").collect():  # five files
        layers.publish(spark, "x\n", f"{root}/Turbine_Data_Unit_{r[0]}_2020-01-01_-_202{r[0]}-12-31_7.csv")
    facts = files.file_name_facts(files.list_files(spark, root))
    newest = files.release_of(facts, {str(y): f"{y}-12-31" for y in range(2020, 2025)})
    return facts.select("kind", "entity", "first_day", "last_day", (F.substring("last_day", 1, 4) == newest).alias("newest"))


@query(
    """SELECT (o_orderkey % 3)::BIGINT AS source, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS place, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp FROM orders"""
)
def station_scan(spark, sf):
    """Three station tables with their file and row ordinals."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("TimeStamp"))
    root = scratch_path(spark, "stations")
    for i in range(3):
        o.filter(f"o_orderkey % 3 = {i}").coalesce(1).sortWithinPartitions("o_orderkey").write.option("header", True).csv(f"{root}/{i}")
    rows = files.read_station_tables(spark, [f"{root}/{i}" for i in (2, 0, 1)])
    place = F.row_number().over(V.Window.partitionBy("__source_file_idx").orderBy("__source_row_nr")) - 1
    return rows.select(F.col("__source_file_idx").alias("source"), F.col("o_orderkey").cast("long").alias("o_orderkey"), place.alias("place"), "timestamp")


@query("SELECT * FROM (VALUES ('hill_of_towie', 21, 'wtc_ActPower_mean', 10), ('kelmarsh', 6, 'Power (kW)', 10), ('penmanshiel', 14, 'Power (kW)', 10), ('sdwpf_kddcup', 134, 'Patv', 10)) AS t(source, entity_count, target, resolution_minutes)")
def source_registry(spark, sf):
    known = [specs.dataset(s) for s in api.list_sources()]
    return spark.createDataFrame([(s.dataset_id, len(s.entities), s.target, s.resolution_minutes) for s in known], "source string, entity_count int, target string, resolution_minutes int")


@query(
    """SELECT job, epoch, loss, learning_rate, row_number() OVER (ORDER BY CASE job WHEN 'b' THEN 0 WHEN 'a' THEN 1 ELSE 2 END, job, epoch) AS sort_position FROM (
  SELECT CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS job, o_orderkey AS epoch, o_totalprice AS loss, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 END AS learning_rate FROM orders)"""
)
def run_history(spark, sf):
    """Histories of three runs, two of them from before a column was added, in canonical order."""
    o = V.table(spark, sf, "orders").select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("job"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"))
    paths = [raw.csv_files(o.filter(f"job = '{j}'").withColumns({"learning_rate": F.lit(0.5)} if j == "a" else {}), f"history-{j}") for j in "abc"]
    rows = layers.read_results(spark, paths, {"job": "string", "epoch": "long", "loss": "double", "learning_rate": "double"}, ("job", "epoch"))
    return K.history_order(rows, {"job": ["b", "a"]})


# sinks and layers


@query("SELECT s_suppkey, s_nationkey::VARCHAR AS s_nationkey, NULL::DOUBLE AS added FROM supplier")
def aligned_write(spark, sf):
    """A table written with its target schema's columns and types, and read back."""
    path = scratch_path(spark, "aligned")
    layers.write(layers.aligned(V.table(spark, sf, "supplier"), {"s_suppkey": "long", "s_nationkey": "string", "added": "double"}), path)
    return spark.read.parquet(path)


@query("SELECT n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def published_csv(spark, sf):
    path = scratch_path(spark, "report") + "/nations.csv"
    layers.publish_csv(V.table(spark, sf, "nation").select("n_name", "n_regionkey").orderBy("n_name"), path)
    return spark.read.option("header", True).csv(path).select("n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("SELECT count(*) AS row_count, count(DISTINCT event_type) AS types, 'x' AS label FROM events")
def json_report(spark, sf):
    path = scratch_path(spark, "json")
    e = V.table(spark, sf, "events").agg(F.count("*").alias("row_count"), F.count_distinct("event_type").alias("types")).first()
    layers.write_report(spark, {**e.asDict(), "label": "x"}, path)
    return spark.createDataFrame([layers.read_report(spark, path)], "row_count long, types long, label string")


@query("SELECT sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM (SELECT DISTINCT sha256(p_name || '|' || p_size::BIGINT || '|2024-01-01 00:00:00') AS h FROM part)")
def listing_fingerprint(spark, sf):
    listing = V.table(spark, sf, "part").select(F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("length"), F.lit("2024-01-01 00:00:00").alias("modified"))
    return layers.source_fingerprint(listing)


@query(
    """SELECT * FROM (VALUES ('manifest', 'fresh', ''), ('silver', 'stale', 'fingerprint differs'), ('gold', 'stale', 'not fresh: silver'), ('task', 'missing', 'not built'), ('events', 'stale', 'outputs missing: a, b'), ('other', 'blocked', 'no policy')) AS t(layer, status, reason)"""
)
def layer_status(spark, sf):
    made = [
        layers.Layer("manifest", (), "x", "x"), layers.Layer("silver", ("manifest",), "y", "old"), layers.Layer("gold", ("silver",), "z", "z"), layers.Layer("task", ("gold",), "t", None),
        layers.Layer("events", ("manifest",), "e", "e", ("a", "b")), layers.Layer("other", (), "o", "o", (), "no policy"),
    ]
    return spark.createDataFrame([(k, *v) for k, v in layers.check_layers(made).items()], "layer string, status string, reason string")


@query("SELECT 'nation' AS pattern, count(*) AS found FROM nation WHERE n_name LIKE '%1%' UNION ALL SELECT 'none', 0")
def layout_check(spark, sf):
    """Required patterns over file names; nations are too few to matter on the driver."""
    counts, _ = layers.check_layout([r[0] for r in V.table(spark, sf, "nation").select("n_name").collect()], {"nation": "*1*", "none": "*.csv"})
    return spark.createDataFrame(list(counts.items()), "pattern string, found long")


# gold builds

_GOLD = raw.DAY_CLOCK_SQL + """, g AS (SELECT e.turbine_id, a.timestamp FROM (SELECT DISTINCT turbine_id FROM d) AS e, (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL '10 minutes')) AS timestamp FROM d) AS a),
f AS (SELECT g.turbine_id, g.timestamp, d.p IS NOT NULL AS is_observed, patv, CASE WHEN NOT f4 THEN wdir END AS wdir, CASE WHEN NOT f2 THEN pab1 END AS pab1, pab3, coalesce(f1, false) AS f1, coalesce(f2, false) AS f2, coalesce(f3, false) AS f3, coalesce(f4, false) AS f4
  FROM g LEFT JOIN d ON d.turbine_id = g.turbine_id AND d.timestamp = g.timestamp)"""


def _day_clock(spark, sf):
    rows = files.read_day_clock(spark, raw.day_clock_export(spark, sf), ["Wspd", "Wdir", "Ndir", "Pab1", "Pab2", "Pab3", "Patv"])
    entities = rows.select(F.lit("sdwpf_kddcup").alias("dataset"), "turbine_id").distinct()
    return D.day_clock_gold(rows, specs.dataset("sdwpf_kddcup"), entities, {"Wdir": "sdwpf_wdir_out_of_range", "Ndir": "sdwpf_ndir_out_of_range", "Pab1": "sdwpf_pitch_gt_89"})


@query(
    _GOLD
    + f""" SELECT turbine_id, {at('timestamp')} AS timestamp, round(patv, 6) AS target_kw, round(wdir, 6) AS "Wdir", round(pab1, 6) AS "Pab1", pab3 AS "Pab3", is_observed, f1 OR f2 AS is_unknown, f3 OR f4 AS is_abnormal, f1 OR f2 OR f3 OR f4 AS is_masked,
  concat_ws('|', CASE WHEN f1 THEN 'sdwpf_unknown_patv_wspd' END, CASE WHEN f2 THEN 'sdwpf_unknown_pitch' END, CASE WHEN f3 THEN 'sdwpf_abnormal_ndir' END, CASE WHEN f4 THEN 'sdwpf_abnormal_wdir' END, CASE WHEN NOT is_observed THEN 'missing_row' END, CASE WHEN patv IS NULL THEN 'missing_target' END) AS quality_flags FROM f"""
)
def day_clock_gold(spark, sf):
    return _day_clock(spark, sf).select("turbine_id", "timestamp", "target_kw", "Wdir", "Pab1", "Pab3", "is_observed", "is_unknown", "is_abnormal", "is_masked", "quality_flags")


@query(
    _GOLD
    + """ SELECT 'sdwpf_kddcup' AS dataset, count(*) FILTER (WHERE f1) AS sdwpf_unknown_patv_wspd, count(*) FILTER (WHERE f2) AS sdwpf_unknown_pitch, count(*) FILTER (WHERE f3) AS sdwpf_abnormal_ndir, count(*) FILTER (WHERE f4) AS sdwpf_abnormal_wdir,
  count(*) FILTER (WHERE f1 OR f2) AS unknown_count, count(*) FILTER (WHERE f3 OR f4) AS abnormal_count, count(*) FILTER (WHERE f1 OR f2 OR f3 OR f4) AS masked_count FROM f"""
)
def reading_report(spark, sf):
    return D.reading_report(_day_clock(spark, sf))


@query(raw.DAY_CLOCK_SQL + " SELECT 144::BIGINT AS clocks, 1::BIGINT AS first_day, 2::BIGINT AS last_day, 0::BIGINT AS unread, min(n) AS min_rows, max(n) AS max_rows, 0::BIGINT AS odd_deltas, min(n) = max(n) AS passed FROM (SELECT count(*) AS n FROM d GROUP BY turbine_id)")
def time_audit(spark, sf):
    return files.time_audit(files.read_day_clock(spark, raw.day_clock_export(spark, sf), ["Patv"]))


_BANNER_GOLD = """
WITH k AS (SELECT 'Unit ' || event_type AS turbine_id, date_trunc('second', ts) AS timestamp, round(value, 6) AS v, (event_type <> 'error')::INT AS filled, CASE WHEN event_type <> 'error' THEN user_id::DOUBLE END AS speed, event_id FROM events),
s AS (SELECT turbine_id, timestamp, arg_min(v, event_id) AS power, arg_min(speed, event_id) AS speed, (count(DISTINCT v) > 1)::INT + (count(DISTINCT speed) > 1)::INT AS conflicts, count(*) AS n FROM k GROUP BY 1, 2)"""


@query(_BANNER_GOLD + f" SELECT turbine_id, {at('timestamp')} AS timestamp, power, speed, conflicts::BIGINT AS row_conflict_count, n AS source_row_count FROM s")
def banner_silver(spark, sf):
    silver = D.banner_silver(files.read_banner_tables(spark, raw.banner_exports(spark, sf)))
    return silver.select("turbine_id", "timestamp", M.lenient_double("Power (kW)").alias("power"), M.lenient_double("Wind speed (m/s)").alias("speed"), "row_conflict_count", "source_row_count")


@query(
    _BANNER_GOLD
    + f""", e AS (SELECT DISTINCT turbine_id FROM s), a AS (SELECT unnest(generate_series(date_trunc('day', min(timestamp)), max(timestamp), INTERVAL '10 minutes')) AS timestamp FROM s), b AS (SELECT * FROM s WHERE date_part('epoch', timestamp)::BIGINT % 600 = 0),
  lo AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM b), g AS (SELECT turbine_id, timestamp FROM e, a, lo WHERE timestamp BETWEEN lo AND hi)
  SELECT g.turbine_id, count(*) AS row_count, count(b.turbine_id) AS observed_count, round(sum(power), 4) AS power, count(*) FILTER (WHERE conflicts > 0) AS conflict_count FROM g LEFT JOIN b ON b.turbine_id = g.turbine_id AND b.timestamp = g.timestamp GROUP BY 1"""
)
def banner_gold(spark, sf):
    silver = D.banner_silver(files.read_banner_tables(spark, raw.banner_exports(spark, sf)))
    entities = silver.select(F.lit("kelmarsh").alias("dataset"), "turbine_id").distinct()
    aligned = silver.filter(T.seconds("timestamp") % 600 == 0)
    gold = D.banner_gold(aligned, specs.dataset("kelmarsh"), entities)
    conflict = F.count_if(D.X.has_token("quality_flags", D.X.CONFLICT_RESOLVED))
    return gold.groupBy("turbine_id").agg(F.count("*").alias("row_count"), F.count_if("is_observed").alias("observed_count"), F.round(F.sum("target_kw"), 4).alias("power"), conflict.alias("conflict_count"))


_STATION_GOLD = """
WITH k AS (SELECT printf('T%02d', (user_id % 22)::INT) AS turbine_id, time_bucket(INTERVAL '10 minutes', ts) AS timestamp, round(value) AS v, (event_id % 2)::DOUBLE AS speed FROM events WHERE user_id % 22 > 0),
s AS (SELECT turbine_id, timestamp, count(*) AS n, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS power, CASE WHEN count(DISTINCT speed) = 1 THEN min(speed) END AS speed, count(DISTINCT v) > 1 AS pc, count(DISTINCT speed) > 1 AS sc FROM k GROUP BY 1, 2)"""


def _station_silver(spark, sf):
    stations = spark.range(1, 22).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("StationId"), F.format_string("T%02d", "id").alias("turbine_id"))
    return D.station_silver(files.read_station_tables(spark, raw.station_exports(spark, sf)), stations, specs.dataset("hill_of_towie"))


@query(_STATION_GOLD + f" SELECT turbine_id, {at('timestamp')} AS timestamp, power, speed, n AS duplicate_count, CASE WHEN pc OR sc THEN 'conflict' WHEN n > 1 THEN 'identical' END AS duplicate_kind FROM s")
def station_silver(spark, sf):
    return _station_silver(spark, sf).select("turbine_id", "timestamp", F.col("wtc_ActPower_mean").alias("power"), F.col("wtc_AcWindSp_mean").alias("speed"), "duplicate_count", "duplicate_kind")


@query(
    _STATION_GOLD
    + """, a AS (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL '10 minutes')) AS timestamp FROM s), e AS (SELECT printf('T%02d', i::INT) AS turbine_id FROM range(1, 22) AS r(i)), f AS (SELECT timestamp, count(*) AS m FROM s GROUP BY 1)
  SELECT e.turbine_id, count(*) AS row_count, count(s.turbine_id) AS observed_count, round(sum(power), 4) AS power, count(*) FILTER (WHERE pc) AS row_conflicts, count(*) FILTER (WHERE sc) AS feature_conflicts, count(*) FILTER (WHERE m > 1) AS busy, sum(coalesce(m, 0))::BIGINT AS readings
  FROM e CROSS JOIN a LEFT JOIN s ON s.turbine_id = e.turbine_id AND s.timestamp = a.timestamp LEFT JOIN f ON f.timestamp = a.timestamp GROUP BY 1"""
)
def station_gold(spark, sf):
    """The panel of 21 stations with a joined site series: how many of them have a reading."""
    silver = _station_silver(spark, sf)
    site = silver.groupBy("dataset", "timestamp").agg(F.count("*").alias("reading_count"), (F.count("*") > 1).alias("busy"))
    gold = D.station_gold(silver, specs.dataset("hill_of_towie"), site=site)
    return gold.groupBy("turbine_id").agg(
        F.count("*").alias("row_count"), F.count_if("is_observed").alias("observed_count"), F.round(F.sum("target_kw"), 4).alias("power"),
        F.count_if(D.X.has_token("quality_flags", D.X.DUPLICATE_RESOLVED)).alias("row_conflicts"), F.count_if(F.col("feature_quality_flags") == f"{D.X.SOURCE_CONFLICT}__default").alias("feature_conflicts"),
        F.count_if("busy").alias("busy"), F.sum("reading_count").alias("readings"),
    )


@query(
    """WITH o AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'y' END AS dataset, (user_id % 6)::VARCHAR AS turbine_id, time_bucket(INTERVAL '1 day', ts) AS timestamp, round(avg(value), 6) AS target_kw FROM events GROUP BY 1, 2, 3),
  b AS (SELECT dataset, min(timestamp) AS lo, max(timestamp) AS hi FROM o GROUP BY 1), g AS (SELECT e.dataset, turbine_id, unnest(generate_series(lo, hi, INTERVAL '1 day')) AS timestamp FROM (SELECT DISTINCT dataset, turbine_id FROM o) AS e JOIN b ON b.dataset = e.dataset)
  SELECT g.dataset, g.turbine_id, strftime(g.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, target_kw, o.dataset IS NOT NULL AS is_observed FROM g LEFT JOIN o ON o.dataset = g.dataset AND o.turbine_id = g.turbine_id AND o.timestamp = g.timestamp"""
)
def panel_two_sources(spark, sf):
    e = V.table(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "x").otherwise("y").alias("dataset"), (F.col("user_id") % 6).cast("string").alias("turbine_id"), T.floor_to("ts", 1440).alias("timestamp"), "value")
    obs = e.groupBy("dataset", "turbine_id", "timestamp").agg(F.round(F.avg("value"), 6).alias("target_kw"))
    return P.fill_grid(obs, None, 1440).select("dataset", "turbine_id", "timestamp", "target_kw", "is_observed")


# rows of panels


@query(panel_sql() + f" SELECT turbine_id, {at('timestamp')} AS timestamp, NOT is_observed OR target_kw IS NULL AS invalid FROM panel")
def invalid_points(spark, sf):
    return V.panel(spark, sf).select("turbine_id", "timestamp", P.invalid_point().alias("invalid"))


@query(panel_sql() + f" SELECT turbine_id, {at('timestamp')} AS timestamp, target_kw FROM panel WHERE turbine_id = 'view' AND timestamp BETWEEN (SELECT min(timestamp) FROM panel) + INTERVAL '24 hours' AND (SELECT min(timestamp) FROM panel) + INTERVAL '96 hours'")
def time_slices(spark, sf):
    panel = V.panel(spark, sf)
    lo = V.observations(spark, sf).agg(F.min("timestamp")).first()[0]
    from datetime import timedelta

    return P.time_slice(panel, lo + timedelta(hours=24), lo + timedelta(hours=96), "view").select("turbine_id", "timestamp", "target_kw")


@query("SELECT strftime(least((SELECT min(ts) FROM events), (SELECT min(o_orderdate) FROM orders)), '%Y-%m-%d %H:%M:%S') AS first, strftime(greatest((SELECT max(ts) FROM events), (SELECT max(o_orderdate) FROM orders)), '%Y-%m-%d %H:%M:%S') AS last")
def time_bounds(spark, sf):
    return P.time_bounds([V.table(spark, sf, "events").select(F.col("ts").alias("timestamp")), V.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"))])


@query("SELECT DISTINCT (user_id % 50)::VARCHAR AS key, strftime(time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes', '%Y-%m-%d %H:%M:%S') AS timestamp, arg_min(event_id, event_id) AS event_id FROM events GROUP BY 1, 2")
def interval_end_labels(spark, sf):
    e = V.table(spark, sf, "events").select((F.col("user_id") % 50).cast("string").alias("key"), T.floor_to("ts", 10).alias("timestamp"), "event_id")
    return P.to_interval_end(e, ["key"], 10, ["event_id"])


@query(panel_sql() + f", s AS (SELECT timestamp, count(*) AS n FROM obs WHERE turbine_id = 'view' GROUP BY 1), t AS (SELECT timestamp, max(target_kw) AS m FROM obs WHERE turbine_id = 'error' GROUP BY 1) SELECT 'events' AS dataset, {at('timestamp')} AS timestamp, n, m FROM s FULL JOIN t USING (timestamp)")
def joined_series(spark, sf):
    obs = V.observations(spark, sf)
    one = obs.filter("turbine_id = 'view'").groupBy("dataset", "timestamp").agg(F.count("*").alias("n"))
    return P.joined_series(one, obs.filter("turbine_id = 'error'").groupBy("dataset", "timestamp").agg(F.max("target_kw").alias("m")), ["dataset", "timestamp"])


@query(panel_sql() + f" SELECT turbine_id, count(*) AS n, round(sum(target_kw), 6) AS total, round(sum(target_kw) - coalesce(sum(d), 0), 6) AS rest FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp) % 2 = 0 THEN target_kw END AS d FROM panel) GROUP BY 1")
def entity_callback(spark, sf):
    """A Python callback for each entity: what no expression says; here every second row is left out of a sum."""

    def step(frame):
        import pandas as pd

        total = frame["target_kw"].sum()
        return pd.DataFrame([(frame["turbine_id"].iloc[0], len(frame), total, total - frame["target_kw"].iloc[1::2].sum())], columns=["turbine_id", "n", "total", "rest"])

    return P.per_entity(V.panel(spark, sf).select("dataset", "turbine_id", "timestamp", "target_kw"), step, "turbine_id string, n long, total double, rest double")


_EFFECTS = panel_sql() + ", f AS (SELECT DISTINCT dataset, timestamp FROM obs WHERE turbine_id = 'error' AND target_kw > 50)"


@query(_EFFECTS + f" SELECT turbine_id, {at('f.timestamp')} AS timestamp, 'feature_source_conflict__farm' AS flag FROM f JOIN obs ON obs.timestamp = f.timestamp")
def site_effects(spark, sf):
    """Site effects for the entities that have a reading at that time."""
    obs = V.observations(spark, sf)
    f = obs.filter("turbine_id = 'error' AND target_kw > 50").select("dataset", "timestamp", F.lit("feature_source_conflict__farm").alias("flag"))
    return C.expand_site_effects(f, obs).select("turbine_id", "timestamp", "flag")


@query(_EFFECTS + f" SELECT turbine_id, {at('f.timestamp')} AS timestamp FROM f, (SELECT DISTINCT turbine_id FROM obs)")
def entity_effects(spark, sf):
    """Site effects for every registered entity."""
    obs = V.observations(spark, sf)
    f = obs.filter("turbine_id = 'error' AND target_kw > 50").select("dataset", "timestamp")
    return C.effects_for_entities(f, obs).select("turbine_id", "timestamp")


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'old' WHEN 'O' THEN 'open' ELSE 'part' END AS provenance FROM orders")
def annotation(spark, sf):
    known = spark.createDataFrame([("F", "old"), ("O", "open"), ("P", "part")], "o_orderstatus string, provenance string")
    return L.annotate(V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), known, "o_orderstatus").select("o_orderkey", "o_orderstatus", "provenance")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership(spark, sf):
    wanted = V.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return L.members(V.table(spark, sf, "orders"), wanted, ["o_custkey"]).select("o_orderkey")


# policies and protocols


@query("SELECT 'a b' AS name UNION ALL SELECT 'c'")
def header_names(spark, sf):
    return spark.createDataFrame([(n,) for n in Y.normalise_headers([" a b ", "", "c", "  "])], "name string")


@query(raw.DAY_CLOCK_SQL + f" SELECT turbine_id, {at('timestamp')} AS timestamp, round(CASE WHEN NOT f1 THEN patv END, 6) AS patv, round(CASE WHEN NOT f4 THEN wdir END, 6) AS wdir, round(CASE WHEN NOT f3 THEN ndir END, 6) AS ndir, round(CASE WHEN NOT f2 THEN pab1 END, 6) AS pab1 FROM d")
def named_masks(spark, sf):
    rows = files.read_day_clock(spark, raw.day_clock_export(spark, sf), ["Wspd", "Wdir", "Ndir", "Pab1", "Patv"])
    rules = {"Patv": "sdwpf_unknown_patv_wspd", "Wdir": "sdwpf_wdir_out_of_range", "Ndir": "sdwpf_ndir_out_of_range", "Pab1": "sdwpf_pitch_gt_89"}
    out = Y.apply_masks(rows, {c: Y.named_rule(r, c) for c, r in rules.items()})
    return out.select("turbine_id", "timestamp", *[F.col(c).alias(c.lower()) for c in rules])


@query("SELECT p_partkey, CASE WHEN p_size <> 7 AND p_size <= 40 THEN p_size END::BIGINT AS p_size FROM part")
def feature_policy(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return Y.apply_feature_policy(p, {"p_size": "keep+mask", "p_retailprice": "drop"}, {"p_size": "eq:7|gt:40"}, ["p_size", "p_retailprice"])


@query("SELECT i::BIGINT AS turbine_index, 'N' || i AS turbine_id, n_regionkey::DOUBLE AS x, n_name AS name, NULL::BIGINT AS rotor FROM range(30) AS r(i) LEFT JOIN nation ON n_nationkey = i")
def static_entities(spark, sf):
    """Registered entities in index order, with five that no row is about."""
    n = V.table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("turbine_id"), F.col("n_regionkey").cast("string").alias("x"), F.col("n_name").alias("name"))
    return O.static_table(n.unionByName(n.withColumn("name", F.concat(F.lit("~"), "name"))), {"x": "double", "name": "string", "rotor": "long"}, [f"N{i}" for i in range(30)], spark, ("name",))


_WIDE = panel_sql() + """, w AS (SELECT *, target_kw / 10 AS ws, target_kw * 3.6 AS wd, target_kw * 2 AS np, target_kw - 20 AS pa, target_kw / 2 AS pb, CASE WHEN target_kw < 70 THEN target_kw END AS pc FROM panel),
v AS (SELECT *, CASE WHEN pa BETWEEN -10 AND 95 THEN pa END AS ma, CASE WHEN pb BETWEEN -10 AND 95 THEN pb END AS mb, CASE WHEN pc BETWEEN -10 AND 95 THEN pc END AS mc FROM w)"""


def _wide(spark, sf):
    k = F.col("target_kw")
    pitch = specs.dataset("kelmarsh").columns["pitch"]
    return V.panel(spark, sf).withColumns({"Wind speed (m/s)": k / 10, "Wind direction (°)": k * 3.6, "Nacelle position (°)": k * 2, pitch[0]: k - 20, pitch[1]: k / 2, pitch[2]: F.when(k < 70, k)})


@query(
    _WIDE
    + f""" SELECT turbine_id, {at('timestamp')} AS timestamp, round(sin(radians(wd)), 6) AS wd_sin, round(cos(radians(wd - np)), 6) AS yaw_cos, round((ma + mb + mc) / 3, 6) AS pitch_mean, (target_kw IS NULL)::BIGINT AS target_mask, (ma + mb + mc IS NULL)::BIGINT AS pitch_mask,
  CASE WHEN ma + mb + mc IS NULL THEN 'missing_past_covariates' ELSE '' END AS feature_quality_flags FROM v"""
)
def feature_protocol(spark, sf):
    out = O.select_protocol(_wide(spark, sf), specs.dataset("kelmarsh"), "power_wd_yaw_pmean_hist_sincos_masked")
    return out.select("turbine_id", "timestamp", F.col("wind_direction_sin").alias("wd_sin"), F.col("yaw_error_cos").alias("yaw_cos"), "pitch_mean", F.col("target_kw__mask").alias("target_mask"), F.col("pitch_mean__mask").alias("pitch_mask"), "feature_quality_flags")


@query(
    panel_sql()
    + """, w AS (SELECT turbine_id, target_kw AS k, floor(target_kw / 10) AS n FROM panel), v AS (SELECT *, CASE WHEN k > 30 THEN k * 3 END AS pmu FROM w)
SELECT turbine_id, count(*) AS row_count, sum(n)::BIGINT AS events, count(*) FILTER (WHERE k > 50) AS active, round(sum(pmu), 4) AS farm_kw, count(*) FILTER (WHERE pmu IS NULL) AS farm_masked, count(*) FILTER (WHERE k IS NULL) AS event_masked,
  count(*) FILTER (WHERE pmu IS NULL OR k IS NULL) AS incomplete, 7 + 25 + 26 AS columns FROM v GROUP BY 1"""
)
def world_model_protocol(spark, sf):
    """The protocol that takes local and site-wide observations, each with its mask."""
    k = F.col("target_kw")
    spec, groups = specs.dataset("kelmarsh"), specs.groups_of("world_model_v1")
    native = [c for v in spec.columns.values() for c in ([v] if isinstance(v, str) else v)]
    wide = V.panel(spark, sf).withColumns({c: F.lit(1.0) for c in native} | {c: F.floor(k / 10) for c in (*groups.local, *groups.site)})
    wide = wide.withColumns({"evt_any_active": k > 50, "farm_pmu__gms_power_kw": F.when(k > 30, k * 3)})
    out = O.select_protocol(wide, spec, "world_model_v1")
    return out.groupBy("turbine_id").agg(
        F.count("*").alias("row_count"), F.sum("evt_active_count").alias("events"), F.count_if("evt_any_active").alias("active"), F.round(F.sum("farm_pmu__gms_power_kw"), 4).alias("farm_kw"),
        F.sum("farm_pmu__gms_power_kw__mask").cast("long").alias("farm_masked"), F.sum("farm_evt_active_count__mask").cast("long").alias("event_masked"),
        F.count_if(F.col("feature_quality_flags") == "missing_past_covariates").alias("incomplete"), F.lit(len(out.columns)).alias("columns"),
    )


@query(
    panel_sql(entity="'Kelmarsh ' || (user_id % 6 + 1)")
    + """, n AS (SELECT count(DISTINCT timestamp) AS t FROM panel) SELECT p.part, CASE p.part WHEN 'series' THEN t * 6 WHEN 'known_future' THEN t WHEN 'window_index' THEN greatest(t - 29, 0) WHEN 'report' THEN (t > 29)::INT WHEN 'static' THEN 6 WHEN 'pairwise' THEN 30 ELSE 1 END::BIGINT AS row_count
  FROM n, (SELECT unnest(['series', 'known_future', 'window_index', 'report', 'static', 'pairwise', 'context']) AS part) AS p"""
)
def task_bundle(spark, sf):
    """A farm task's bundle saved, loaded and counted part by part."""
    from dataclasses import replace

    spec = replace(specs.dataset("kelmarsh"), resolution_minutes=HOURLY)
    obs = V.observations(spark, sf, entity="concat('Kelmarsh ', user_id % 6 + 1)").withColumn("dataset", F.lit("kelmarsh"))
    static = spark.createDataFrame([(e, float(i), float(i * i)) for i, e in enumerate(spec.entities)], "turbine_id string, coord_x double, coord_y double")
    task, layout = specs.TaskSpec("24h", "6h"), layers.Layout(scratch_path(spark, "bundle"), spec.dataset_id)
    api.save_bundle(api.build_bundle(api.build_gold(obs, spec), spec, task, "power_only", static), layout, task, "power_only")
    back = api.load_bundle(spark, layout, task, "power_only")
    counts = [getattr(back, p).agg(F.lit(p).alias("part"), F.count("*").alias("row_count")) for p in api.PARTS]
    return L.diagonal_union(counts)


# times, angles, tensors, tiles


@query(
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS plain, strftime(date_trunc('second', ts) - INTERVAL '2 hours', '%Y-%m-%d %H:%M:%S') AS shifted, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, NULL::VARCHAR AS bad FROM events"""
)
def parse_times(spark, sf):
    e = V.table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", T.parse(F.concat(F.lit(" "), text)).alias("plain"), T.parse(F.concat(text, F.lit("+02:00"))).alias("shifted"), T.parse(F.date_format("ts", "yyyy-MM-dd")).alias("day"), T.parse(F.concat(F.lit("x"), text)).alias("bad"))


@query("SELECT p_partkey, CASE WHEN p_size % 30 < 24 THEN strftime(TIMESTAMP '2020-05-01' + to_days((p_size - 1)::INT) + to_hours((p_size % 30)::INT) + INTERVAL '10 minutes', '%Y-%m-%d %H:%M:%S') END AS timestamp FROM part")
def day_clock_times(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select("p_partkey", T.day_clock(F.col("p_size").cast("int"), F.format_string("%02d:10", (F.col("p_size") % 30).cast("int"))).alias("timestamp"))


@query("SELECT * FROM (VALUES ('1d2h', 156, '1d2h'), ('24h', 144, '1d'), ('90m', 9, '1h30m')) AS t(text, steps, formatted)")
def durations(spark, sf):
    return spark.createDataFrame([(t, T.duration_steps(t, 10), T.format_duration(T.parse_duration(t))) for t in ("1d2h", "24h", "90m")], "text string, steps int, formatted string")


@query("SELECT '20240131-235959' AS stem, '2024-01-31 23:59:59' AS at")
def run_stems(spark, sf):
    when = runs.parse_stem("20240131-235959")
    return spark.createDataFrame([(runs.run_stem(when), f"{when:%Y-%m-%d %H:%M:%S}")], "stem string, at string")


_PLACED = "SELECT s_suppkey, printf('T%05d', s_suppkey::BIGINT) AS id, 50 + s_suppkey * 0.001 AS lat, 1 + s_nationkey * 0.01 + s_acctbal * 0.0000013 AS lon FROM supplier"


@query(f"WITH s AS ({_PLACED}), o AS (SELECT avg(lat) AS lat0, avg(lon) AS lon0 FROM s) SELECT id AS turbine_id, round(radians(lon - lon0) * cos(radians(lat0)) * 6371000, 3) AS x, round(radians(lat - lat0) * 6371000, 3) AS y FROM s, o")
def local_projection(spark, sf):
    return G.with_local_xy(_placed(spark, sf)).select("turbine_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _placed(spark, sf):
    s = V.table(spark, sf, "supplier")
    nothing = F.lit(None).cast("double")
    return s.select(F.format_string("T%05d", "s_suppkey").alias("turbine_id"), (F.lit(50.0) + F.col("s_suppkey") * 0.001).alias("latitude"), (F.lit(1.0) + F.col("s_nationkey") * 0.01 + F.col("s_acctbal") * 0.0000013).alias("longitude"), nothing.alias("coord_x"), nothing.alias("coord_y"), F.lit(0.0).alias("elevation"), F.lit(80.0).alias("rotor"))


@query(
    f"""WITH s AS ({_PLACED}), o AS (SELECT avg(lat) AS lat0, avg(lon) AS lon0 FROM s), p AS (SELECT id, radians(lon - lon0) * cos(radians(lat0)) * 6371000 AS x, radians(lat - lat0) * 6371000 AS y FROM s, o),
  e AS (SELECT a.id AS a, b.id AS b, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), b.id) AS r FROM p AS a JOIN p AS b ON a.id <> b.id),
  u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(d) AS d FROM e WHERE r <= 2 GROUP BY 1, 2)
  SELECT (SELECT count(*) FROM p) AS entity_count, count(*) AS edge_count, round(avg(d), 3) AS mean_distance_m, round(max(d), 3) AS max_distance_m FROM u"""
)
def site_layout(spark, sf):
    summary = G.site_layout(_placed(spark, sf))[2]
    return summary.select("entity_count", "edge_count", F.round("mean_distance_m", 3).alias("mean_distance_m"), F.round("max_distance_m", 3).alias("max_distance_m"))


@query(
    """WITH s AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS id, n_nationkey * 100.0 AS x, (n_nationkey % 5) * 130.0 AS y FROM nation), e AS (SELECT a.id AS src, b.id AS dst, b.x - a.x AS dx, b.y - a.y AS dy FROM s AS a JOIN s AS b ON a.id <> b.id),
  w AS (SELECT r_regionkey * 70.0 AS d, radians(r_regionkey * 70.0 + 180) AS t FROM region), g AS (SELECT d, src, dst, dx * sin(t) + dy * cos(t) AS al, dx * cos(t) - dy * sin(t) AS ac FROM e, w)
  SELECT d AS direction_deg, src AS src_turbine_id, dst AS dst_turbine_id, round(1 / (1 + exp(-al / 200)) * exp(-abs(al) / 1000) * exp(-ac * ac / 80000), 6) AS gate FROM g"""
)
def wake_gates(spark, sf):
    n = V.table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("turbine_id"), (F.col("n_nationkey") * 100.0).alias("x"), (F.col("n_nationkey") % 5 * 130.0).alias("y"), F.lit(0.0).alias("elevation"), F.lit(80.0).alias("rotor"))
    wind = V.table(spark, sf, "region").select(F.lit("d").alias("dataset"), F.col("r_regionkey").alias("timestamp"), (F.col("r_regionkey") * 70.0).alias("direction_deg"))
    return G.wake_gate(G.pairwise_geometry(n), wind).select((F.col("timestamp") * 70.0).alias("direction_deg"), "src_turbine_id", "dst_turbine_id", "gate")


@query(panel_sql() + f" SELECT turbine_id, {at('timestamp')} AS timestamp, round(CASE WHEN ahead THEN 0 ELSE coalesce(target_kw, 0) END, 6) AS value, CASE WHEN ahead OR target_kw IS NULL THEN 1 ELSE 0 END::DOUBLE AS mask FROM (SELECT *, timestamp >= (SELECT max(timestamp) FROM panel) - INTERVAL '6 hours' AS ahead FROM panel)")
def dense_channels(spark, sf):
    from datetime import timedelta

    panel = V.panel(spark, sf).withColumn("target_kw__mask", F.col("target_kw").isNull().cast("int"))
    last = V.observations(spark, sf).agg(F.max("timestamp")).first()[0]
    out = R.dense(panel, ["target_kw", "target_kw__mask"], last - timedelta(hours=6), ("target_kw__mask",))
    return out.select("turbine_id", "timestamp", F.col("channels")[0].alias("value"), F.col("channels")[1].alias("mask"))


@query("SELECT * FROM (VALUES ('0', 'Kelmarsh 1'), ('Kelmarsh 3', 'Kelmarsh 3'), ('5', 'Kelmarsh 6')) AS t(selector, turbine_id)")
def selectors(spark, sf):
    ids = list(specs.dataset("kelmarsh").entities)
    return spark.createDataFrame([(s, R.selected_entity(s, ids)) for s in ("0", "Kelmarsh 3", "5")], "selector string, turbine_id string")


@query("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS rank FROM part)")
def search_ranking(spark, sf):
    return K.search_ranking(V.table(spark, sf, "part"), ["p_brand"], ["p_size", "p_retailprice"], "p_partkey").select("p_brand", "p_partkey", "rank")


# streaming twins over a batch


@query("SELECT event_type, count(*) AS row_count, count(value) AS value_count, count(*) - count(value) AS missing_count FROM events GROUP BY 1")
def running_report(spark, sf):
    return revisions.running_report(V.table(spark, sf, "events"), "event_type", "value")


@query(
    """SELECT (user_id % 50)::VARCHAR AS key, strftime(time_bucket(INTERVAL '60 minutes', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS event_type,
  CASE WHEN min(user_id) = max(user_id) THEN min(user_id) END AS user_id, count(*) AS row_count, ((min(event_type) <> max(event_type))::INT + (min(user_id) <> max(user_id))::INT)::BIGINT AS conflict_count FROM events GROUP BY 1, 2"""
)
def frontier_merge(spark, sf):
    e = V.table(spark, sf, "events").select((F.col("user_id") % 50).cast("string").alias("key"), T.floor_to("ts", HOURLY).alias("timestamp"), "event_type", "user_id")
    return revisions.frontier_merge(e, ["key"], "timestamp", ["event_type", "user_id"], "1 hour")
