"""Flags, times, numbers, names, policies, geometry, cleaning, events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspan.functions import flags as X
from panelspan.functions import scalars as M
from panelspan.functions import timeutil as T
from panelspan.operators import cleaning, events, geometry, policy, protocols, reshape
from panelspan.sources.specs import TaskSpec, dataset
from tests.conftest import rows


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_flags(spark):
    n = F.lit(None).cast("string")
    got = one(spark, X.join_flags(F.lit("b| a |b"), n, F.lit("c||a")), X.join_flags(n), X.strip_flags(F.lit("a|b|a|c"), ["b"]), X.has_token(F.lit("ab|c"), "a"), X.has_token(n, "a"))
    assert list(got) == ["b|a|c", "", "a|c", False, False]


def test_alignment_and_parsing(spark):
    ts = F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")
    odd = F.lit("2024-01-01 00:10:01").cast("timestamp_ntz")
    day = dt.datetime(2024, 1, 1)
    got = one(spark, T.floor_to(odd, 10), T.ceil_to(odd, 10), T.ceil_to(ts, 10), T.parse(F.lit("2024-01-01 02:00:00+02:00")), T.parse(F.lit("x")), T.day_clock(F.lit(2), F.lit("01:30")), T.day_clock(F.lit(2), F.lit("xx")))
    assert list(got) == [day.replace(minute=10), day.replace(minute=20), day.replace(minute=10), day, None, dt.datetime(2020, 5, 2, 1, 30), None]


def test_durations():
    assert T.duration_steps("1d2h30m", 10) == 159
    assert T.format_duration(T.parse_duration("26h")) == "1d2h"
    assert TaskSpec("24h", "6h").steps(10) == (144, 36, 1)
    for bad in ("", "h", "5x", "15m3"):
        with pytest.raises(ValueError):
            T.parse_duration(bad)
    with pytest.raises(ValueError):
        T.duration_steps("25m", 10)


def test_friday_is_weekend_but_not_in_the_corrected_flag(spark):
    c = T.calendar(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    assert list(one(spark, c["is_weekend"], c["is_weekend_corrected"])) == [1, 0]


def test_numbers(spark):
    n = F.lit(None).cast("double")
    got = one(spark, M.lenient_double(F.lit(" 1.5 ")), M.lenient_double(F.lit("-")), M.lenient_double(F.lit("NaN")), M.lenient_double(F.lit("x")), M.per_unit(n, F.lit(2.0)), M.per_unit(F.lit(5.0), F.lit(2.0)), M.row_mean(F.lit(1.0), n), M.sanitize(F.lit(" °A-b! ")), M.sanitize(F.lit("!!")), M.zscore(n, F.lit(1.0), F.lit(0.0)))
    assert list(got) == [1.5, None, None, None, None, 1.0, None, "a_b", "unknown", 0.0]


def test_feature_names_number_collisions(spark):
    df = spark.createDataFrame([("a b",), ("a-b",), (" a b ",), ("",), (None,), ("c",)], "v string")
    assert [(r["value"], r["name"]) for r in rows(M.feature_names(df, "v", "p"), "value")] == [("a b", "p__a_b"), ("a-b", "p__a_b_2"), ("c", "p__c")]


def test_policy(spark):
    with pytest.raises(ValueError, match="twice"):
        policy.load_policy([{"asset": "a", "table": "t", "column": "c", "decision": "keep"}] * 2)
    with pytest.raises(ValueError, match="unknown decision"):
        policy.load_policy([{"asset": "a", "table": "t", "column": "c", "decision": "x"}])
    with pytest.raises(ValueError):
        policy.predicate("c", "near:1")
    with pytest.raises(ValueError, match="duplicate"):
        policy.normalise_headers(["a", " a"])
    df = spark.createDataFrame([(-5.0, 2.0, 10.0), (-5.0, 3.0, 90.0), (None, 3.0, None)], "Patv double, Wspd double, p double")
    got = rows(policy.apply_masks(df, {"Patv": policy.named_rule("sdwpf_unknown_patv_wspd", "Patv"), "p": policy.named_rule("sdwpf_pitch_gt_89", "p")}))
    assert [(r["Patv"], r["p"]) for r in got] == [(-5.0, 10.0), (None, None), (None, None)]
    assert policy.rule_diagnostics(df, ["p"], 0, 50).first().asDict() == {"rule_rows": 1, "missing_rows": 1, "rows": 3}


def test_geometry(spark):
    df = spark.createDataFrame([("A", 0.0, 0.0, 10.0, 1.0), ("B", 300.0, 400.0, 40.0, 299.0)], "turbine_id string, x double, y double, elevation double, rotor double")
    got = rows(geometry.pairwise_geometry(df), "src_turbine_id")
    assert got[0]["distance_m"] == 500 and got[0]["bearing_deg"] == pytest.approx(36.8699, abs=1e-4) and got[1]["bearing_deg"] == pytest.approx(216.8699, abs=1e-4)
    assert (got[0]["elevation_diff_m"], got[1]["elevation_diff_m"]) == (30, -30) and got[0]["distance_rotor"] == pytest.approx(500 / 150)
    assert geometry.axis_problems(geometry.pairwise_geometry(df), df).count() == 0
    with pytest.raises(ValueError, match="missing values"):
        geometry.pairwise_geometry(df.withColumn("x", F.lit(None).cast("double")))


def test_merge_takes_the_fullest_row_first(spark):
    df = spark.createDataFrame([("k", 0, "100", "8.0", None), ("k", 1, None, "8.2", "0.9"), ("m", 2, "1", "2", "-")], "key string, o int, power string, wind string, pitch string")
    got = rows(cleaning.merge_best_value(df, ["key"], ["power", "wind", "pitch"], "o"), "key")
    assert got[0] == {"key": "k", "power": "100", "wind": "8.0", "pitch": "0.9", "row_conflict_count": 1, "source_row_count": 2}
    assert got[1]["pitch"] is None
    assert rows(cleaning.merge_conflicts(df, ["key"], ["power", "wind", "pitch"], "o")) == [{"key": "k", "column_name": "wind", "kept_value": "8.0", "other_value": "8.2"}]


def test_duplicates_by_kind(spark):
    df = spark.createDataFrame(
        [("a", 1, 2060.0, "x"), ("a", 2, 2061.0, "x"), ("b", 1, 1.0, "x "), ("b", 2, 1.0, "x"), ("c", 1, 1.0, "x"), ("c", 2, 1.0, "x"), ("d", 1, 1.0, "x"), (None, 1, 1.0, "x"), (None, 2, 2.0, "x")],
        "k string, o int, v double, t string",
    )
    got = {r["k"]: r for r in rows(cleaning.resolve_duplicates(df, ["k"], ["v", "t"], ["o"]).filter("k is not null"))}
    assert {k: r["duplicate_kind"] for k, r in got.items()} == {"a": "conflict", "b": "normalized_equal", "c": "identical", "d": None}
    assert got["a"]["v"] is None and got["a"]["t"] == "x" and got["a"]["conflict_columns"] == ["v"]
    assert cleaning.resolve_duplicates(df, ["k"], ["v", "t"], ["o"]).filter("k is null").count() == 2
    effects = cleaning.duplicate_effects(cleaning.duplicate_audit(cleaning.resolve_duplicates(df, ["k"], ["v", "t"], ["o"]), ["k"], "grid"), "feature", "farm_grid")
    assert [r["flag"] for r in rows(effects)] == ["feature_source_conflict__farm_grid"]


def test_interval_boundaries(spark):
    day = dt.datetime(2024, 1, 1)
    m = lambda k: day + dt.timedelta(minutes=k)
    df = spark.createDataFrame([("A", m(0), m(10), "Stop"), ("A", m(20), m(20), "Warn"), ("A", m(35), None, "Stop")], "k string, start_ts timestamp_ntz, end_ts timestamp_ntz, status string")
    got = rows(events.event_features(df, ["k"], 10, aliases={"stop": "stop_active"}, categorical={"status": "evt_status"}), "timestamp")
    assert [(r["timestamp"].minute, r["evt_active_count"], r["evt_total_overlap_seconds"], r["evt_stop_active"]) for r in got] == [
        (0, 0, 0, False), (10, 1, 600, True), (20, 0, 0, False), (30, 1, 600, False), (40, 2, 600, True), (50, 1, 600, True),
    ]
    assert "evt_status__warn" in got[0]


def test_empty_events(spark):
    df = spark.createDataFrame([], "k string, start_ts timestamp_ntz, end_ts timestamp_ntz, status string")
    assert events.event_features(df, ["k"], 10, aliases={"stop": "stop_active"}).columns == ["k", "timestamp", "evt_any_active", "evt_active_count", "evt_total_overlap_seconds", "evt_stop_active"]


def test_reconstructed_direction(spark):
    spec = dataset("sdwpf_kddcup")
    df = spark.createDataFrame([("d", "1", dt.datetime(2020, 5, 1), 1.0, True, "", 5.0, 171.0)], "dataset string, turbine_id string, timestamp timestamp_ntz, target_kw double, is_observed boolean, quality_flags string, Ndir double, Wdir double")
    df = df.withColumns({c: F.lit(1.0) for c in ("Wspd", "Etmp", "Itmp", "Pab1", "Pab2", "Pab3")})
    got = protocols.select_protocol(df, spec, "power_wd_yaw_hist_sincos").first()
    import math

    assert got["wind_direction_sin"] == pytest.approx(math.sin(math.radians(176))) and got["yaw_error_cos"] == pytest.approx(math.cos(math.radians(171)))
    with pytest.raises(ValueError):
        protocols.select_protocol(df, spec, "world_model_v1")
    with pytest.raises(ValueError):
        protocols.select_protocol(df, spec, "power_wd_yaw_lrpm_hist_sincos")


def test_masked_protocol_nulls_pitch_and_flags(spark):
    spec = dataset("kelmarsh")
    base = spark.createDataFrame([("d", "A", dt.datetime(2024, 1, 1), None, True, "")], "dataset string, turbine_id string, timestamp timestamp_ntz, target_kw double, is_observed boolean, quality_flags string")
    cols = [c for v in spec.columns.values() for c in ([v] if isinstance(v, str) else v)]
    df = base.withColumns({c: F.lit(1.0) for c in cols}).withColumn(spec.columns["pitch"][1], F.lit(120.0))
    got = protocols.select_protocol(df, spec, "power_wd_yaw_pmean_hist_sincos_masked").first()
    assert got["pitch_mean"] is None and got["pitch_mean__mask"] == 1 and got["target_kw__mask"] == 1 and got["feature_quality_flags"] == "missing_past_covariates"


def test_tiles(spark):
    df = spark.createDataFrame([("A", i, i) for i in range(5)], "turbine_id string, o int, v int")
    assert [(r["tile_row"], r["tile_col"]) for r in rows(reshape.tile(df, ["turbine_id"], "o", "v"), "value")] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert reshape.padding(df, ["turbine_id"]).count() == 4


def test_lookups_and_runs(spark):
    from panelspan.functions import runs
    from panelspan.operators import lookup

    rows_ = spark.createDataFrame([("a", 1), ("b", 2)], "variant string, v int")
    dim = spark.createDataFrame([("a", "x")], "variant string, family string")
    assert lookup.lookup(rows_, dim, "variant", required=False).count() == 2
    with pytest.raises(ValueError, match="unknown variant"):
        lookup.annotate(rows_, dim, "variant")
    assert runs.parse_stem(runs.run_stem(dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc))).hour == 3
    with pytest.raises(ValueError):
        runs.component("a/b")
