"""Panels, windows, splits, persistence: small cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspan import api
from panelspan.operators import metrics, panel, protocols, windows
from panelspan.sources.specs import TaskSpec, dataset
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
STEP = dt.timedelta(minutes=10)
SCHEMA = "dataset string, turbine_id string, timestamp timestamp_ntz, target_kw double"


def obs(spark, cells):
    return spark.createDataFrame([("d", e, T0 + i * STEP, None if v is None else float(v)) for e, i, v in cells], SCHEMA)


def test_grid_fills_gaps_and_drops_off_grid(spark):
    o = obs(spark, [("A", 0, 1), ("A", 2, None), ("B", 1, 5)]).union(spark.createDataFrame([("d", "A", T0 + dt.timedelta(minutes=3), 9.0)], SCHEMA))
    got = rows(panel.fill_grid(o, None, 10), "turbine_id", "timestamp")
    assert [(r["turbine_id"], r["is_observed"], r["quality_flags"]) for r in got] == [
        ("A", True, ""), ("A", False, "missing_row|missing_target"), ("A", True, "missing_target"),
        ("B", False, "missing_row|missing_target"), ("B", True, ""), ("B", False, "missing_row|missing_target"),
    ]


def test_duplicate_keys_multiply_and_are_counted(spark):
    p = panel.fill_grid(obs(spark, [("A", 0, 1), ("A", 0, 2), ("A", 1, 3)]), None, 10)
    assert p.count() == 3
    assert panel.quality_totals(p).first()["duplicate_key_count"] == 1


def test_expected_entities_missing_from_the_panel_leave_no_complete_window(spark):
    p = panel.fill_grid(obs(spark, [("A", i, i) for i in range(4)]), None, 10)
    got = rows(windows.farm_windows(panel.farm_summary(p, 2), 2, 1), "window_id")
    assert len(got) == 2 and not any(r["is_complete_input"] or r["is_complete_output"] for r in got)


def test_early_end_flags(spark):
    p = panel.fill_grid(obs(spark, [("A", i, i) for i in range(6)] + [("B", i, i) for i in range(4)]), None, 10)
    got = rows(windows.farm_windows(panel.farm_summary(p, 2), 2, 1), "window_id")
    assert [r["quality_flags"] for r in got] == ["", "", "partial_output|row_quality_issues", "partial_input|partial_output|row_quality_issues"]
    assert sum(r["is_complete_output"] for r in got) == 2
    assert got[0]["input_observed"] == [2, 2] and got[2]["output_with_target"] == [1]


def test_no_windows_on_a_short_axis_or_empty_panel(spark):
    p = panel.fill_grid(obs(spark, [("A", 0, 1)]), None, 10)
    assert windows.farm_windows(panel.farm_summary(p, 1), 3, 2).count() == 0
    empty = panel.fill_grid(obs(spark, []), None, 10)
    assert windows.farm_windows(panel.farm_summary(empty, 1), 3, 2).count() == 0


@pytest.mark.parametrize("block", [4096, 7, 5])
def test_windows_don_t_depend_on_blocks_and_spans(spark, block):
    """Frames over blocks with copied borders, and ordinals over spans, against plain Python over each dataset's whole axis."""
    import random

    rng = random.Random(block)
    cells = [("a" if d else "b", e, i, rng.choice([None, 1.0, 2.0])) for d in (0, 1) for e in "AB" for i in range(40 - d * 7) if rng.random() < 0.9]
    o = spark.createDataFrame([(d, e + d, T0 + i * 60 * STEP, v) for d, e, i, v in cells], SCHEMA)
    p = panel.fill_grid(o, None, 600)
    summary = panel.farm_summary(p, 2)
    per = {}
    for r in rows(summary, "dataset", "timestamp"):
        per.setdefault(r["dataset"], []).append(r)
    numbered = rows(windows.with_ordinals(summary, span=100_000), "dataset", "timestamp")
    assert [(r["__i"], r["__n"]) for r in numbered] == [(i, len(v)) for v in per.values() for i in range(len(v))]
    got = rows(windows.farm_windows(summary, 3, 2, block=block), "dataset", "window_id")
    want = [(d, i - 2, [x["with_target"] for x in v[i - 2 : i + 1]], [x["with_target"] for x in v[i + 1 : i + 3]], v[i - 2]["timestamp"], v[i + 2]["timestamp"]) for d, v in per.items() for i in range(2, len(v) - 2)]
    assert [(r["dataset"], r["window_id"], r["input_with_target"], r["output_with_target"], r["input_start_ts"], r["output_end_ts"]) for r in got] == want
    valid = {(r["dataset"], r["timestamp"]): r["valid_targets"] for r in rows(windows.valid_target_windows(p, 4, block))}
    assert valid == {(d, v[i]["timestamp"]): n for d, v in per.items() for i in range(len(v)) if (n := sum(x["with_target"] for x in v[i + 1 : i + 5]))}


def test_grids_of_several_sources_keep_to_their_entities(spark):
    o = spark.createDataFrame([("x", "a1", T0, 1.0), ("x", "a1", T0 + 2 * STEP, 2.0), ("y", "b1", T0 + STEP, 3.0), ("y", "b2", T0 + 2 * STEP, 4.0)], SCHEMA)
    want = [("x", "a1", 0, True), ("x", "a1", 1, False), ("x", "a1", 2, True), ("y", "b1", 1, True), ("y", "b1", 2, False), ("y", "b2", 1, False), ("y", "b2", 2, True)]
    for entities in (None, o.select("dataset", "turbine_id").distinct()):
        got = rows(panel.fill_grid(o, entities, 10), "dataset", "turbine_id", "timestamp")
        assert [(r["dataset"], r["turbine_id"], (r["timestamp"] - T0) // STEP, r["is_observed"]) for r in got] == want


def test_static_rows_count_as_wholes(spark):
    from panelspan.operators import protocols

    static = spark.createDataFrame([("A", 2, 1), ("A", 1, 2), ("C", 5, 5)], "turbine_id string, p int, q int")
    got = rows(protocols.static_table(static, {"p": "int", "q": "int", "r": "string"}, ["B", "A"], spark), "turbine_index")
    assert [(r["turbine_id"], r["p"], r["q"], r["r"]) for r in got] == [("B", None, None, None), ("A", 1, 2, None)]
    first = protocols.static_table(static, {"p": "int", "q": "int"}, ["A"], spark, order=("q",)).first()
    assert (first["p"], first["q"]) == (2, 1)


def test_open_events_that_start_together_end_together(spark):
    from panelspan.operators import events

    e = spark.createDataFrame([("k", T0, None, i) for i in range(3)] + [("k", T0 + STEP, None, 9)], "key string, start_ts timestamp_ntz, end_ts timestamp_ntz, id int")
    got = rows(events.effective_ends(e, ["key"], 10), "id")
    assert [r["effective_end"] for r in got] == [T0 + STEP] * 3 + [T0 + 2 * STEP]


def test_masked_windows(spark):
    p = panel.fill_grid(obs(spark, [("A", i, i) for i in range(5)]), None, 10)
    p = p.withColumn("target_kw__mask", (F.col("target_kw") == 2).cast("int"))
    got = rows(windows.farm_windows(panel.farm_summary(p, 1), 3, 2), "window_id")
    assert got[0]["input_masked"] == [0, 0, 1] and got[0]["quality_flags"] == "masked_input"


def test_persistence_ramp(spark):
    """Targets 0…7, three steps of history and two of forecast: errors of 1 and 2."""
    spec = dataset("kelmarsh")
    p = panel.fill_grid(obs(spark, [("A", i, i) for i in range(8)]), None, 10)
    got = {k: rows(v) for k, v in api.persistence(p, TaskSpec("30m", "20m"), spec.resolution_minutes, 2.0).items()}
    s = got["summary"][0]
    assert s["prediction_count"] == 8 and s["mae"] == 1.5 and s["rmse"] == pytest.approx(2.5**0.5)
    assert s["mae_pu"] == 0.75 and s["rmse_pu"] == pytest.approx(0.625**0.5)
    assert {r["horizon"]: r["mae"] for r in got["per_horizon"]} == {1: 1.0, 2: 2.0}


def test_split_keeps_only_contained_windows(spark):
    p = panel.fill_grid(obs(spark, [("A", i, i) for i in range(10)]), None, 10)
    bounds = windows.split_bounds(p)
    assert {r["split"]: r["n_steps"] for r in rows(bounds)} == {"train": 7, "val": 1, "test": 2}
    index = windows.farm_windows(panel.farm_summary(p, 1), 1, 1)
    kept = rows(windows.split_windows(index, bounds), "window_id")
    assert [(r["window_id"], r["split"]) for r in kept] == [(i, "train") for i in range(6)] + [(8, "test")]


def test_thin_and_align(spark):
    p = panel.fill_grid(obs(spark, [("A", i, i) for i in range(12)]), None, 10)
    index = windows.farm_windows(panel.farm_summary(p, 1), 2, 3)
    assert [r["window_id"] for r in rows(windows.thin(index, 3), "window_id")] == [0, 3, 6]
    assert windows.align([index.filter("window_id < 5"), index.filter("window_id > 2")]).count() == 2


def test_steps_since_valid_and_last_valid(spark):
    p = panel.fill_grid(obs(spark, [("A", 0, None), ("A", 1, 4), ("A", 3, None)]), None, 10)
    assert [r["since_valid"] for r in rows(windows.steps_since_valid(p, 4), "timestamp")] == [1.0, 0.0, 0.25, 0.5]
    assert [r["last_valid"] for r in rows(windows.last_valid(p, 2), "timestamp")] == [None, 4.0, 4.0, None]


def test_errors_without_pairs_are_null(spark):
    df = spark.createDataFrame([("d", 1, None, 1.0)], "dataset string, horizon int, actual double, predicted double")
    got = metrics.errors(df, ["dataset"]).first()
    assert got["prediction_count"] == 0 and got["mae"] is None


def test_lead_buckets_are_means_of_rmse(spark):
    df = spark.createDataFrame([("d", 1, 1.0, 1.0), ("d", 2, 3.0, 3.0), ("d", 13, 5.0, 5.0)], "dataset string, horizon int, mae double, rmse double")
    assert {r["bucket"]: r["rmse"] for r in rows(metrics.lead_buckets(df, ["dataset"]))} == {"1-12": 2.0, "13-24": 5.0}


def test_bundle_round_trip(spark, tmp_path):
    from panelspan.sources.layers import Layout

    spec = dataset("kelmarsh")
    cells = [(e, i, i) for e in spec.entities for i in range(12)]
    gold = api.build_gold(obs(spark, cells).withColumn("dataset", F.lit("kelmarsh")), spec)
    task = TaskSpec("30m", "20m")
    bundle = api.build_bundle(gold, spec, task, "power_only")
    layout = Layout(str(tmp_path), "kelmarsh")
    api.save_bundle(bundle, layout, task, "power_only")
    back = api.load_bundle(spark, layout, task, "power_only")
    assert back.report.first()["fully_synchronous"] == back.window_index.count() == 8
    assert set(back.known_future.columns) == {*protocols.groups_of("world_model_v1").known_future}
    assert api.quality_report(gold, spec)["missing_row_count"] == 0


def test_a_bundle_has_every_column_that_its_groups_name(spark):
    spec = dataset("kelmarsh")
    gold = api.build_gold(obs(spark, [(e, i, i) for e in spec.entities for i in range(3)]).withColumn("dataset", F.lit("kelmarsh")), spec)
    groups = protocols.groups_of("world_model_v1")
    native = [c for v in spec.columns.values() for c in ([v] if isinstance(v, str) else v)]
    wide = gold.withColumns({c: F.lit(1.0) for c in (*native, *groups.local, *groups.site)}).withColumn(groups.site[0], F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="farm_pmu"):
        protocols.select_protocol(wide.drop(groups.site[0]), spec, "world_model_v1")
    bundle = api.build_bundle(wide, spec, TaskSpec("20m", "10m"), "world_model_v1")
    named = bundle.context.first()["groups"]
    for part, names in (("series", ["local_values", "local_masks", "global_values", "global_masks", "target_masks"]), ("known_future", ["known_future"]), ("static", ["static"]), ("pairwise", ["pairwise"])):
        assert {c for n in names for c in named[n]} <= set(getattr(bundle, part).columns), part
    got = bundle.series.first()
    assert (got[f"{groups.site[0]}__mask"], got[f"{groups.site[1]}__mask"], got["feature_quality_flags"]) == (1, 0, "missing_past_covariates")
