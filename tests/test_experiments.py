"""Experiment families: whole, broken in one way each, and the records of their runs."""

import pytest

from panelspan.sources import experiments as E

GOOD = {
    "schema_version": 1, "family_id": "naive", "display_name": "Naive", "status": "benchmark", "summary": "Last value held.", "model_family": "persistence", "training_mode": "analytic_baseline",
    "implementation_root": "code", "readme_path": "code/README.md", "implementation_label_kind": "variant", "dataset_scope": ["kelmarsh"], "supported_eval_protocols": ["rolling"],
    "supported_result_splits": ["test"], "supported_feature_protocols": ["power_only"], "implementation_labels": ["a"], "implementation_bindings": {"a": "power_only"},
    "task_contract": {"task_id": "t", "history_duration": "24h", "forecast_duration": "6h", "window_protocol": "rolling", "split_protocol": "chronological", "granularity": "farm"},
}


def test_a_whole_family_has_no_problems():
    assert E.problems("naive", GOOD) == []


@pytest.mark.parametrize(
    "change, word",
    [
        ({"schema_version": 2}, "schema_version"), ({"display_name": " "}, "display_name"), ({"status": "done"}, "status"), ({"training_mode": "none"}, "training_mode"),
        ({"dataset_scope": ["mars"]}, "mars"), ({"dataset_scope": "kelmarsh"}, "dataset_scope"), ({"implementation_labels": ["b"]}, "labels"), ({"supported_feature_protocols": ["world_model_v1"]}, "bound protocols"),
        ({"implementation_bindings": {}}, "implementation_bindings"), ({"task_contract": {}}, "task_contract.task_id"), ({"task_contract": 1}, "task_contract"), ({"default_output_schema_version": "1"}, "default_output_path"),
        ({"notes": "x"}, "notes"), ({"family_id": "other"}, "file's name"),
    ],
)
def test_one_fault_is_one_problem(change, word):
    found = E.problems("naive", {**GOOD, **change})
    assert found and word in found[0]


def _toml(data: dict) -> str:
    plain = [f"{k} = {v!r}" for k, v in data.items() if not isinstance(v, dict)]
    tables = [f"[{k}]\n" + "\n".join(f"{a} = {b!r}" for a, b in v.items()) for k, v in data.items() if isinstance(v, dict)]
    return "\n".join(plain + tables).replace("'", '"')


def test_registry_and_run_records(tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "README.md").write_text("x")
    folder = tmp_path / "families"
    folder.mkdir()
    (folder / "naive.toml").write_text(_toml(GOOD))
    families = E.load_registry(str(folder), str(tmp_path))
    assert list(families) == ["naive"] and families["naive"].bindings == {"a": "power_only"}
    record = E.run_record(families, "naive", ["power_only", "power_only"], ["kelmarsh"], row_count=3)
    assert record["selection"]["feature_protocol_ids"] == ["power_only"] and record["row_count"] == 3
    with pytest.raises(ValueError, match="world_model_v1"):
        E.run_record(families, "naive", ["world_model_v1"], [])
    with pytest.raises(ValueError, match="unknown"):
        E.run_record(families, "other", [], [])
    (folder / "out.toml").write_text(_toml({**GOOD, "family_id": "out", "implementation_root": "../elsewhere"}))
    (folder / "gone.toml").write_text(_toml({**GOOD, "family_id": "gone", "readme_path": "nothing.md"}))
    with pytest.raises(ValueError, match="gone.toml: readme_path.*out.toml: implementation_root"):
        E.load_registry(str(folder), str(tmp_path))
