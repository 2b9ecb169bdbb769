"""Registry of experiment families: one TOML file each, checked as a whole before anything runs, and records of runs."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from panelspan.sources.specs import SOURCES

# fixed values: what a family's file may say
STATUSES = ("benchmark", "pilot", "ablation", "prototype", "archived")
TRAINING_MODES = ("zero_shot", "trainable", "analytic_baseline")
SCHEMA_VERSION = 1
TEXTS = ("family_id", "display_name", "status", "summary", "model_family", "training_mode", "implementation_root", "readme_path", "implementation_label_kind")
LISTS = ("dataset_scope", "supported_eval_protocols", "supported_result_splits", "supported_feature_protocols", "implementation_labels")
CONTRACT = ("task_id", "history_duration", "forecast_duration", "window_protocol", "split_protocol", "granularity")
OPTIONAL_TEXTS = ("runner_entrypoint", "orchestrator_entrypoint", "default_output_path", "default_output_schema_version")
OPTIONAL_LISTS = ("model_variants", "notes")


@dataclass(frozen=True)
class Family:
    family_id: str
    values: dict
    contract: dict
    bindings: dict


def _text(v) -> bool:
    return isinstance(v, str) and bool(v.strip())


def _texts(v) -> bool:
    return isinstance(v, list) and bool(v) and all(map(_text, v))


def problems(stem: str, data: dict) -> list[str]:
    """All that is wrong with a family's table by itself, in the order of the rules; paths are not looked at."""
    bindings, contract = data.get("implementation_bindings"), data.get("task_contract")
    bound = bindings if isinstance(bindings, dict) and bindings and all(_text(k) and _text(v) for k, v in bindings.items()) else None
    found = [] if data.get("schema_version") == SCHEMA_VERSION else [f"schema_version {data.get('schema_version')!r} is not {SCHEMA_VERSION}"]
    found += [f"{k}: a text is needed" for k in TEXTS if not _text(data.get(k))]
    found += [f"{k}: a list of texts is needed" for k in LISTS if not _texts(data.get(k))]
    found += [f"{k}: not a text" for k in OPTIONAL_TEXTS if k in data and not _text(data[k])]
    found += [f"{k}: not a list of texts" for k in OPTIONAL_LISTS if k in data and not (isinstance(data[k], list) and all(map(_text, data[k])))]
    found += ["task_contract: a table is needed"] if not isinstance(contract, dict) else [f"task_contract.{k}: a text is needed" for k in CONTRACT if not _text(contract.get(k))]
    found += ["implementation_bindings: a table of texts is needed"] if bound is None else []
    if found:
        return found
    if data["family_id"].strip() != stem:
        found.append(f"family_id {data['family_id']!r} differs from the file's name")
    for key, allowed in (("status", STATUSES), ("training_mode", TRAINING_MODES)):
        if data[key].strip() not in allowed:
            found.append(f"{key} {data[key]!r} is none of {', '.join(allowed)}")
    if unknown := sorted(set(data["dataset_scope"]) - set(SOURCES)):
        found.append(f"dataset_scope has unknown {unknown}")
    if set(bound) != set(data["implementation_labels"]):
        found.append("implementation_bindings and implementation_labels name different labels")
    elif set(bound.values()) != set(data["supported_feature_protocols"]):
        found.append("supported_feature_protocols and the bound protocols differ")
    if "default_output_schema_version" in data and "default_output_path" not in data:
        found.append("default_output_schema_version needs default_output_path")
    return found


def path_problems(root: str, data: dict) -> list[str]:
    """Paths of a family that leave the root or, but for the output, point to nothing."""
    base, found = os.path.realpath(root), []
    for key in ("implementation_root", "readme_path", "runner_entrypoint", "orchestrator_entrypoint", "default_output_path"):
        if key in data:
            at = os.path.realpath(os.path.join(base, data[key]))
            if os.path.commonpath([base, at]) != base:
                found.append(f"{key} {data[key]!r} is outside the root")
            elif key != "default_output_path" and not os.path.exists(at):
                found.append(f"{key} {data[key]!r} does not exist")
    return found


def load_registry(folder: str, root: str) -> dict[str, Family]:
    """The families of a folder's TOML files by id; ValueError names every file's problems at once."""
    families, wrong = {}, []
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".toml")):
        with open(os.path.join(folder, name), "rb") as f:
            data = tomllib.load(f)
        found = problems(name[:-5], data) or path_problems(root, data)
        wrong += [f"{name}: {p}" for p in found]
        if not found:
            plain = {k: data[k] for k in (*TEXTS, *LISTS, *OPTIONAL_TEXTS, *OPTIONAL_LISTS) if k in data}
            families[name[:-5]] = Family(name[:-5], plain, data["task_contract"], data["implementation_bindings"])
    if wrong:
        raise ValueError("; ".join(wrong))
    return families


def run_record(families: dict[str, Family], family_id: str, protocols: list[str], sources: list[str], **more) -> dict:
    """The record of one run, for layers.report: its family, what it selected, each name once, and what else the caller says."""
    if family_id not in families:
        raise ValueError(f"unknown experiment family {family_id!r}")
    family = families[family_id]
    if unknown := sorted(set(protocols) - set(family.values["supported_feature_protocols"])):
        raise ValueError(f"{family_id} does not support {unknown}")
    selection = {"dataset_ids": list(dict.fromkeys(sources)), "feature_protocol_ids": list(dict.fromkeys(protocols))}
    return {"schema_version": SCHEMA_VERSION, "family": family.values, "selection": selection, **more}
