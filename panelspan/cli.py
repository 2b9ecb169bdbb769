"""Command line: build or check task bundles from stored observations.

build writes the gold panel and the bundle, each with a fingerprint of what it was made from, and leaves a layer that
is fresh alone; check prints each layer's status. Exit codes: 0 done, 1 a dataset failed or isn't fresh, 2 bad arguments.
"""

from __future__ import annotations

import argparse
import sys

from panelspan import api
from panelspan.session import session
from panelspan.sources import files, layers
from panelspan.sources.layers import Layout, write
from panelspan.sources.specs import TaskSpec


def _layers(spark, spec, task, layout: Layout, protocol: str, observations: str) -> dict[str, tuple[str, layers.Layer]]:
    """Gold and task layers by name, each with its folder."""
    source = layers.source_fingerprint(files.list_files(spark, observations)).first()[0]
    gold = layers.fingerprint([source, spec.dataset_id, spec.resolution_minutes, list(spec.entities)])
    made = layers.fingerprint([gold, task.task_id, task.stride, protocol])
    at = layout.task(task.task_id, protocol, "").rstrip("/")
    gone = tuple(p for p in api.PARTS if not layers.exists(spark, layout.task(task.task_id, protocol, p)))
    return {
        "gold": (layout.gold, layers.Layer("gold", (), gold, layers.stamped(spark, layout.gold), () if layers.exists(spark, layout.gold) else ("series",))),
        "task": (at, layers.Layer("task", ("gold",), made, layers.stamped(spark, at), gone)),
    }


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="panelspan")
    p.add_argument("command", choices=["build", "check"])
    p.add_argument("dataset", nargs="+", choices=api.list_sources())
    p.add_argument("--observations", required=True, help="Parquet of (dataset, turbine_id, timestamp, target_kw, ...)")
    p.add_argument("--root", required=True)
    p.add_argument("--history", default="24h")
    p.add_argument("--forecast", default="6h")
    p.add_argument("--protocol", default="power_only")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark, failed = session(), 0
    for name in args.dataset:
        try:
            spec, task, layout = api.get_dataset_spec(name), TaskSpec(args.history, args.forecast), Layout(args.root, name)
            known = _layers(spark, spec, task, layout, args.protocol, args.observations)
            found = layers.check_layers([layer for _, layer in known.values()])
            if args.command == "check":
                for layer, (state, reason) in found.items():
                    print(name, layer, state, reason)
                failed |= any(state != "fresh" for state, _ in found.values())
                continue
            (gold_at, gold), (task_at, bundle) = known.values()
            if found["gold"][0] != "fresh":
                layers.unstamp(spark, task_at)
                layers.unstamp(spark, gold_at)
                obs = spark.read.parquet(args.observations).filter(f"dataset = '{name}'")
                write(api.build_gold(obs, spec), gold_at)
                layers.stamp(spark, gold_at, gold.expected)
            if found["task"][0] != "fresh":
                layers.unstamp(spark, task_at)
                api.save_bundle(api.build_bundle(spark.read.parquet(gold_at), spec, task, args.protocol), layout, task, args.protocol)
                layers.stamp(spark, task_at, bundle.expected)
        except Exception as e:  # one dataset's failure doesn't stop the others
            print(f"{name}: {e}", file=sys.stderr)
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main())
