"""Layered artifacts: where they are, aligned writes, reports, and whether they are fresh."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """manifest / silver / gold / tasks/<task>/<protocol> below a root, as table folders."""

    root: str
    dataset: str

    def silver(self, name: str) -> str:
        return f"{self.root}/{self.dataset}/silver/{name}"

    @property
    def gold(self) -> str:
        return f"{self.root}/{self.dataset}/gold_base/series"

    def task(self, task: str, protocol: str, name: str) -> str:
        return f"{self.root}/{self.dataset}/tasks/{task}/{protocol}/{name}"


def aligned(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The schema's columns in its order and types: missing ones null, others dropped."""
    return df.select(*[F.col(f"`{c}`").try_cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()])


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A Parquet table, committed as a whole; an empty one keeps its schema."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def report(row: dict) -> str:
    """A JSON report with sorted keys."""
    return json.dumps(row, sort_keys=True, indent=2, default=str)


def publish(spark: SparkSession, text: str, path: str) -> None:
    """One file (CSV, JSON, text) that is there as a whole or not at all: written under a dotted name, then renamed."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    made = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(made, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(made, target):
        raise OSError(f"could not publish {path}")


def publish_csv(df: DataFrame, path: str) -> None:
    """A table as one CSV with a header, rows in the frame's order; for reports, since the driver holds it."""
    import csv
    import io

    out = io.StringIO()
    put = csv.writer(out, lineterminator="\n")
    put.writerow(df.columns)
    put.writerows(df.collect())
    publish(df.sparkSession, out.getvalue(), path)


def write_report(spark: SparkSession, row: dict, path: str) -> None:
    spark.createDataFrame([(report(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def fingerprint(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def source_fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a file listing (path, length, modified): equal listings, equal digests, in any order."""
    each = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modified").cast("string")), 256)
    return files.select(each.alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("h")), ""), 256).alias("fingerprint"))


def status(stored: str | None, current: str, upstream_fresh: bool = True) -> tuple[str, str]:
    """(fresh | stale | missing, reason) of a layer."""
    if stored is None:
        return "missing", "not built"
    if not upstream_fresh:
        return "stale", "upstream is not fresh"
    return ("fresh", "") if stored == current else ("stale", "fingerprint differs")


@dataclass(frozen=True)
class Layer:
    """A built layer: what it is made from, the outputs that it must have, and the fingerprint it should carry."""

    name: str
    upstream: tuple[str, ...]
    expected: str
    stored: str | None
    missing_outputs: tuple[str, ...] = ()
    blocked: str = ""


def stamp(spark: SparkSession, path: str, value: str) -> None:
    """A layer's fingerprint, stored beside its table; written last, so that a broken build carries none."""
    publish(spark, report({"fingerprint": value}), f"{path}.fingerprint.json")


def unstamp(spark: SparkSession, path: str) -> None:
    """Takes a layer's fingerprint away before the layer is built anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.fingerprint.json")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)


def stamped(spark: SparkSession, path: str) -> str | None:
    """The stored fingerprint of a layer, if it was built."""
    at = f"{path}.fingerprint.json"
    return read_report(spark, at)["fingerprint"] if exists(spark, at) else None


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def check_layers(layers: list[Layer]) -> dict[str, tuple[str, str]]:
    """(status, reason) of each layer of a chain given in build order: fresh, stale, missing or blocked.

    A layer is judged after those it is made from; what stands on a layer that isn't fresh is stale, if built at all.
    """
    found: dict[str, tuple[str, str]] = {}
    for layer in layers:
        behind = [u for u in layer.upstream if found[u][0] != "fresh"]
        if layer.blocked:
            found[layer.name] = ("blocked", layer.blocked)
        elif layer.stored is None:
            found[layer.name] = ("missing", "not built")
        elif layer.missing_outputs:
            found[layer.name] = ("stale", f"outputs missing: {', '.join(layer.missing_outputs)}")
        elif behind:
            found[layer.name] = ("stale", f"not fresh: {', '.join(behind)}")
        else:
            found[layer.name] = status(layer.stored, layer.expected)
    return found


def check_layout(paths: list[str], required: dict[str, str]) -> tuple[dict[str, int], list[str]]:
    """(files found by the name of each required pattern, the names of those without any); patterns are globs on whole paths."""
    counts = {name: sum(fnmatch.fnmatchcase(p, glob) for p in paths) for name, glob in required.items()}
    return counts, [name for name, n in counts.items() if not n]


def read_results(spark: SparkSession, paths: list[str], schema: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """CSV results or training histories of several runs in canonical columns; columns that older files lack are null, but for the required ones."""
    out = None
    for p in paths:
        raw = spark.read.option("header", True).csv(p)
        if gone := [c for c in required if c not in raw.columns]:
            raise ValueError(f"{p} lacks {gone}")
        part = aligned(raw, schema)
        out = part if out is None else out.unionByName(part)
    return out


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned jobs that have no completed row yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")
