"""Shared plumbing of the training-data operators: tables, cut lineage, column hygiene.

Tables that cut lineage live in the shared folder until the driver's JVM ends, unless
they are discarded before: a step whose result is written discards what it read.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once a session; they fetch it from the driver.

    Operators that run Python there call this before they build their plans.
    """
    sc = spark.sparkContext
    if getattr(sc, "_panelspan_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "panelspan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._panelspan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is used only in local mode, where there is one machine; a
    cluster whose session names none is an error, since its machines share no other.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "panelspan-shared")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is put there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _on_files(spark, path, lambda fs, p: fs.deleteOnExit(p))
    _MADE.append(path)
    return path


#: Paths given out and not yet discarded, in order.
_MADE: list[str] = []


def _on_files(spark: SparkSession, path: str, act) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _on_files(spark, path, lambda fs, p: fs.delete(p, True))
        _MADE.remove(path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    Survives the loss of any executor, and gives later plans true sizes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s result, cut; the tables cut on the way are discarded, since only the result is read from here on."""
    before = len(_MADE)
    out = cut(make(), label)
    _remove(spark, _MADE[before:-1])
    return out


def broadcast_value(spark: SparkSession, value):
    """A Python broadcast; callers check or bound the size of value first."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def remainder(col: str, n: int):
    """crc32 of the column as text, modulo n; a null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unused(taken: list[str], name: str) -> str:
    """name, with underscores put before it until no column is called so (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
