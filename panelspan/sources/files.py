"""Raw exports as DataFrames: banner-headed tables, status logs, station tables, day/clock panels.

Exports with a banner are read one file a row, since a header in the middle of a file
needs its lines in order; the files of such exports cover bounded periods. All cells
stay text until a cast is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspan.functions import timeutil as T
from panelspan.functions.scalars import lenient_double
from panelspan.operators.policy import normalise_headers

# fixed values: the first header cell of a banner table, and banner labels
HEADER = "Date and time"
LABELS = {"turbine": "Turbine", "device": "Device", "device_type": "Device type", "time_zone": "Time zone"}
STATUS_COLUMNS = (
    "Timestamp start", "Timestamp end", "Duration", "Status", "Code", "Message", "Comment",
    "Service contract category", "IEC category", "Global contract category", "Custom contract category",
)
IGNORED_FILES = (".DS_Store", ".swp", ".webloc")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line): every line of every file, in order; the file is its last two path parts."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = F.split(F.url_decode(F.col("path")), "/")
    name = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\n?", "\n")
    return raw.select(name.alias("source_file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _label(label: str) -> Column:
    return F.regexp_extract("line", rf"^#\s*{label}:\s*(.*?)\s*$", 1)


def banner_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, turbine, device, device_type, time_zone, header, header_no) of each file."""
    lines = _lines(spark, paths).filter(F.col("line").startswith("#"))
    is_header = F.col("line").rlike(rf"^#\s*{HEADER},")
    first = lambda c, when: F.min_by(F.when(when, c), F.when(when, F.col("line_no")))
    found = [first(_label(v), _label(v) != "").alias(k) for k, v in LABELS.items()]
    header = first(F.regexp_replace("line", r"^#\s*", ""), is_header)
    return lines.groupBy("source_file").agg(*found, header.alias("header"), F.min(F.when(is_header, F.col("line_no"))).alias("header_no"))


def read_banner_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of banner tables: all columns as text, with source_file, source_row, turbine, device and device_type.

    Headers may differ between files; a column that a file lacks is null. Only the
    distinct header lines come to the driver.
    """
    meta = banner_metadata(spark, paths).filter("header IS NOT NULL")
    headers = [r[0] for r in meta.select("header").distinct().orderBy("header").collect()]
    body = _lines(spark, paths).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    rows = body.join(meta, "source_file").filter("line_no > header_no")
    out = None
    for h in headers:
        names = [c.strip() for c in h.split(",")]
        kept = normalise_headers(names)
        cells = F.from_csv("line", ", ".join(f"c{i} STRING" for i in range(len(names))))
        part = rows.filter(F.col("header") == h).withColumn("__c", cells)
        cols = [F.col(f"__c.c{names.index(c)}").alias(c) for c in kept]
        part = part.select("source_file", F.col("line_no").alias("source_row"), "turbine", "device", "device_type", *cols)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], f"source_file string, source_row int, turbine string, device string, device_type string, `{HEADER}` string")
    return out


def read_status_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Status events: the header is the first line that isn't a comment; the asset comes from the banner.

    The asset is the turbine of a '# Turbine:' line, else the name before ' production' in
    the first such line; asset_type is 'turbine' or 'asset', and turbine_id falls back to the asset.
    """
    lines = _lines(spark, paths).filter(F.trim("line") != "")
    comment = F.col("line").startswith("#")
    turbine = F.when(comment & (_label("Turbine") != ""), _label("Turbine"))
    asset = F.regexp_extract("line", r"^#\s*(.*?) production:", 1)
    asset = F.when(comment & (asset != ""), asset)
    meta = lines.groupBy("source_file").agg(
        F.min_by(turbine, F.when(turbine.isNotNull(), F.col("line_no"))).alias("turbine"), F.min_by(asset, F.when(asset.isNotNull(), F.col("line_no"))).alias("asset"),
        F.min(F.when(~comment, F.col("line_no"))).alias("header_no"),
    )
    cells = F.from_csv("line", ", ".join(f"c{i} STRING" for i in range(len(STATUS_COLUMNS))))
    rows = lines.filter(~comment).join(meta, "source_file").filter("line_no > header_no").withColumn("__c", cells)
    named = F.coalesce("turbine", "asset")
    return rows.select(
        "source_file", F.col("line_no").alias("source_row"), named.alias("asset_id"), F.when(F.col("turbine").isNotNull(), "turbine").otherwise("asset").alias("asset_type"), named.alias("turbine_id"),
        *[F.col(f"__c.c{i}").alias(c) for i, c in enumerate(STATUS_COLUMNS)],
        T.parse(F.col("__c.c0")).alias("start_ts"), T.parse(F.col("__c.c1")).alias("end_ts"),
    )


def read_csv_text(spark: SparkSession, paths: str | list[str], nulls: tuple[str, ...] = ("NaN", "nan"), columns: list[str] | None = None) -> DataFrame:
    """A plain CSV, all columns text, null tokens as null; each file that isn't UTF-8 is read as Latin-1.

    columns: those that are wanted; the scan parses no others, and only they are looked at for bad bytes.
    """

    def scan(where, encoding: str) -> DataFrame:
        df = spark.read.option("header", True).option("encoding", encoding).csv(where)
        return df if columns is None else df.select(*[f"`{c}`" for c in df.columns if c.strip() in columns])

    df = scan(paths, "UTF-8")
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.coalesce(F.col(f"`{c}`").contains("\ufffd"), F.lit(False))
    latin = [r[0] for r in df.filter(bad).select(F.input_file_name()).distinct().collect()] if df.columns else []
    if latin:
        rest = [f for f in df.inputFiles() if f not in latin]
        other = scan(latin, "ISO-8859-1")
        df = scan(rest, "UTF-8").unionByName(other, allowMissingColumns=True) if rest else other
    df = df.toDF(*normalise_headers(df.columns))
    return df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*nulls), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_station_tables(spark: SparkSession, paths: list[str], time: str = "TimeStamp") -> DataFrame:
    """Station tables of several files with __source_file_idx and __source_row_nr, the order that settles duplicates."""
    ordered = sorted(paths)
    out = None
    for i, p in enumerate(ordered):
        part = read_csv_text(spark, p)
        # one file is one ordered scan; the id grows with the row's place in it
        part = part.withColumn("__source_file_idx", F.lit(i)).withColumn("__source_row_nr", F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("timestamp", T.parse(time))


def read_day_clock(spark: SparkSession, path: str, numeric: list[str], entity: str = "TurbID", day: str = "Day", clock: str = "Tmstamp") -> DataFrame:
    """A day/clock panel with derived timestamps and lenient numbers."""
    df = read_csv_text(spark, path)
    keep = [c for c in numeric if c in df.columns]
    return df.select(F.trim(F.col(entity)).alias("turbine_id"), T.day_clock(F.col(day).try_cast("int"), F.trim(F.col(clock))).alias("timestamp"), F.col(day).try_cast("int").alias("day"), F.col(clock).alias("clock"), *[lenient_double(c).alias(c) for c in keep])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified): all files below a root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    skip = F.lit(False)
    for s in IGNORED_FILES:
        skip = skip | F.col("path").endswith(s)
    return files.filter(~skip)


def file_name_facts(files: DataFrame) -> DataFrame:
    """Asset kind, entity and covered dates from file names such as Kind_Entity_2020-01-01_-_2020-12-31_7.csv."""
    name = F.element_at(F.split(F.url_decode("path"), "/"), -1)
    pattern = r"^(Turbine_Data|Device_Data|Status)_(.+?)_(\d{4}-\d{2}-\d{2})_-_(\d{4}-\d{2}-\d{2})_"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return files.select("path", part(1).alias("kind"), F.translate(part(2), "_", " ").alias("entity"), part(3).alias("first_day"), part(4).alias("last_day"))


def release_of(facts: DataFrame, releases: dict[str, str]) -> str | None:
    """The release whose last day is the files' last day; releases maps names to last days."""
    last = facts.agg(F.max("last_day")).first()[0]
    return next((n for n, d in releases.items() if d == last), None)


def time_audit(rows: DataFrame, minutes: int = 10) -> DataFrame:
    """What a day/clock panel must satisfy: minutes a day, day range, rows per entity, unread clocks, deltas of the first entity."""
    per = rows.groupBy("turbine_id").agg(F.count("*").alias("n"))
    first = rows.agg(F.min("turbine_id").alias("turbine_id"))
    deltas = rows.join(F.broadcast(first), "turbine_id").withColumn("d", (T.seconds("timestamp") - T.seconds(F.lag("timestamp").over(Window.partitionBy("turbine_id").orderBy("timestamp")))) / 60)
    odd = deltas.agg(F.count_if(F.col("d") != minutes).alias("odd_deltas"))
    sizes = per.agg(F.min("n").alias("min_rows"), F.max("n").alias("max_rows"))
    whole = rows.agg(F.count_distinct("clock").alias("clocks"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("timestamp").isNull()).alias("unread"))
    out = whole.crossJoin(sizes).crossJoin(odd)  # three single rows
    ok = (F.col("clocks") == 1440 / minutes) & (F.col("unread") == 0) & (F.col("odd_deltas") == 0) & (F.col("min_rows") == F.col("max_rows")) & (F.col("first_day") == 1)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))
