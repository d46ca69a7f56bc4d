"""Dated image files: name parsing, per-day lookups and calendar weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed format: YYYYMMDD_R or YYYYMMDD_G, further tokens, an optional final SyN, and .tif.
NAME = r"^([0-9]{8})_([RG])((?:_[^_]*)*)\.(?i:tif)$"


# Fixed names: short names of datasets and the folders they stand for; the first one is the default.
DATASETS = {"1050": "1050_data", "920": "920_data"}


def dataset_folder(spark: SparkSession, root: str, dataset: str | None = None) -> str:
    """Folder of a dataset below ``root``: a short name, the name of a folder, or a path of its own.

    A folder that Spark's readers cannot list is an error. ``root`` may lie in any store they reach.
    """
    name = next(iter(DATASETS)) if dataset is None else str(dataset)
    own = name.startswith("/") or "://" in name
    folder = name if own else f"{str(root).rstrip('/')}/{DATASETS.get(name, name)}"
    try:
        found = spark.read.format("binaryFile").load(folder).select("path").head(1)
    except AnalysisException as error:
        raise FileNotFoundError(f"no dataset folder {folder}") from error
    if found and found[0].path.rstrip("/").endswith(folder.rstrip("/").split("://")[-1]):
        raise NotADirectoryError(f"dataset path {folder} is a file")
    return folder


def analysis_folder(spark: SparkSession, root: str, dataset: str | None = None) -> str:
    """Where the results of a dataset are kept; it need not exist."""
    return f"{dataset_folder(spark, root, dataset)}/analysis"


def inverse_mask_channel(dataset: str | None) -> str:
    """Channel whose registration a dataset's inverse masks follow: green for the 920 recordings, else red."""
    text = "" if dataset is None else str(dataset).lower()
    return "green" if text.rstrip("/").split("/")[-1].startswith("920") or DATASETS["920"] in text else "red"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the TIFF files in one folder, listed by Spark without reading their content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    )


def parse_names(files: DataFrame) -> DataFrame:
    """Date, channel and registration flag of every valid name; masks and object files are dropped."""
    tokens = F.filter(F.split(F.lower(F.regexp_extract("name", NAME, 3)), "_"), lambda t: t != "")
    last = F.element_at(F.col("_tokens"), -1)
    parsed = files.where(F.col("name").rlike(NAME)).withColumn("_tokens", tokens)
    is_syn = F.coalesce(F.try_element_at(F.col("_tokens"), F.lit(-1)) == "syn", F.lit(False))
    misplaced = F.array_contains("_tokens", "syn") & (last != "syn")
    unwanted = F.exists("_tokens", lambda t: t.contains("mask") | (t == "roi"))
    return (
        parsed.where(~F.when(F.size("_tokens") > 0, misplaced | unwanted).otherwise(F.lit(False)))
        .withColumn("date_key", F.regexp_extract("name", NAME, 1))
        .withColumn("channel", F.when(F.regexp_extract("name", NAME, 2) == "R", "red").otherwise("green"))
        .withColumn("is_syn", is_syn)
        .drop("_tokens")
    )


def day_of(date_key: str | Column, start: str | Column) -> Column:
    """Days from the start date, both as YYYYMMDD."""
    start = F.lit(start) if isinstance(start, str) else start
    key = F.col(date_key) if isinstance(date_key, str) else date_key
    return F.datediff(F.try_to_date(key, "yyyyMMdd"), F.to_date(start, "yyyyMMdd"))


def start_date(parsed: DataFrame) -> DataFrame:
    """Earliest date among the raw files."""
    return parsed.where(~F.col("is_syn")).agg(F.min("date_key").alias("start_date"))


def registered_lookup(parsed: DataFrame, start: str | Column, day0_mode: str = "raw") -> DataFrame:
    """One registered file per day and channel: later days registered, day 0 raw or registered.

    Of several files the last one in name order is used.
    """
    if day0_mode not in ("raw", "syn"):
        raise ValueError("day0_mode must be raw or syn")
    day0 = F.col("is_syn") if day0_mode == "syn" else ~F.col("is_syn")
    dated = parsed.withColumn("day", day_of("date_key", start)).where(F.col("day") >= 0)
    return dated.where(F.when(F.col("day") == 0, day0).otherwise(F.col("is_syn"))).groupBy("day", "channel").agg(
        F.max("name").alias("name")
    )


def raw_lookup(parsed: DataFrame, start: str | Column) -> DataFrame:
    """One raw file per day and channel."""
    dated = parsed.where(~F.col("is_syn")).withColumn("day", day_of("date_key", start))
    return dated.where(F.col("day") >= 0).groupBy("day", "channel").agg(F.max("name").alias("name"))


def inverse_masks(files: DataFrame, start: str, suffix: str = "_ROI_mask_SyN_inversed.tif", channel: str | None = None) -> DataFrame:
    """One inverse-warped mask per day; several are an error unless exactly one has the wanted channel."""
    tag = {"red": "_R_", "green": "_G_", None: None}[channel]
    masks = files.where(F.col("name").endswith(suffix)).withColumn("day", day_of(F.substring("name", 1, 8), start))
    wanted = F.col("name").contains(tag) if tag else F.lit(False)
    per_day = masks.groupBy("day").agg(
        F.count(F.lit(1)).alias("_n"), F.min("name").alias("_only"),
        F.count(F.when(wanted, 1)).alias("_m"), F.min(F.when(wanted, F.col("name"))).alias("_tagged"),
    )
    name = (
        F.when(F.col("_n") == 1, F.col("_only"))
        .when(F.col("_m") == 1, F.col("_tagged"))
        .otherwise(F.raise_error(F.concat(F.lit("ambiguous inverse masks for day "), F.col("day").cast("string"))))
    )
    return per_day.select("day", name.alias("name"))


def missing_channels(lookup: DataFrame, channels: Sequence[str] = ("red", "green")) -> DataFrame:
    """Day and channel combinations without a file, for days that have at least one."""
    wanted = F.array(*[F.lit(c) for c in channels])
    have = lookup.groupBy("day").agg(F.collect_set("channel").alias("_have"))
    return have.select("day", F.explode(F.array_except(wanted, F.col("_have"))).alias("channel"))


def calendar_weeks(lookup: DataFrame) -> DataFrame:
    """Imaging days grouped by the Monday of their week, numbered in time order per row count.

    ``week_start`` identifies the week; a week holds at most seven days.
    """
    day = lookup.select("day", F.try_to_date(F.substring("name", 1, 8), "yyyyMMdd").alias("_d")).groupBy("day").agg(
        F.min("_d").alias("_d")
    )
    return day.groupBy(F.to_date(F.date_trunc("week", "_d")).alias("week_start")).agg(
        F.array_sort(F.collect_list("day")).alias("days"),
        F.array_sort(F.collect_list(F.date_format("_d", "yyyyMMdd"))).alias("date_keys"),
    )
