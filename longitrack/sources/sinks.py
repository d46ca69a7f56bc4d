"""Result tables and run records.

Tables are written as Parquet, the form later stages read, and optionally as CSV for export. Run
records are small JSON and Markdown files written by the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from dataclasses import asdict, is_dataclass
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


# Columns that exported rows are sorted by, as far as a table has them.
EXPORT_ORDER = ("match_policy", "pair_gap", "day_a", "day_b", "label_a", "label_b", "roi_id", "day", "channel")


class Store:
    """Tables of one run, below one folder."""

    def __init__(self, spark: SparkSession, folder: str | Path, csv: bool = False) -> None:
        self.spark, self.folder, self.csv = spark, str(folder), csv

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write a table and return it as read back; later steps never read a path being overwritten."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        written = self.spark.read.schema(df.schema).parquet(self.path(name))
        if self.csv:
            flat = [c for c, t in written.dtypes if not t.startswith(("array", "struct", "map"))]
            order = [c for c in EXPORT_ORDER if c in flat]
            # A range sort: the part files follow each other in order, whatever their number.
            rows = written.select(*flat).orderBy(*order) if order else written.select(*flat)
            rows.write.mode("overwrite").csv(self.path(f"{name}.csv"), header=True)
        return written

    def replace_partitions(self, name: str, df: DataFrame, partition_by: tuple[str, ...]) -> DataFrame:
        """Replace the partitions that ``df`` has rows of; the others stay. ``df`` must not read the table."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def has(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name))
            return True
        except AnalysisException:
            return False

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """A table of the run; with a schema a missing table is read as an empty one."""
        if not self.has(name):
            if schema is None:
                raise FileNotFoundError(f"no table {name} in {self.folder}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))


def read_csv_table(spark: SparkSession, path: str | Path, schema: StructType) -> DataFrame:
    """A CSV table with a known schema; a missing or empty file is an empty table."""
    file = Path(path)
    if not file.exists() or (file.is_file() and file.stat().st_size == 0):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(str(path), header=True, mode="FAILFAST")


def first_existing(folder: str | Path, names: list[str]) -> Path | None:
    """The first of several table names that exists."""
    return next((Path(folder, n) for n in names if Path(folder, n).exists()), None)


def tolerant_bool(column: str) -> Column:
    """Booleans as spreadsheets write them."""
    return F.lower(F.trim(F.col(column).cast("string"))).isin("true", "1", "yes", "y")


def filter_policy(df: DataFrame, policy: str) -> DataFrame:
    """Rows whose every policy column equals ``policy``; no such row is an error."""
    columns = [c for c in df.columns if c.startswith("match_policy")]
    if not columns:
        return df
    for c in columns:
        df = df.where(F.col(c) == policy)
    if df.isEmpty():
        raise ValueError(f"no rows for match policy {policy!r}")
    return df


def digest(path: str | Path) -> str:
    """SHA-256 of a file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def file_digests(spark: SparkSession, paths: dict[str, str | Path]) -> dict[str, str]:
    """SHA-256 of every named file, read by the executors; the driver gets one digest a file."""
    rows = [(name, str(path)) for name, path in paths.items()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.string())], names=["name", "sha256"])

    tasks = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    frame = spark.createDataFrame(rows, "name string, path string").repartition(tasks)
    return {r.name: r.sha256 for r in frame.mapInArrow(read, "name string, sha256 string").collect()}


def plain(value):
    """JSON-ready form of parameters, paths and dates."""
    if is_dataclass(value):
        return {k: plain(v) for k, v in asdict(value).items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_json(path: str | Path, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(value), indent=2, sort_keys=True), encoding="utf-8")


def read_json(path: str | Path) -> dict:
    """The content of a JSON file, or an empty record when there is none."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.exists() and file.stat().st_size else {}


def same_run(path: str | Path, fingerprint: dict) -> bool:
    """Whether the run recorded at ``path`` had the same inputs and parameters."""
    return read_json(path).get("fingerprint") == plain(fingerprint)


def hms(seconds: float) -> str:
    """Duration as HH:MM:SS."""
    whole = int(round(seconds))
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"


def safe_name(text: str) -> str:
    """File-name form of a text."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("_")


class StageTimer:
    """Durations of the stages of a run, for its log."""

    def __init__(self) -> None:
        self.start = self.last = time.perf_counter()
        self.seconds: dict[str, float] = {}

    def done(self, stage: str) -> None:
        now = time.perf_counter()
        self.seconds[stage] = round(now - self.last, 3)
        self.last = now

    def record(self) -> dict:
        total = time.perf_counter() - self.start
        return {
            "finished_at": datetime.now(timezone.utc).isoformat(), "stage_durations_seconds": self.seconds,
            "elapsed": hms(total), "versions": {"pyspark": pyspark.__version__},
        }
