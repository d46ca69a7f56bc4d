"""Session manifests: a small CSV with one row per acquisition, validated on the driver."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

COLUMNS = (
    "session_index", "session_id", "acquisition_date", "mask_path", "red_image_path", "green_image_path", "required",
)


@dataclass(frozen=True)
class Session:
    session_index: int
    session_id: str
    acquisition_date: date
    mask_path: Path
    red_image_path: Path | None
    green_image_path: Path | None
    required: bool


def strict_bool(text: str | None, row: int) -> bool:
    value = (text or "").strip().lower()
    if value not in ("true", "false"):
        raise ValueError(f"row {row}: required must be true or false, not {text!r}")
    return value == "true"


def _path(text: str | None, folder: Path, name: str, row: int, optional: bool) -> Path | None:
    value = (text or "").strip()
    if not value:
        if optional:
            return None
        raise ValueError(f"row {row}: empty {name}")
    path = Path(value).expanduser()
    return (path if path.is_absolute() else folder / path).resolve()


def load_manifest(path: str | Path) -> list[Session]:
    """Sessions in order of their index; every violation of the format names its row."""
    path = Path(path).resolve()
    if not path.is_file():
        raise FileNotFoundError(f"no manifest file: {path}")
    with path.open(encoding="utf-8", newline="") as handle:
        reader = csv.DictReader(handle)
        missing = sorted(set(COLUMNS) - {c.strip() for c in reader.fieldnames or ()})
        if missing:
            raise ValueError(f"manifest lacks the columns: {', '.join(missing)}")
        sessions = []
        for number, row in enumerate(reader, start=2):
            text = {k: (row.get(k) or "").strip() for k in COLUMNS}
            try:
                index = int(text["session_index"])
            except ValueError:
                raise ValueError(f"row {number}: invalid session_index {text['session_index']!r}") from None
            if not text["session_id"]:
                raise ValueError(f"row {number}: empty session_id")
            try:
                day = date.fromisoformat(text["acquisition_date"])
            except ValueError:
                raise ValueError(f"row {number}: invalid acquisition_date {text['acquisition_date']!r}") from None
            sessions.append(Session(
                index, text["session_id"], day,
                _path(text["mask_path"], path.parent, "mask_path", number, False),
                _path(text["red_image_path"], path.parent, "red_image_path", number, True),
                _path(text["green_image_path"], path.parent, "green_image_path", number, True),
                strict_bool(text["required"], number),
            ))
    sessions.sort(key=lambda s: s.session_index)
    check_sessions(sessions)
    return sessions


def check_sessions(sessions: list[Session], intensity: bool = False) -> None:
    """What matching needs of a manifest, and with ``intensity`` what the extraction needs as well."""
    if len(sessions) < 2:
        raise ValueError("matching needs at least two sessions")
    if [s.session_index for s in sessions] != list(range(len(sessions))):
        raise ValueError("session_index must run from 0 without gaps")
    if len({s.session_id for s in sessions}) != len(sessions):
        raise ValueError("session_id must be unique")
    days = [s.acquisition_date for s in sessions]
    if days != sorted(days):
        raise ValueError("acquisition_date must not decrease")
    for s in sessions:
        wanted = [s.mask_path]
        if intensity:
            if s.red_image_path is None or s.green_image_path is None:
                raise ValueError(f"session {s.session_id}: both image paths are needed")
            if s.red_image_path == s.green_image_path:
                raise ValueError(f"session {s.session_id}: the image paths must differ")
            wanted += [s.red_image_path, s.green_image_path]
        for path in wanted:
            if not path.is_file():
                raise FileNotFoundError(f"session {s.session_id}: no such file: {path}")


def elapsed_days(sessions: list[Session]) -> dict[str, int]:
    """Days since the first required session; sessions before it count negative."""
    start = next(s.acquisition_date for s in sessions if s.required)
    return {s.session_id: (s.acquisition_date - start).days for s in sessions}


def manifest_frame(spark: SparkSession, sessions: list[Session]) -> DataFrame:
    elapsed = elapsed_days(sessions)
    rows = [
        (s.session_index, s.session_id, s.acquisition_date, elapsed[s.session_id], s.required, str(s.mask_path),
         None if s.red_image_path is None else str(s.red_image_path),
         None if s.green_image_path is None else str(s.green_image_path))
        for s in sessions
    ]
    return spark.createDataFrame(
        rows,
        "session_index int, session_id string, acquisition_date date, elapsed_days int, required boolean, "
        "mask_path string, red_image_path string, green_image_path string",
    )


def volume_specs(sessions: list[Session]) -> list[dict]:
    """Reader input for :func:`longitrack.sources.tiff.read_voxels`."""
    return [
        {"session_id": s.session_id, "mask": str(s.mask_path),
         "red": None if s.red_image_path is None else str(s.red_image_path),
         "green": None if s.green_image_path is None else str(s.green_image_path)}
        for s in sessions
    ]


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Multiset equality of two tables."""
    return left.columns == right.columns and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def elapsed_since_first(df: DataFrame, date_column: str, out: str = "elapsed_days") -> DataFrame:
    """Distributed twin of :func:`elapsed_days` for a large table of dated rows with ``required``."""
    start = df.agg(F.min(F.when(F.col("required"), F.to_date(date_column))).alias("d"))
    return df.withColumn(out, F.datediff(F.to_date(date_column), start.select("d").scalar()))


def ordering_violations(df: DataFrame, index: str, date_column: str, by: list[str]) -> DataFrame:
    """Rows whose index does not follow the previous one by one, or whose date goes back."""
    order = W.partitionBy(*by).orderBy(index)
    return df.withColumn("_i", F.lag(index).over(order)).withColumn("_d", F.lag(date_column).over(order)).where(
        (F.col(index) - F.coalesce("_i", F.lit(-1)) != 1) | (F.col("_d") > F.col(date_column))
    ).drop("_i", "_d")
