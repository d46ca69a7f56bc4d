"""Text labels of days, planes and ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_date(day: str | Column, start: str) -> Column:
    """Calendar date of a day offset from a start date given as YYYYMMDD."""
    return F.date_add(F.to_date(F.lit(start), "yyyyMMdd"), F.col(day) if isinstance(day, str) else day)


def day_label(day: str, start: str) -> Column:
    """``Day n`` with month and day of its date."""
    return F.concat(F.lit("Day "), F.col(day).cast("string"), F.lit(" "), F.date_format(day_date(day, start), "MM-dd"))


def plane_label(plane: str, center: str) -> Column:
    """Plane relative to the centre plane: ``z``, ``z+1``, ``z-1``."""
    offset = F.col(plane) - F.col(center)
    return F.when(offset == 0, "z").when(offset > 0, F.concat(F.lit("z+"), offset.cast("string"))).otherwise(
        F.concat(F.lit("z"), offset.cast("string"))
    )


def flag_text(flags: dict[str, Column], empty: str = "none") -> Column:
    """Names of the flags that hold, joined by commas."""
    text = F.concat_ws(", ", *[F.when(c, F.lit(name)) for name, c in flags.items()])
    return F.when(text == "", empty).otherwise(text)
