"""Domain relations derived from the given tables, for the query catalogue.

No labelled volumes are among the tables, so every relation here is built from them by joins and
grouping and grows with them. The constants below fix the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the mapping, shared with the SQL text.
FIRST_YEAR = 1995
DARK = {"red": 5.0, "green": 10.0}
EPSILON = 1.0
LABELS = 25
PRICE_PER_COUNT = 777.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def roi_channel_means(spark: SparkSession, sf: str) -> DataFrame:
    """Wide means: object = part, session = ship year, red = mean quantity, green = mean price / 777."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("roi_id"), (F.year("l_shipdate") - FIRST_YEAR).alias("day"))
        .agg(F.avg("l_quantity").alias("red"), (F.avg("l_extendedprice") / PRICE_PER_COUNT).alias("green"))
    )


def roi_long(spark: SparkSession, sf: str) -> DataFrame:
    """Long intensity table, one row per object, day and channel."""
    return roi_channel_means(spark, sf).unpivot(["roi_id", "day"], ["red", "green"], "channel", "mean_intensity")


def roi_day(spark: SparkSession, sf: str) -> DataFrame:
    """Dark-corrected wide table."""
    from longitrack.operators.ratio import dark_correct, pivot_channels

    return pivot_channels(dark_correct(roi_long(spark, sf), DARK))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Log-ratio metrics of the complete objects."""
    from longitrack.operators.ratio import complete_rois, log_ratio_metrics

    return log_ratio_metrics(complete_rois(roi_day(spark, sf)), EPSILON)


# --- point sets for matching --------------------------------------------------------------------

# Fixed values of the mapping, shared with the SQL text.
FIELD_SIZE = 1000
SESSIONS = 4
UM_PER_UNIT = 100.0
AXIS_SPREAD = 4.6
OVERLAP_REACH_UM = 8.0
PAIR = ["field_id", "index_a", "index_b"]


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Object centroids: vector as object, position from all its components.

    Each axis sums every third component from its own on (the last one is left to the first axis), divided so
    that the spread stays that of a single component. A field of view holds a thousand consecutive vectors spread over four sessions, so the number of
    fields grows with the table while a field keeps its size.
    """

    def axis(first: int) -> Column:
        own = F.filter("embedding", lambda _, i: i % 3 == first)
        return F.aggregate(own, F.lit(0.0), lambda total, e: total + e.cast("double")) * UM_PER_UNIT / AXIS_SPREAD

    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / FIELD_SIZE).alias("field_id"),
        (F.col("vec_id") % SESSIONS).cast("int").alias("session_index"),
        F.col("vec_id").alias("label"),
        axis(0).alias("z_um"),
        axis(1).alias("y_um"),
        axis(2).alias("x_um"),
        (F.col("label") + 1).cast("double").alias("area_voxels"),
    )


def sides(pts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every point once per session pair it belongs to, as first and as second session; gaps up to two."""
    step = F.explode(F.array(F.lit(1), F.lit(2))).alias("_gap")
    a = pts.select("*", step).withColumn("index_a", F.col("session_index")).withColumn(
        "index_b", F.col("session_index") + F.col("_gap")
    )
    b = pts.select("*", step).withColumn("index_b", F.col("session_index")).withColumn(
        "index_a", F.col("session_index") - F.col("_gap")
    )
    return (
        a.where(F.col("index_b") < SESSIONS).drop("_gap", "session_index"),
        b.where(F.col("index_a") >= 0).drop("_gap", "session_index"),
    )


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap evidence: dice falls linearly to zero at the reach."""
    from longitrack.operators.spatial import radius_join

    near = radius_join(a, b, OVERLAP_REACH_UM, OVERLAP_REACH_UM, PAIR)
    dice = 1.0 - F.col("distance_um") / OVERLAP_REACH_UM
    return near.select(*PAIR, F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), dice.alias("dice")).withColumn(
        "iou", F.col("dice") / (2.0 - F.col("dice"))
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    from longitrack.operators.candidates import candidate_pairs

    a, b = sides(points(spark, sf))
    return candidate_pairs(a, b, overlaps(a, b), pair=PAIR)


# --- voxels -------------------------------------------------------------------------------------

def grid_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Two labelled sessions, one voxel per order; the label is the order's lowest supplier.

    In session ``b`` every fifth order belongs to the next supplier, which gives large and small overlaps.
    """
    k = F.col("l_orderkey")
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("s"),
        F.sum("l_tax").alias("tax"),
        F.sum("l_discount").alias("discount"),
    )
    session = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("session_id")
    moved = F.when((F.col("session_id") == "b") & (k % 5 == 0), F.col("s") + 1).otherwise(F.col("s"))
    return orders.select("*", session).select(
        "session_id", (k % 16).cast("int").alias("z"), (F.floor(k / 16) % 128).cast("int").alias("y"),
        F.floor(k / 2048).cast("int").alias("x"), moved.alias("label"), F.col("tax").alias("red"), F.col("discount").alias("green"),
    )


def status_code() -> Column:
    return F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)


def block_label(y: Column, x: Column, code: Column) -> Column:
    return 1 + F.floor(y / 8) + 8 * F.floor(x / 8) * 3 + 8 * code


def block_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Session ``f``: ragged regions, one per status of the orders in a block of 8 x 8 pixels."""
    k = F.col("o_orderkey")
    y, x = (F.floor(k / 4) % 64).cast("int"), F.floor(k / 256).cast("int")
    return table(spark, sf, "orders").select(
        F.lit("f").alias("session_id"), (k % 4).cast("int").alias("z"), y.alias("y"), x.alias("x"),
        block_label(y, x, status_code()).alias("label"), F.col("o_totalprice").alias("red"),
    )


def plane_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Two sessions whose planes are offset by three: one voxel per order, plane by customer."""
    session = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("session_id")
    z = F.when(F.col("session_id") == "a", F.col("o_custkey") % 16).otherwise((F.col("o_custkey") + 3) % 16)
    return table(spark, sf, "orders").select("*", session).select(
        "session_id", z.cast("int").alias("z"), F.lit(0).alias("y"), F.col("o_orderkey").alias("x"), F.lit(1).alias("label")
    )


def volume_sizes(voxels: DataFrame, nz: int, ny: int) -> DataFrame:
    return voxels.groupBy("session_id").agg((F.max("x") + 1).cast("int").alias("nx")).select(
        "session_id", F.lit(nz).alias("nz"), F.lit(ny).alias("ny"), "nx"
    )
