"""Relations between sessions: similarity, the most typical session, and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

from longitrack.operators.ratio import finite
from longitrack.session import materialise


def session_similarity(wide: DataFrame, value: str, key: str = "roi_id", session: str = "day") -> DataFrame:
    """Negative correlation of two sessions' values over the objects both have; lower is more alike.

    The self-join pairs the sessions of one object, whose number is bounded by the sessions.
    """
    a = wide.select(key, F.col(session).alias("session_a"), F.col(value).alias("_a"))
    b = wide.select(key, F.col(session).alias("session_b"), F.col(value).alias("_b"))
    return a.join(b, key).groupBy("session_a", "session_b").agg((-F.corr("_a", "_b")).alias("similarity"))


def medoid(similarity: DataFrame) -> DataFrame:
    """The session with the lowest summed similarity value; the first one of equals."""
    totals = similarity.groupBy("session_a").agg(F.sum("similarity").alias("total"))
    return totals.agg(
        F.min_by("session_a", F.struct("total", "session_a")).alias("medoid_session"), F.min("total").alias("total_similarity")
    )


def object_components(wide: DataFrame, value: str, days: Sequence[int], k: int = 2, key: str = "roi_id") -> tuple[DataFrame, list[float]]:
    """Principal components of the object by day matrix: scores per object, explained variance shares.

    The matrix has one column per session; its covariance is aggregated by Spark, not gathered. Objects with a
    missing or infinite value have no row in it. Fewer than two rows have no components: scores are null, shares empty.
    """
    columns = [F.first(F.when(F.col("day") == d, finite(value)), ignorenulls=True).alias(f"d{d}") for d in days]
    matrix = materialise(wide.groupBy(key).agg(*columns).na.drop())
    if matrix.limit(2).count() < 2:
        return matrix.select(key, F.lit(None).cast(VectorUDT()).alias("scores")), []
    vectors = VectorAssembler(inputCols=[f"d{d}" for d in days], outputCol="features").transform(matrix).select(key, "features")
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(vectors)
    return model.transform(vectors).select(key, "scores"), [float(v) for v in model.explainedVariance]
