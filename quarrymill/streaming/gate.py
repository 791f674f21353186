"""A streaming quality gate: rows that arrive are checked, counted in windows and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(stream: DataFrame, required: list[str]) -> DataFrame:
    """stream with the array of fields that are null or blank, and whether the row passes."""
    absent = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return stream.withColumn("absent", absent).withColumn("passes", F.size("absent") == 0)


def counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and failures of each window and group; state older than the watermark goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("passes")).alias("failed"))
