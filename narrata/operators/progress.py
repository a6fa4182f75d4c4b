"""Status logs: progress that may not fall, changes of state, sessions of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regressions(log: DataFrame) -> DataFrame:
    """Per analysis: reports, reports below the one before, and the highest value."""
    order = Window.partitionBy("analysis_id").orderBy("ts", "event_id")
    marked = log.withColumn("falls", F.col("value") < F.lag("value").over(order))
    return marked.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("reports"), F.count_if(F.coalesce("falls", F.lit(False))).alias("regressions"), F.max("value").alias("highest")
    )


def changes(log: DataFrame) -> DataFrame:
    """Reports whose stage differs from the one before: what a display that shows changes only would print."""
    order = Window.partitionBy("analysis_id").orderBy("ts", "event_id")
    before = F.lag("stage").over(order)
    return log.withColumn("before", before).where(~F.col("stage").eqNullSafe(F.col("before"))).select("analysis_id", "event_id", "stage")


def latest(log: DataFrame) -> DataFrame:
    """The last report of each analysis: of equal times the greatest event."""
    last = F.max_by(F.struct("event_id", "stage", "value"), F.struct("ts", "event_id"))
    return log.groupBy("analysis_id").agg(last.alias("x")).select("analysis_id", "x.event_id", "x.stage", "x.value")
