"""Ray streams: residual energy per leaf added up batch by batch. All sums are associative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scores
from ..operators.lookup import KEY
from ..operators.rays import predictions


def start(rays: DataFrame, facts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's energy and exposure per leaf to its own folder, so a batch run again replaces itself."""
    def add(batch: DataFrame, number: int) -> None:
        paths = scores.per_path(predictions(batch, facts).withColumn("weight", F.lit(1.0)))
        scores.residual_scores(facts, paths).drop("score").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rays.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def totals(spark, folder: str) -> DataFrame:
    """Energy, exposure and score per leaf over all batches so far."""
    sums = spark.read.parquet(folder).groupBy(*KEY).agg(F.sum("energy").alias("energy"), F.sum("exposure").alias("exposure"))
    return sums.withColumn("score", F.when(F.col("exposure") > 0, F.col("energy") / F.greatest("exposure", F.lit(1e-8))).otherwise(0.0))
