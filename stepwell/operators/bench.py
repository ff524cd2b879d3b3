"""The synthetic five-stage pipeline: emit, fan out, route, pass on, collect the contiguous prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def emit(spark: SparkSession, coarse: int, queues: int = 2) -> DataFrame:
    """Values 0 to coarse - 1, dealt to queues in turn."""
    return spark.range(coarse).select(F.col("id").alias("value"), F.pmod("id", F.lit(queues)).cast("int").alias("queue"))


def fan_out(values: DataFrame, fine: int) -> DataFrame:
    """Each value v gives v * fine + j for j below fine."""
    return values.select(F.explode(F.sequence(F.col("value") * fine, F.col("value") * fine + fine - 1)).alias("value"))


def route(values: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """`percent` of the values take the first way, by their number."""
    first = F.pmod(F.col("value") * 37, F.lit(100)) < percent
    return values.filter(first), values.filter(~first)


def prefix(values: DataFrame, group: str) -> DataFrame:
    """Of each group the values that have all lower ones from 0 on, as a count, and the number held back."""
    r = values.distinct().withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy("value")) - 1)
    return r.groupBy(group).agg(F.sum((F.col("value") == F.col("rn")).cast("long")).alias("frontier"), F.sum((F.col("value") != F.col("rn")).cast("long")).alias("held"))
