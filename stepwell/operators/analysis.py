"""Run-time statistics: rows are (run, time) with any columns that name a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numerics(times: DataFrame, by: list[str], time: str = "time", digits: int = 6) -> DataFrame:
    """Mean, sample variance and deviation, and their ratio, of each run."""
    r = lambda c: F.round(c, digits)
    t = F.col(time)
    return times.groupBy(*by).agg(F.count(t).alias("n"), r(F.avg(t)).alias("avg"), r(F.var_samp(t)).alias("var"), r(F.stddev_samp(t)).alias("std"), r(F.stddev_samp(t) / F.avg(t)).alias("vc"))


def best(times: DataFrame, by: str, time: str = "time") -> DataFrame:
    """The run with the least mean; of equals the first by name."""
    means = times.groupBy(by).agg(F.avg(time).alias("m"))
    return means.agg(F.min(F.struct("m", by)).alias("b")).select(F.col(f"b.{by}").alias("best"), F.round("b.m", 6).alias("avg"))


def ratios(times: DataFrame, by: str, time: str = "time") -> DataFrame:
    """Mean over mean of all pairs of different runs; there are as many rows as pairs of names, not of times."""
    m = times.groupBy(by).agg(F.avg(time).alias("m"))
    a, b = m.select(F.col(by).alias("run"), F.col("m").alias("x")), m.select(F.col(by).alias("other"), F.col("m").alias("y"))
    return a.join(b, F.col("run") != F.col("other")).select("run", "other", F.round(F.col("x") / F.col("y"), 6).alias("ratio"))


def violin(times: DataFrame, by: str, time: str = "time") -> DataFrame:
    """What a violin plot needs: count, extremes and quartiles."""
    q = lambda p: F.round(F.percentile(time, F.lit(p)), 6)
    return times.groupBy(by).agg(F.count(time).alias("n"), F.min(time).alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(time).alias("high"))


def label(function: Column, step: Column) -> Column:
    return F.when(step.isNull(), function).otherwise(F.concat_ws(".", function, step))


def _ranked(values: DataFrame, by: str, value: str) -> DataFrame:
    w = W.partitionBy(by)
    return values.select(by, F.col(value).alias("v")).withColumn("rn", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(w))


def trimmed_mean(values: DataFrame, by: str, value: str, ignore: float) -> DataFrame:
    """Integer mean without the given share at either end."""
    r = _ranked(values, by, value)
    kept = r.filter((F.col("rn") > F.floor(F.col("n") * ignore)) & (F.col("rn") <= F.floor(F.col("n") * (1 - ignore))))
    return kept.groupBy(by).agg(F.expr(f"cast(sum(v) div cast(floor(max(n) * {1 - 2 * ignore}) as bigint) as bigint)").alias("mean"))


def lower_half_median(values: DataFrame, by: str, value: str) -> DataFrame:
    """Integer median of the lower half: sorted, the first n div 2."""
    half = _ranked(values, by, value).withColumn("h", F.expr("n div 2")).filter("rn <= h")
    middle = half.filter((F.col("rn") == F.expr("h div 2 + 1")) | ((F.col("h") % 2 == 0) & (F.col("rn") == F.expr("h div 2"))))
    return middle.groupBy(by).agg(F.expr("cast(sum(v) div count(v) as bigint)").alias("quart"))


def median(values: DataFrame, by: str, value: str) -> DataFrame:
    """Integer median: of an even number the mean of the two in the middle, truncated."""
    r = _ranked(values, by, value)
    middle = r.filter((F.col("rn") == F.expr("n div 2 + 1")) | ((F.col("n") % 2 == 0) & (F.col("rn") == F.expr("n div 2"))))
    return middle.groupBy(by).agg(F.expr("cast(sum(v) div count(v) as bigint)").alias("median"))


def least_average(values: DataFrame, producer: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The least of the producers' integer means; a producer whose mean is 0 has not measured anything."""
    means = values.groupBy(*(by or []), producer).agg(F.expr(f"cast(sum({value}) div count({value}) as bigint)").alias("m")).filter("m != 0")
    return means.groupBy(*(by or [])).agg(F.min("m").alias("cost"))


def timer_pairs(times: DataFrame, begin: str, end: str, by: list[str]) -> DataFrame:
    """Total and mean nanoseconds between two timers, and how often both were read."""
    d = F.col(end) - F.col(begin)
    return times.groupBy(*by).agg(F.count(d).alias("n"), F.sum(d).cast("long").alias("total"), F.round(F.avg(d), 6).alias("avg"))


def best_synchronizer(times: DataFrame, by: str, step: str, static: str, time: str = "time") -> DataFrame:
    """The synchronizer with the least mean, the static one standing with its best step: (best, step, avg).

    Of equal means the first by name, then by step, is taken.
    """
    means = times.groupBy(by, F.when(F.col(by) == static, F.col(step)).alias("step")).agg(F.avg(time).alias("m"))
    return means.agg(F.min(F.struct("m", by, "step")).alias("b")).select(F.col(f"b.{by}").alias("best"), "b.step", F.round("b.m", 6).alias("avg"))


def ratio_lines(times: DataFrame, by: str, step: str, naive: str, static: str, time: str = "time") -> DataFrame:
    """(n, line): the naive way against the static one with step 1 and with its best step, both ways; none where one is missing."""
    means = times.filter(F.col(by).isin(naive, static)).groupBy(by, F.when(F.col(by) == static, F.col(step)).alias("step")).agg(F.avg(time).alias("m"))
    one = means.agg(
        F.max(F.when(F.col(by) == naive, F.col("m"))).alias("naive"), F.max(F.when((F.col(by) == static) & (F.col("step") == 1), F.col("m"))).alias("first"),
        F.min(F.when(F.col(by) == static, F.struct("m", "step"))).alias("best"),
    )
    name = F.concat(F.lit("Promise+"), F.col("best.step").cast("string"), F.lit(" (best)"))
    pairs = [(F.lit("Naive"), F.col("naive"), F.lit("Promise+1"), F.col("first")), (F.lit("Promise+1"), F.col("first"), F.lit("Naive"), F.col("naive")), (F.lit("Naive"), F.col("naive"), name, F.col("best.m")), (name, F.col("best.m"), F.lit("Naive"), F.col("naive"))]
    lines = F.array(*[F.struct(F.lit(i).alias("n"), F.concat(a, F.lit(" / "), c, F.lit(": "), F.round(x / y, 6).cast("string")).alias("line")) for i, (a, x, c, y) in enumerate(pairs)])
    return one.select(F.explode(lines).alias("l")).select("l.n", "l.line").filter("line is not null")


def summary_lines(times: DataFrame, by: str, step: str, static: str, dims: dict, time: str = "time") -> DataFrame:
    """(n, line): the run's sizes, the mean of each synchronizer and step, and the best."""
    label_ = label(F.col(by), F.when(F.col(by) == static, F.col(step)).cast("string"))
    head = "{w} * {x} * {y} * {z} with {threads} threads (using active wait: {active}) and {iterations} iterations".format(**dims)
    spark = times.sparkSession
    means = times.groupBy(label_.alias("run")).agg(F.avg(time).alias("m")).select(F.lit(2).alias("n"), F.format_string("\t%s: %.6f", "run", "m").alias("line"))
    found = best_synchronizer(times, by, step, static, time)
    best_ = found.select(F.lit(3).alias("n"), F.format_string("Best synchronization: %s, with average time: %.6f", label(F.col("best"), F.col("step").cast("string")), "avg").alias("line"))
    return spark.createDataFrame([(0, head), (1, "Running with the following synchronization patterns: ")], "n int, line string").union(means).union(best_)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in the order of `n`, then their text, as one small text file: there are as many as runs have names."""
    lines.orderBy("n", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_numerics(times: DataFrame, by: list[str], path: str, time: str = "time") -> None:
    """Mean, variance, deviation and their ratio of each run as CSV with a header."""
    numerics(times, by, time).drop("n").orderBy(*by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def first_samples(values: DataFrame, by: str, order: list[str], value: str, quota: int) -> DataFrame:
    """Mean of the first `quota` samples of each: what an observer collects before it decides."""
    r = values.withColumn("rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= quota)
    return r.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("avg"))


def summary(times: DataFrame, by: str, time: str = "time") -> DataFrame:
    """One line a run, the winner marked."""
    w = best(times, by, time).select("best")
    return times.groupBy(by).agg(F.avg(time).alias("m")).join(F.broadcast(w), F.lit(True), "left").select(F.format_string("%s: %.3f%s", F.col(by), F.col("m"), F.when(F.col(by) == F.col("best"), " *").otherwise("")).alias("line"))
