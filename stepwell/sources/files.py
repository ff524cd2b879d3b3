"""Readers and writers: byte streams, matrices as text, run logs, specifications, INI."""

from __future__ import annotations

import configparser
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from stepwell.session import files_of, write_bytes

RUNS = "runs array<struct<synchronizer:string,function:string,extras:map<string,string>,times:array<double>>>"
SPEC = "iterations int, description string, runs array<struct<synchronizer:string,extras:map<string,string>>>"
BENCH_SIDE = "array<struct<iterations:bigint,work:bigint,start:bigint,threshold:bigint,new:bigint>>"


def streams(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as (path, length, content)."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def existing(spark: SparkSession, path: str) -> DataFrame:
    """`streams` of one path that must be a regular file."""
    files, at = files_of(spark, path)
    if not files.exists(at):
        raise FileNotFoundError(f"no file {path}")
    if not files.getFileStatus(at).isFile():
        raise ValueError(f"{path} is not a regular file")
    return streams(spark, path)


def preloaded(spark: SparkSession, path: str) -> DataFrame:
    """`existing`, read once: further uses take the bytes from memory, or from disk where they do not fit."""
    out = existing(spark, path).persist(StorageLevel.MEMORY_AND_DISK_2)
    out.count()
    return out


def int_matrix(spark: SparkSession, path: str, dims: tuple[int, int, int, int]) -> DataFrame:
    """Whitespace-separated numbers in C order as (w, x, y, z, v)."""
    _, x, y, z = dims
    flat = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("id", "t"))
    return flat.selectExpr(f"cast(id div {x * y * z} as int) AS w", f"cast(id div {y * z} % {x} as int) AS x", f"cast(id div {z} % {y} as int) AS y", f"cast(id % {z} as int) AS z", "cast(t as int) AS v")


def write_int_matrix(cells: DataFrame, path: str) -> None:
    """One line a w plane, numbers in C order."""
    line = cells.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("x", "y", "z", "v"))).alias("c"))
    text = line.select("w", F.concat_ws(" ", F.transform("c", lambda c: c["v"].cast("string"))).alias("value"))
    text.repartitionByRange("w").sortWithinPartitions("w").select("value").write.text(path)


def float_bits(v: float) -> int:
    """A float32's bits as an unsigned number."""
    return int(np.float32(v).view(np.uint32))


def from_bits(bits: int) -> float:
    return float(np.uint32(bits).view(np.float32))


def bits_of(v: Column) -> Column:
    """A float column's bits as unsigned numbers, by its IEEE 754 parts; the other way round is `value_of`."""
    size, negative = F.abs(v.cast("double")), (v < 0) | (v.cast("string") == "-0.0")
    power = F.greatest(F.floor(F.log2(size)), F.lit(-126))
    power = F.when(size >= F.pow(F.lit(2.0), power + 1), power + 1).when((size < F.pow(F.lit(2.0), power)) & (power > -126), power - 1).otherwise(power)
    whole = F.round(size / F.pow(F.lit(2.0), power - 23)).cast("long")
    bits = F.when(size == 0, F.lit(0)).when(whole < 1 << 23, whole).otherwise((power + 126) * (1 << 23) + whole)
    bits = F.when(F.isnan(v), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).otherwise(bits)
    return (bits + F.when(negative, F.lit(1 << 31)).otherwise(0)).cast("long")


def value_of(bits: Column) -> Column:
    """The float of unsigned bits."""
    sign, power, rest = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0), F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    small = rest * F.lit(2.0**-149)
    normal = (rest + (1 << 23)) * F.pow(F.lit(2.0), power - 150)
    special = F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(power == 255, special).when(power == 0, small).otherwise(normal)).cast("float")


def write_float_matrix(a: DataFrame, b: DataFrame, path: str) -> None:
    """What `float_matrix` reads, as one text file: the matrix's bits on a line, the number of vectors, a line each."""
    line = lambda df, order: df.agg(F.array_sort(F.collect_list(F.struct(*order, bits_of(F.col("v")).alias("bits")))).alias("c"))  # noqa: E731  the format has a matrix on one line
    text = lambda df: df.select(F.concat_ws(" ", F.transform("c", lambda c: c["bits"].cast("string"))).alias("value"))
    whole = text(line(a, ["i", "j"])).select(F.lit(0).cast("long").alias("n"), "value")
    count = b.agg(F.countDistinct("rhs").cast("string").alias("value")).select(F.lit(1).cast("long").alias("n"), "value")
    vectors = b.groupBy("rhs").agg(F.array_sort(F.collect_list(F.struct("i", bits_of(F.col("v")).alias("bits")))).alias("c"))
    rows = vectors.select((F.col("rhs") + 2).alias("n"), F.concat_ws(" ", F.transform("c", lambda c: c["bits"].cast("string"))).alias("value"))
    whole.union(count).union(rows).orderBy("n").select("value").coalesce(1).write.text(path)


def float_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """First line the matrix as float32 bits, second the number of vectors, then one vector a line: (i, j, v) and (rhs, i, v)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    numbered = lines.select((F.row_number().over(W.orderBy("line")) - 1).alias("line"), "value").cache()  # a few lines

    def spread(batches):
        for b in batches:
            for line, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.array(value.split(), np.uint32).view(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), line), pa.int64()), pa.array(np.arange(len(v)), pa.int64()), pa.array(v, pa.float32())], names=["line", "at", "v"])

    cells = numbered.filter("line != 1").select(F.col("line").cast("long"), "value").mapInArrow(spread, "line long, at long, v float")
    n = F.lit(int(numbered.filter("line = 0").select(F.sqrt(F.size(F.split(F.trim("value"), r"\s+")))).first()[0]))
    matrix = cells.filter("line = 0").select(F.expr("at").alias("at"), "v").select(F.floor(F.col("at") / n).alias("i"), (F.col("at") % n).alias("j"), "v")
    return matrix, cells.filter("line > 1").select((F.col("line") - 2).alias("rhs"), F.col("at").alias("i"), "v")


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs as (synchronizer, function, extras, time)."""
    logs = spark.read.schema(RUNS).option("multiLine", True).json(path)
    return logs.select(F.explode("runs").alias("r")).select("r.synchronizer", "r.function", "r.extras", F.explode("r.times").alias("time"))


def specification(spark: SparkSession, path: str) -> DataFrame:
    """Simulation runs (iterations, description, synchronizer, step); missing keys are errors when the rows are read."""
    s = spark.read.schema(SPEC).option("multiLine", True).json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"no {c} in the specification"))).otherwise(F.col(c))
    s = s.select(need("iterations").alias("iterations"), "description", F.explode(need("runs")).alias("r"))
    name = F.when(F.col("r.synchronizer").isNull(), F.raise_error(F.lit("no synchronizer in a run"))).otherwise(F.col("r.synchronizer"))
    return s.select("iterations", "description", name.alias("synchronizer"), F.col("r.extras")["step"].cast("int").alias("step"))


def bench_specification(spark: SparkSession, path: str) -> DataFrame:
    s = spark.read.schema(f"producers {BENCH_SIDE}, consumers {BENCH_SIDE}, samples int").option("multiLine", True).json(path)
    side = lambda c: s.select(F.lit(c).alias("side"), F.posexplode(c).alias("thread", "r")).select("side", "thread", "r.*")
    return side("producers").union(side("consumers"))


def write_runs(runs: DataFrame, path: str) -> None:
    """Rows (synchronizer, function, extras, time) as one log object."""
    grouped = runs.groupBy("synchronizer", "function", F.to_json("extras").alias("e")).agg(F.collect_list("time").alias("times"), F.first("extras").alias("extras"))
    one = grouped.agg(F.collect_list(F.struct("synchronizer", "function", "extras", "times")).alias("runs"))
    one.write.json(path)


def ini(spark: SparkSession, text: str) -> DataFrame:
    """Sections and values as (name, value), names lower-cased with their section before them."""
    parser = configparser.ConfigParser(interpolation=None, delimiters=("=", ":"), comment_prefixes=(";", "#"), inline_comment_prefixes=(";",), strict=False)
    parser.read_string(text)
    rows = [(f"{s}.{k}".lower(), v) for s in parser.sections() for k, v in parser.items(s)]
    return spark.createDataFrame(rows, "name string, value string")


META = "w int, x int, y int, z int, iterations int, active string, threads int"


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A simulation's `data.json` as one row with its path; a missing key is an error when the row is read."""
    found = spark.read.schema(META).option("multiLine", True).json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"no {c} in the metadata"))).otherwise(F.col(c)).alias(c)
    return found.select(F.input_file_name().alias("path"), *[need(c) for c in ("w", "x", "y", "z", "iterations", "active", "threads")])


def write_parameters(spark: SparkSession, parameters: dict, path: str) -> None:
    """A run's sizes, iterations, threads and description as one JSON file."""
    write_bytes(spark, path, [json.dumps(parameters, indent=4).encode()])


def write_iterations(times: DataFrame, path: str) -> None:
    """Rows (synchronizer, function, iteration, local, thread, time) as nested JSON: a line a run of
    ``{synchronizer, function, iterations: [{local_iterations: [{threads: [time]}]}]}``, in order."""
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda c: c[value])
    run = ["synchronizer", "function"]
    threads = times.groupBy(*run, "iteration", "local").agg(F.struct(ordered("thread", "time").alias("threads")).alias("t"))
    local = threads.groupBy(*run, "iteration").agg(F.struct(ordered("local", "t").alias("local_iterations")).alias("l"))
    local.groupBy(*run).agg(ordered("iteration", "l").alias("iterations")).write.json(path)


def write_dump(spark: SparkSession, dump: dict, path: str) -> None:
    """An observer's state as JSON, in any store."""
    write_bytes(spark, path, [json.dumps(dump, sort_keys=True).encode()])
