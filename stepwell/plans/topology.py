"""Pipeline topology and job configuration, checked when built."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.operators import dedup


class Layer(StrEnum):
    FRAGMENT = "fragment"
    REFINE = "refine"
    DEDUPLICATE = "deduplicate"
    COMPRESS = "compress"
    REORDER = "reorder"


class Mode(StrEnum):
    ORIG = "orig"
    AUTO = "auto"
    NUMBERS = "numbers"


@dataclass
class Fifo:
    """A queue between threads."""

    n: int = 1
    min: int = 1
    max: int = 1 << 20
    with_work_threshold: int = 1
    no_work_threshold: int = 1
    critical_threshold: int = 1
    increase_mult: float = 2.0
    decrease_mult: float = 0.5
    history_size: int = 10
    reconfigure: bool = False
    change_step_after: int = 0
    new_step: int = 0

    def __post_init__(self):
        if self.min < 1:
            warnings.warn("min is raised to 1", stacklevel=2)
            self.min = 1
        if not self.min <= self.n <= self.max:
            raise ValueError(f"n is {self.n}, outside {self.min} to {self.max}")
        if self.increase_mult < 1:
            warnings.warn("increase_mult below 1 shrinks", stacklevel=2)
        if self.decrease_mult > 1:
            warnings.warn("decrease_mult above 1 grows", stacklevel=2)


@dataclass
class Thread:
    inputs: dict[int, Fifo] = field(default_factory=dict)
    outputs: dict[int, Fifo] = field(default_factory=dict)
    extras: dict[int, Fifo] = field(default_factory=dict)


@dataclass
class Job:
    """A deduplication job: streams, codec, layers of threads."""

    codec: str = "none"
    jump: int = dedup.JUMP
    winlen: int = 0
    layers: dict[Layer, list[Thread]] = field(default_factory=dict)
    fifos: int = 0

    def __post_init__(self):
        if self.codec not in dedup.CODECS:
            raise ValueError(f"codec is one of {sorted(dedup.CODECS)}")

    def new_fifo(self) -> int:
        self.fifos += 1
        return self.fifos - 1

    def push_layer(self, layer: Layer | str, threads: list[Thread]) -> Job:
        self.layers[Layer(layer)] = threads
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a use of a queue: layer, thread, role, fifo_id."""
        rows = [(layer.value, i, role, f) for layer, threads in self.layers.items() for i, t in enumerate(threads) for role, fifos in (("input", t.inputs), ("output", t.outputs), ("extra", t.extras)) for f in fifos]
        return spark.createDataFrame(rows, "layer string, thread int, role string, fifo_id int")

    def run(self, df: DataFrame, mode: Mode | str = Mode.ORIG, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
        """Archive rows, or with mode numbers the counts; orig and auto differ in scheduling only, so they give the same rows."""
        mode = Mode(mode)
        found = dedup.chunks(df, id_col, data_col, self.jump, winlen=self.winlen, with_data=mode != Mode.NUMBERS)
        return dedup.numbers(found) if mode == Mode.NUMBERS else dedup.archive(found, self.codec)


def fifo_counts(uses: DataFrame) -> DataFrame:
    """Of each queue its producing threads (outputs and extras) and its uses by threads of any role."""
    return uses.groupBy("fifo_id").agg(F.sum(F.col("role").isin("output", "extra").cast("long")).alias("producers"), F.count(F.lit(1)).alias("interacting"))


def reorder_fifos(uses: DataFrame) -> DataFrame:
    """Queues into the last layer: extras of deduplicate and outputs of compress."""
    a = uses.filter("layer = 'deduplicate' AND role = 'extra'").select("fifo_id")
    return a.union(uses.filter("layer = 'compress' AND role = 'output'").select("fifo_id")).distinct()


#: Synchronizers that each kernel takes.
_BOTH = ("sequential", "alt_bit", "counter", "promise_plus", "array_of_promises", "promise_of_array", "static_step_plus", "naive", "smart")
_DSP = ("dsp_never", "dsp_producer", "dsp_producer_timer", "dsp_producer_unblock", "dsp_consumer", "dsp_consumer_unblock", "dsp_both", "dsp_both_unblock")
SYNCHRONIZERS = {"heat_cpu": _BOTH, "lu": ("sequential", *_DSP)}


def check_runs(runs: DataFrame, kernel: str) -> DataFrame:
    """Runs whose synchronizer the kernel knows; another is an error when the rows are read."""
    known = F.col("synchronizer").isin(*SYNCHRONIZERS[kernel])
    checked = F.when(known, F.col("synchronizer")).otherwise(F.raise_error(F.concat(F.lit("unknown synchronizer "), F.coalesce("synchronizer", F.lit("null")))))
    return runs.withColumn("synchronizer", checked)


def strategy(synchronizer: Column, step: Column) -> Column:
    """What a run is called: the synchronizer, and its step where it has one."""
    return F.when(step.isNull(), synchronizer).otherwise(F.concat_ws(".", synchronizer, step.cast("string")))


class Callbacks:
    """Called for each micro-batch of a stream with its rows: `push` before they are handled, `pop` after."""

    def __init__(self):
        self.push, self.pop = [], []

    def around(self, handle):
        """A function for `foreachBatch`."""

        def batch(df: DataFrame, number: int) -> None:
            for f in self.push:
                f(df, number)
            handle(df, number)
            for f in self.pop:
                f(df, number)

        return batch


def functions(path: str, *names: str) -> tuple:
    """Python callables by name from a module's file: a user's own producer and consumer."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("stepwell_user", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    missing = [n for n in names if not callable(getattr(module, n, None))]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return tuple(getattr(module, n) for n in names)
