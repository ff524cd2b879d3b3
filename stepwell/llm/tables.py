"""Tables in the cluster's shared folder, and packed blocks of documents.

Operators that need more than one pass cut lineage by writing what a pass found as a
Parquet table under ``spark.checkpoint.dir``: a lost executor costs its own tasks only,
and row numbers given in one pass hold in the next.  A cluster without that setting is an
error: nothing is written to a machine's own folders there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import kernels as K

#: Bounds of an Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where none is set one is made, but on one machine only, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            where = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stepwell-"))
            where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return where.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, by rows and by bytes, so that long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Table:
    """A DataFrame written once to the shared folder; gone when the session ends, or earlier by drop()."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/stepwell/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self._files()[0].deleteOnExit(self._files()[1])

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self) -> None:
        """Only for tables that no later plan reads."""
        files, path = self._files()
        files.delete(path, True)


def save(df: DataFrame, label: str) -> DataFrame:
    return Table(df, label).df


def partitions(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """Tasks for `size` bytes: as many as the session's shuffles have, or more so that none exceeds `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each), 1)


def squeeze(data: bytes | np.ndarray, level: int = 1) -> bytes:
    data = data.tobytes() if isinstance(data, np.ndarray) else bytes(data)
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def numbers(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(expand(data), kind)


def serial() -> Iterator[int]:
    """Numbers that no other task of the stage gives: for rows that are written before they are read again."""
    n = TaskContext.get().partitionId() << 36
    while True:
        yield n
        n += 1


BLOCK = "block long, n int, ids binary, lens binary, text binary"


def block_rows(block: int, ids: np.ndarray, empty: np.ndarray, lens: np.ndarray, body: bytes | np.ndarray) -> dict:
    """One packed block; ids keep their nulls as a second row of flags."""
    packed = np.concatenate([ids.astype(np.int64), empty.astype(np.int64)])
    return {"block": block, "n": len(ids), "ids": squeeze(packed), "lens": squeeze(lens.astype(np.int64)), "text": squeeze(body)}


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, null flags, text bytes and offsets of a packed block."""
    both = numbers(row["ids"], np.int64)
    lens = numbers(row["lens"], np.int64)
    offsets = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    return both[: len(lens)], both[len(lens) :].astype(bool), np.frombuffer(expand(row["text"]), np.uint8), offsets


def gathered(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a task as blocks of about `target` bytes: ids, null flags, lengths, bytes."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        ids, empty = K.ids_of(batch.column(0))
        body, offsets = K.column(batch.column(1))
        for a, b in K.pieces(offsets, target):
            held.append((ids[a:b], empty[a:b], np.diff(offsets[a : b + 1]), body[offsets[a] : offsets[b]].copy()))
            size += int(offsets[b] - offsets[a]) + 64 * (b - a)
            if size >= target // 2:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: packed rows are large, and a batch holds few of them."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {k: batch.column(j)[i].as_py() for j, k in enumerate(names)}


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a partition sorted by its first column: each value with its rows."""
    key, held = None, []
    for batch in batches:
        first = batch.schema.names[0]
        for row in rows(batch):
            if held and row[first] != key:
                yield key, held
                held = []
            key = row[first]
            held.append(row)
    if held:
        yield key, held


def record(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [r.get(k) for r in found] for k in schema.names}, schema=schema)


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own: others may be called anything."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def block_table(df: DataFrame, id_col: str, text_col: str, target: int = 2 << 20) -> Table:
    """Documents packed into compressed blocks and written: one pass, no shuffle."""
    tune(df.sparkSession)
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("lens", pa.binary()), ("text", pa.binary())])

    def pack(batches):
        numbering = serial()
        for ids, empty, lens, body in gathered(batches, target):
            yield record([block_rows(next(numbering), ids, empty, lens, body)], schema)

    return Table(two(df, id_col, text_col).mapInArrow(pack, BLOCK), "blocks")
