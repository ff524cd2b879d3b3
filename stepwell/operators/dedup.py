"""Chunk, fingerprint, deduplicate, compress, archive, decode.

A chunk is (src, l1, l2, offset, size, is_last, sha1); the original of a digest is its
least (src, l1, l2).  Payloads stay out of shuffles: digests and keys are aggregated, and
bytes are cut, compressed and joined only where they are needed.  Arrow batches are cut where
they lie and go back in pieces, so a worker holds what Spark sends it at once and little more.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.functions import rabin
from stepwell.functions.columns import slot, slot_middle
from stepwell.session import write_bytes

JUMP = 2 << 20
#: Rows and bytes after which a batch goes back to Spark.
ROWS, BYTES = 4096, 4 << 20
#: The archive's magic number, codec numbers and record types.
MAGIC, CODECS, FINGERPRINT, PAYLOAD = 123456, {"gzip": 0, "bzip2": 1, "none": 2}, 0, 1
_LONG, _BYTES = pa.int64(), pa.binary()
_CHUNK = "src long, l1 long, l2 long, offset long, size long, is_last boolean, sha1 string"


def _bytes_of(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    data = F.col(data_col)
    if df.schema[data_col].dataType.simpleString() == "string":
        data = F.encode(data, "UTF-8")
    return df.select(F.col(id_col).cast("long").alias("src"), F.coalesce(data, F.lit(b"")).alias("data"))


def _inside(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, not copied, and where each value begins and the last one ends."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = values.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_binary(values.type) else np.int32)
    return np.frombuffer(data or b"", np.uint8), at[values.offset : values.offset + len(values) + 1].astype(np.int64)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; what counts of a row are its bytes, if it has any."""
    wide = [i for i, k in enumerate(kinds) if k == _BYTES]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(row[i] or b"") for i in wide)
        if len(held) >= ROWS or size >= BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _coarse(body: np.ndarray, at: np.ndarray, jump: int, mask: int, winlen: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Coarse chunks of a column's values: (value, l1, offset, size)."""
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        found = rabin.coarse_ends(body[a:b].tobytes(), jump, mask, winlen) if b - a > jump else [b - a] * (b > a)
        for l1, (x, y) in enumerate(zip([0, *found], found, strict=False)):
            yield k, l1, x, y - x


def chunks(df: DataFrame, id_col: str = "doc_id", data_col: str = "text", jump: int = JUMP, mask: int = rabin.MASK, winlen: int = 0, with_data: bool = False) -> DataFrame:
    """Two-level chunks of each stream (text or binary): coarse by `jump`, refined inside; empty streams have none."""
    names, kinds = ["src", "l1", "l2", "offset", "size", "is_last", "sha1"], [*[_LONG] * 5, pa.bool_(), pa.string()]

    def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, (body, at) = batch.column(0).to_pylist(), _inside(batch.column(1))
        parts = np.array(list(_coarse(body, at, jump, mask, winlen)), np.int64).reshape(-1, 4)
        begin = at[parts[:, 0]] + parts[:, 2]
        for (k, l1, base, size), start, own in zip(parts.tolist(), begin.tolist(), rabin.ends_inside(body, begin, parts[:, 3], mask, winlen), strict=True):
            for l2, (a, b) in enumerate(zip([0, *own], own, strict=False)):
                part = body[start + a : start + b]
                yield (ids[k], l1, l2, base + a, b - a, b == size, hashlib.sha1(part).hexdigest(), *([part.tobytes()] * with_data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(cut(batch), names + ["data"] * with_data, kinds + [_BYTES] * with_data)

    return _bytes_of(df, id_col, data_col).mapInArrow(run, _CHUNK + ", data binary" * with_data)


def fragments(df: DataFrame, id_col: str = "doc_id", data_col: str = "text", jump: int = JUMP, mask: int = rabin.MASK) -> DataFrame:
    """Coarse chunks only: (src, l1, offset, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = ((ids[k], *rest) for k, *rest in _coarse(*_inside(batch.column(1)), jump, mask))
            yield from _batches(rows, ["src", "l1", "offset", "size"], [_LONG] * 4)

    return _bytes_of(df, id_col, data_col).mapInArrow(run, "src long, l1 long, offset long, size long")


def whole(df: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """Each stream as one chunk."""
    d = _bytes_of(df, id_col, data_col)
    zero = F.lit(0).cast("long")
    return d.select("src", zero.alias("l1"), zero.alias("l2"), zero.alias("offset"), F.octet_length("data").cast("long").alias("size"), F.lit(True).alias("is_last"), F.sha1("data").alias("sha1"))


def deduplicate(found: DataFrame) -> DataFrame:
    """Chunks with their original's key and is_dup.  The least key is aggregated before the shuffle, so a hot digest is cheap."""
    first = found.groupBy("sha1").agg(F.min(F.struct("src", "l1", "l2")).alias("o"))
    out = found.join(first, "sha1")
    same = (F.col("o.src") == F.col("src")) & (F.col("o.l1") == F.col("l1")) & (F.col("o.l2") == F.col("l2"))
    return out.select(*found.columns, F.col("o.src").alias("orig_src"), F.col("o.l1").alias("orig_l1"), F.col("o.l2").alias("orig_l2"), (~same).alias("is_dup"))


def unique(found: DataFrame) -> DataFrame:
    """Originals only: the key of each digest, by a left semi join."""
    first = found.groupBy("sha1").agg(F.min(F.struct("src", "l1", "l2")).alias("o")).select("sha1", "o.src", "o.l1", "o.l2")
    return found.join(first, ["sha1", "src", "l1", "l2"], "left_semi")


def duplicates(found: DataFrame) -> DataFrame:
    first = found.groupBy("sha1").agg(F.min(F.struct("src", "l1", "l2")).alias("o")).select("sha1", "o.src", "o.l1", "o.l2")
    return found.join(first, ["sha1", "src", "l1", "l2"], "left_anti")


def numbers(found: DataFrame) -> DataFrame:
    """Coarse chunks, refined chunks, uniques, duplicates."""
    r = F.count(F.lit(1))
    return found.agg(F.sum(F.when(F.col("l2") == 0, 1).otherwise(0)).cast("long").alias("fragments"), r.alias("refined"), F.countDistinct("sha1").alias("uniques"), (r - F.countDistinct("sha1")).alias("duplicates"))


def stats(found: DataFrame) -> DataFrame:
    """Sums and ratios over chunks.  Equal digests have one size, so counts by digest tell all, without a join."""
    per = found.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    a = per.agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("total_input"), F.sum("size").cast("long").alias("total_dedup"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))
    return a.select("*", F.round(F.col("total_input") / F.col("total_dedup"), 6).alias("factor"), F.round(F.col("n_duplicates") * 100.0 / F.col("n_chunks"), 6).alias("duplicate_percent"))


#: Units of sizes, each 1024 times the one before.
UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB")
HEADER_BYTES, RECORD_BYTES = 5, 9


def report(found: DataFrame, rows: DataFrame) -> DataFrame:
    """What an archive saved: totals, factors, overhead, and the largest unit in which no total is below 1."""
    out = rows.agg(F.sum(F.when(F.col("type") == PAYLOAD, F.col("size")).otherwise(0)).cast("long").alias("total_compressed"), (F.sum(F.col("size") + RECORD_BYTES) + HEADER_BYTES).cast("long").alias("total_output"))
    a = stats(found).crossJoin(out)  # one row each
    totals = [F.col(c) for c in ("total_input", "total_dedup", "total_compressed", "total_output")]
    least = F.least(*totals)
    unit = F.lit(UNITS[0])
    for k in range(1, len(UNITS)):
        unit = F.when(least >= 1024**k, UNITS[k]).otherwise(unit)
    ratio = lambda x, y: F.round(F.col(x) / F.col(y), 6)
    return a.select(
        *totals, "n_chunks", "n_duplicates", ratio("total_input", "total_output").alias("effective_factor"), ratio("total_input", "total_dedup").alias("dedup_factor"), ratio("total_dedup", "total_compressed").alias("compression_factor"),
        F.round(100.0 * (F.col("total_output") - F.col("total_compressed")) / F.col("total_output"), 6).alias("overhead_percent"), unit.alias("unit"),
    )


def size_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy(slot(F.col("size")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def size_moments(found: DataFrame) -> DataFrame:
    """Mean of slot middles; the root of the summed squared deviations, and with it over n, the standard deviation."""
    s = found.select(slot_middle(slot(F.col("size"))).alias("m"))
    a = s.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
    total = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return a.select("n", F.round(F.col("s") / F.col("n"), 4).alias("mean"), F.round(F.sqrt(total), 3).alias("root_sum_sq_dev"), F.round(F.sqrt(total / F.col("n")), 4).alias("stddev"))


def incomplete(found: DataFrame) -> DataFrame:
    """Coarse chunks whose refined chunks are not 0..n-1 with one last: none in a whole table."""
    g = found.groupBy("src", "l1").agg(F.count(F.lit(1)).alias("n"), F.max("l2").alias("top"), F.sum(F.col("is_last").cast("int")).alias("lasts"), F.countDistinct("l2").alias("d"))
    return g.filter((F.col("n") != F.col("top") + 1) | (F.col("d") != F.col("n")) | (F.col("lasts") != 1))


def reorder(found: DataFrame) -> DataFrame:
    return found.orderBy("src", "l1", "l2")


def squeeze(data: bytes, codec: str) -> bytes:
    return zlib.compress(data) if codec == "gzip" else bz2.compress(data, 9) if codec == "bzip2" else data


def unsqueeze(data: bytes, codec: str) -> bytes:
    return zlib.decompress(data) if codec == "gzip" else bz2.decompress(data) if codec == "bzip2" else data


def archive(found: DataFrame, codec: str = "none") -> DataFrame:
    """Archive rows (src, l1, l2, type, size, body, sha1) of chunks with data: payloads first, digests for the rest."""
    if codec not in CODECS:
        raise ValueError(f"codec is one of {sorted(CODECS)}, not {codec!r}")
    d = deduplicate(found.drop("data")).select("src", "l1", "l2", "sha1", "is_dup")
    rows = found.select("src", "l1", "l2", "data").join(d, ["src", "l1", "l2"])

    def bodies(batch):
        for src, l1, l2, data, sha, dup in zip(*map(batch.column, ("src", "l1", "l2", "data", "sha1", "is_dup")), strict=True):
            body = bytes.fromhex(sha.as_py()) if dup.as_py() else squeeze(data.as_py(), codec)
            yield src.as_py(), l1.as_py(), l2.as_py(), FINGERPRINT if dup.as_py() else PAYLOAD, len(body), body, sha.as_py()

    def run(batches):
        for batch in batches:
            yield from _batches(bodies(batch), ["src", "l1", "l2", "type", "size", "body", "sha1"], [*[_LONG] * 3, pa.int32(), _LONG, _BYTES, pa.string()])

    return rows.mapInArrow(run, "src long, l1 long, l2 long, type int, size long, body binary, sha1 string")


def decode(rows: DataFrame, codec: str = "none") -> DataFrame:
    """Chunks (src, l1, l2, data): each digest gets the payload met earlier under it; a missing or later one is an error."""
    key = F.struct("src", "l1", "l2")
    payloads = rows.filter(F.col("type") == PAYLOAD).select(F.col("sha1").alias("p_sha1"), key.alias("p_key"), F.col("body").alias("p_body"))
    met = rows.withColumn("sha", F.when(F.col("type") == FINGERPRINT, F.lower(F.hex("body"))).otherwise(F.col("sha1"))).join(payloads, F.col("sha") == F.col("p_sha1"), "left")
    late = F.col("p_key").isNull() | (F.col("p_key") > key)
    checked = F.when(late, F.raise_error(F.lit("data out of order: a digest stands before its payload"))).otherwise(F.col("p_body"))

    def opened(batch):
        for src, l1, l2, body in zip(*batch.columns, strict=True):
            yield src.as_py(), l1.as_py(), l2.as_py(), unsqueeze(body.as_py(), codec)

    def run(batches):
        for batch in batches:
            yield from _batches(opened(batch), ["src", "l1", "l2", "data"], [*[_LONG] * 3, _BYTES])

    return met.select("src", "l1", "l2", checked.alias("data")).mapInArrow(run, "src long, l1 long, l2 long, data binary")


def joined(decoded: DataFrame) -> DataFrame:
    """Whole streams again: (src, data), chunks in order."""
    parts = decoded.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("l1", "l2", "data"))).alias("p"))
    return parts.select("src", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.data))").alias("data"))


def offsets(found: DataFrame) -> DataFrame:
    """Where each chunk goes in its decoded stream."""
    w = W.partitionBy("src").orderBy("l1", "l2").rowsBetween(W.unboundedPreceding, -1)
    return found.select("src", "l1", "l2", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long").alias("out_offset"), "size")


def header(codec: str) -> bytes:
    return struct.pack("<iB", MAGIC, CODECS[codec])


def write_archive(rows: DataFrame, path: str, codec: str = "none") -> int:
    """One archive file in stream order, in any store, written as rows arrive: memory is one partition.  Returns its records."""
    n = 0

    def parts():
        nonlocal n
        yield header(codec)
        for r in rows.orderBy("src", "l1", "l2").toLocalIterator():
            n += 1
            yield struct.pack("<BQ", r.type, r.size) + bytes(r.body)

    write_bytes(rows.sparkSession, path, parts())
    return n


def write_stream(decoded: DataFrame, path: str) -> int:
    """The decoded chunks in order as one file, in any store.  Returns its size."""
    return write_bytes(decoded.sparkSession, path, (bytes(r.data) for r in decoded.orderBy("src", "l1", "l2").toLocalIterator()))


def read_records(data: bytes) -> tuple[str, list[tuple[int, bytes]]]:
    """Codec and records of an archive's bytes; damaged archives are errors."""
    if len(data) < 5 or struct.unpack_from("<i", data)[0] != MAGIC:
        raise ValueError("not an archive")
    names = {v: k for k, v in CODECS.items()}
    if data[4] not in names:
        raise ValueError(f"unknown codec {data[4]}")
    out, at = [], 5
    while at < len(data):
        kind, size = struct.unpack_from("<BQ", data, at)
        at += 9
        if kind not in (FINGERPRINT, PAYLOAD) or size == 0 or (kind == FINGERPRINT and size != 20) or at + size > len(data):
            raise ValueError(f"damaged record at byte {at - 9}")
        out.append((kind, data[at : at + size]))
        at += size
    return names[data[4]], out


def read_archive(spark, path: str) -> tuple[str, DataFrame]:
    """Codec and rows of one archive file, ready for decode."""
    found = spark.read.format("binaryFile").load(path).select("content")
    codec = read_records(bytes(found.first().content))[0]

    def parse(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                records = read_records(content)[1]
                sha = [body.hex() if kind == FINGERPRINT else hashlib.sha1(unsqueeze(body, codec)).hexdigest() for kind, body in records]
                zero = [0] * len(records)
                yield pa.RecordBatch.from_arrays([pa.array(zero, pa.int64()), pa.array(zero, pa.int64()), pa.array(range(len(records)), pa.int64()), pa.array([k for k, _ in records], pa.int32()), pa.array([len(x) for _, x in records], pa.int64()), pa.array([x for _, x in records], pa.binary()), pa.array(sha, pa.string())], names=["src", "l1", "l2", "type", "size", "body", "sha1"])

    return codec, found.mapInArrow(parse, "src long, l1 long, l2 long, type int, size long, body binary, sha1 string")
