"""Matrices as coordinate tables and tiles: products, LU, triangular solves.

Everything works tile by tile: a task holds a few tiles of `size` by `size` numbers, the
driver one tile of the diagonal, and shuffles move tiles, not numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.session import written

SIZE = 256
_TILE = "bi long, bj long, data binary"


def ones_lower(spark: SparkSession, n: int) -> DataFrame:
    r = spark.range(n)
    return r.select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i")))).withColumn("v", F.lit(1.0))


def least_matrix(spark: SparkSession, n: int) -> DataFrame:
    """A[i][j] = min(i, j) + 1: the ones-lower matrix times its transpose, in closed form."""
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j")).withColumn("v", (F.least("i", "j") + 1).cast("double"))


def right_sides(spark: SparkSession, n: int, count: int) -> DataFrame:
    """Vectors (rhs, i, v) of small numbers: v = (n * rhs + i) * 7 % 11 + 1."""
    return spark.range(count * n).selectExpr(f"id div {n} AS rhs", f"id % {n} AS i", "cast(id * 7 % 11 + 1 as double) AS v")


def zero_diagonal(a: DataFrame) -> DataFrame:
    return a.filter((F.col("i") == F.col("j")) & (F.col("v") == 0))


def _square(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data).reshape(size, size)


def tiles(a: DataFrame, size: int = SIZE) -> DataFrame:
    """(bi, bj, data): tiles of size by size numbers, row by row."""
    own = a.select((F.col("i") / size).cast("long").alias("bi"), (F.col("j") / size).cast("long").alias("bj"), "i", "j", F.col("v").cast("double").alias("v"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((size, size))
        t[pdf.i.to_numpy() % size, pdf.j.to_numpy() % size] = pdf.v.to_numpy()
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "data": [t.tobytes()]})

    return own.groupBy("bi", "bj").applyInPandas(pack, _TILE)


def untile(t: DataFrame, size: int, rows: int, columns: int) -> DataFrame:
    """(i, j, v) of the first `rows` by `columns` numbers."""

    def spread(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                m = _square(r.data, size)[: rows - r.bi * size, : columns - r.bj * size]
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"i": i.ravel() + r.bi * size, "j": j.ravel() + r.bj * size, "v": m.ravel()})

    return t.mapInPandas(spread, "i long, j long, v double")


def product(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of A B: pairs of tiles are joined on the inner index and multiplied, products of one place added up."""
    left, right = a.select("bi", F.col("bj").alias("k"), F.col("data").alias("l")), b.select(F.col("bi").alias("k"), "bj", F.col("data").alias("r"))

    def multiply(frames):
        for pdf in frames:
            total: dict[tuple[int, int], np.ndarray] = {}  # added up within a batch before the shuffle
            for r in pdf.itertuples():
                own = _square(r.l, size) @ _square(r.r, size)
                total[r.bi, r.bj] = total[r.bi, r.bj] + own if (r.bi, r.bj) in total else own
            yield pd.DataFrame([(i, j, m.tobytes()) for (i, j), m in total.items()], columns=["bi", "bj", "data"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "data": [sum(_square(x, size) for x in pdf["data"]).tobytes()]})

    return left.join(right, "k").select("bi", "bj", "l", "r").mapInPandas(multiply, _TILE).groupBy("bi", "bj").applyInPandas(add, _TILE)


def gram(a: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """A times its transpose, for n rows."""
    flipped = a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return untile(product(tiles(a, size), tiles(flipped, size), size), size, n, n)


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """b = A x for vectors (rhs, i, v)."""
    x = x.select("rhs", F.col("i").alias("k"), F.col("v").alias("w"))
    return a.join(x, a.j == x.k).groupBy("rhs", "i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def packed_lu(m: np.ndarray) -> np.ndarray:
    """Doolittle without pivots, L below the diagonal of U; a zero pivot is an error."""
    m = m.copy()
    for k in range(len(m)):
        if m[k, k] == 0:
            raise ValueError(f"zero on the diagonal at {k}")
        m[k + 1 :, k] /= m[k, k]
        m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    return m


def _diagonal(t: DataFrame, k: int, n: int, size: int) -> np.ndarray:
    """Tile k of the diagonal; behind the matrix's end it has ones."""
    d = _square(t.filter((F.col("bi") == k) & (F.col("bj") == k)).first().data, size).copy()
    end = np.arange(min(n - k * size, size), size)
    d[end, end] = 1.0
    return d


def lu_tiles(t: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """Packed LU of tiles: a diagonal tile is factored, its row and column are solved, the rest is updated."""
    spark, done = t.sparkSession, None
    for k in range(-(-n // size)):
        t = written(t, "lu")
        f = spark.sparkContext.broadcast(packed_lu(_diagonal(t, k, n, size)))

        def panel(frames, f=f, k=k):
            lower, upper = np.tril(f.value, -1) + np.eye(size), np.triu(f.value)
            for pdf in frames:
                pdf["data"] = [(f.value if r.bi == r.bj else np.linalg.solve(lower, _square(r.data, size)) if r.bi == k else np.linalg.solve(upper.T, _square(r.data, size).T).T).tobytes() for r in pdf.itertuples()]
                yield pdf

        edge = written(t.filter((F.col("bi") == k) | (F.col("bj") == k)).mapInPandas(panel, _TILE), "lu")
        done = edge if done is None else done.union(edge)
        left = edge.filter((F.col("bj") == k) & (F.col("bi") > k)).select("bi", F.col("data").alias("l"))
        top = edge.filter((F.col("bi") == k) & (F.col("bj") > k)).select("bj", F.col("data").alias("u"))

        def update(frames):
            for pdf in frames:
                pdf["data"] = [(_square(r.data, size) - _square(r.l, size) @ _square(r.u, size)).tobytes() for r in pdf.itertuples()]
                yield pdf[["bi", "bj", "data"]]

        t = t.filter((F.col("bi") > k) & (F.col("bj") > k)).join(left, "bi").join(top, "bj").select("bi", "bj", "data", "l", "u").mapInPandas(update, _TILE)
    return done


def lu(a: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """Packed LU of (i, j, v)."""
    return untile(lu_tiles(tiles(a, size), n, size), size, n, n)


def _sweep(factors: DataFrame, x: DataFrame, n: int, size: int, down: bool) -> DataFrame:
    """One triangular solve for tiles of right sides: each step solves a row of tiles and takes it off the rest."""
    spark, done, blocks = x.sparkSession, None, -(-n // size)
    for k in range(blocks) if down else range(blocks - 1, -1, -1):
        x = written(x, "solve")
        f = spark.sparkContext.broadcast(_diagonal(factors, k, n, size))

        def row(frames, f=f):
            m = np.tril(f.value, -1) + np.eye(size) if down else np.triu(f.value)
            for pdf in frames:
                pdf["data"] = [np.linalg.solve(m, _square(d, size)).tobytes() for d in pdf["data"]]
                yield pdf

        solved = written(x.filter(F.col("bi") == k).mapInPandas(row, _TILE), "solve")
        done = solved if done is None else done.union(solved)
        rest = (F.col("bi") > k) if down else (F.col("bi") < k)
        panel = factors.filter((F.col("bj") == k) & rest).select("bi", F.col("data").alias("l"))

        def take_off(frames):
            for pdf in frames:
                pdf["data"] = [(_square(r.data, size) - _square(r.l, size) @ _square(r.u, size)).tobytes() for r in pdf.itertuples()]
                yield pdf[["bi", "bj", "data"]]

        x = x.filter(rest).join(panel, "bi").join(solved.select("bj", F.col("data").alias("u")), "bj").select("bi", "bj", "data", "l", "u").mapInPandas(take_off, _TILE)
    return done


def solve_tiles(factors: DataFrame, b: DataFrame, n: int, count: int, size: int = SIZE) -> DataFrame:
    """x of L U x = b from the packed tiles, for `count` right sides (rhs, i, v): two sweeps over rows of tiles."""
    spark = b.sparkSession
    places = spark.range(-(-n // size)).select(F.col("id").alias("bi")).crossJoin(spark.range(-(-count // size)).select(F.col("id").alias("bj")))  # of tiles
    sides = tiles(b.select("i", F.col("rhs").alias("j"), "v"), size)
    zero = F.lit(bytes(8 * size * size))
    sides = places.join(sides, ["bi", "bj"], "left").select("bi", "bj", F.coalesce("data", zero).alias("data"))
    x = _sweep(factors, _sweep(factors, sides, n, size, True), n, size, False)
    return untile(x, size, n, count).select(F.col("j").alias("rhs"), "i", "v")


def solve(packed: DataFrame, b: DataFrame, n: int, count: int, size: int = SIZE) -> DataFrame:
    """x of L U x = b from packed factors (i, j, v)."""
    return solve_tiles(written(tiles(packed, size), "factors"), b, n, count, size)


def factor_solve(a: DataFrame, b: DataFrame, n: int, count: int, size: int = SIZE) -> DataFrame:
    """x of A x = b: the factors are found once and used for all right sides."""
    return solve_tiles(lu_tiles(tiles(a, size), n, size), b, n, count, size)
