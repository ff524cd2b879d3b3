"""The 4-D integer stencil: each cell grows by its three lower neighbours, 15 times floor(sqrt + log + sin)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = 15


def cube(spark: SparkSession, dims: tuple[int, int, int, int]) -> DataFrame:
    """Cells (w, x, y, z, v) with v the flat index modulo 10, plus 1."""
    w, x, y, z = dims
    return spark.range(w * x * y * z).selectExpr(f"cast(id div {x * y * z} as int) AS w", f"cast(id div {y * z} % {x} as int) AS x", f"cast(id div {z} % {y} as int) AS y", f"cast(id % {z} as int) AS z", "cast(id % 10 + 1 as int) AS v")


def plane(cells: np.ndarray) -> np.ndarray:
    """One z: cells by (w, x, y), updated along the planes w + x + y = d, whose inputs all lie on the plane before."""
    a = cells.copy()
    nw, nx, ny = a.shape
    w, x, y = (g.ravel() for g in np.indices((nw, nx, ny)))
    inner = (w > 0) & (x > 0) & (y > 0)
    level = w + x + y
    for d in range(3, nw + nx + ny - 2):
        at = np.flatnonzero(inner & (level == d))
        i, j, k = w[at], x[at], y[at]
        # the standard library's functions, so that results do not depend on vector units
        grown = [math.floor(math.sqrt(p) + math.log(q) + math.sin(r)) for p, q, r in zip(a[i - 1, j, k].tolist(), a[i, j - 1, k].tolist(), a[i, j, k - 1].tolist(), strict=True)]
        a[i, j, k] += STEPS * np.array(grown, a.dtype)
    return a


def heat(cells: DataFrame, dims: tuple[int, int, int, int]) -> DataFrame:
    """All z at once: they do not depend on each other."""
    nw, nx, ny, _ = dims

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((nw, nx, ny), np.int64)
        a[pdf.w, pdf.x, pdf.y] = pdf.v
        out = plane(a)
        return pdf.assign(v=out[pdf.w, pdf.x, pdf.y].astype(np.int32))

    return cells.groupBy("z").applyInPandas(one, "w int, x int, y int, z int, v int").select("w", "x", "y", "z", "v")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in one and not the other: none if the matrices are equal."""
    return a.exceptAll(b).union(b.exceptAll(a)).select([F.col(c) for c in a.columns])
