"""Grid of weight vectors: all ways to split n steps over the seven weights."""

from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierpick.config import WEIGHTED

PARTS = len(WEIGHTED)


def steps_of(step_percent: float) -> int:
    """Number of steps of a step size in percent; a remainder is cut off."""
    return int(np.float32(1.0) / (np.float32(step_percent) / np.float32(100.0)))


def grid_size(steps: int) -> int:
    return comb(steps + PARTS - 1, PARTS - 1)


def weight_grid(spark: SparkSession, steps: int, step: float | None = None,
                partitions: int | None = None) -> DataFrame:
    """Weight vectors as float32 columns, with the steps of each as ``k0``..``k6``.

    Built by nested explodes whose upper bound is what the parts before leave,
    so no vector is generated and then dropped. ``step`` defaults to 1/steps.
    """
    step = 1.0 / steps if step is None else step
    grid = spark.range(0, steps + 1, 1, partitions or min(steps + 1, 64)).select(
        F.col("id").cast("int").alias("k0"), (steps - F.col("id")).cast("int").alias("left")
    )
    for i in range(1, PARTS - 1):
        grid = grid.withColumn(f"k{i}", F.explode(F.sequence(F.lit(0), F.col("left"))))
        grid = grid.withColumn("left", F.col("left") - F.col(f"k{i}"))
    grid = grid.withColumnRenamed("left", f"k{PARTS - 1}")
    unit = F.lit(step).cast("float")
    return grid.select(
        *[f"k{i}" for i in range(PARTS)],
        *[(F.col(f"k{i}").cast("float") * unit).alias(w) for i, w in enumerate(WEIGHTED)],
    )


def grid_check(grid: DataFrame) -> DataFrame:
    """Size of the grid and how far the weight sums are from 1."""
    total = sum((F.col(w).cast("double") for w in WEIGHTED), F.lit(0.0))
    return grid.agg(F.count("*").alias("vectors"), F.max(F.abs(total - 1)).alias("worst"))


def vectors_at(ranks: np.ndarray, steps: int) -> np.ndarray:
    """Step counts of the vectors at the given places of the lexicographic order.

    A task makes just its own block of the grid, so the grid itself is never
    shipped nor held as a whole. The work goes in slices, as a vector takes as
    many numbers on the way as there are steps.
    """
    ranks = np.asarray(ranks, dtype=np.int64)
    tables = [_ahead(PARTS - 1 - i, steps) for i in range(PARTS - 1)]
    out = np.empty((len(ranks), PARTS), dtype=np.int32)
    for at in range(0, len(ranks), _SLICE):
        out[at:at + _SLICE] = _slice_of_vectors(ranks[at:at + _SLICE], steps, tables)
    return out


_SLICE = 1 << 14


def _ahead(tail: int, steps: int) -> np.ndarray:
    """[r, a]: vectors whose next part is below a when r steps are left for 1 + ``tail`` parts."""
    ahead = np.zeros((steps + 1, steps + 2), dtype=np.int64)
    for r in range(steps + 1):
        sizes = [comb(r - a + tail - 1, tail - 1) for a in range(r + 1)]
        ahead[r, 1 : r + 2] = np.cumsum(sizes)
        ahead[r, r + 2 :] = np.iinfo(np.int64).max
    return ahead


def _slice_of_vectors(ranks: np.ndarray, steps: int, tables: list[np.ndarray]) -> np.ndarray:
    rest = ranks.copy()
    left = np.full(len(rest), steps, dtype=np.int64)
    out = np.empty((len(rest), PARTS), dtype=np.int32)
    for i, ahead in enumerate(tables):
        value = (ahead[left, 1:] <= rest[:, None]).sum(axis=1)
        rest -= ahead[left, value]
        left -= value
        out[:, i] = value
    out[:, -1] = left
    return out
