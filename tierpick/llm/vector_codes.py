"""Product codes of vectors: exact integer k-means per part, through metric trees.

Vectors are packed into blocks. A block gets one tree per part (``anchors``),
built once and written; every round sends the codebooks (parts x entries, a few
thousand numbers whatever the table) to the blocks, and a task answers with one
count and sum per entry. Only those reach the driver.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierpick.llm import anchors
from tierpick.session import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of one block at most (4,096 vectors of 64), unless one vector has more.
BLOCK_COMPONENTS = 1 << 18


class Compressed(NamedTuple):
    """codes: vec_id, label, code (binary, one byte per part), error; codebooks[part][entry]."""

    codes: DataFrame
    codebooks: list


def kept(vectors: DataFrame, vec_id: str, vector: str, label: str | None = None) -> DataFrame:
    """Rows (vec_id, vector, label) whose vector has components, all of them finite numbers."""
    v = F.col(vector).cast("array<double>")
    last = F.col(label) if label else F.lit(None).cast("int")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("vector"), last.alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < np.inf))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
_TREES = [
    ("points", _INT), ("order", _INT), ("balls", _INT), ("lo", _INT), ("hi", _INT),
    ("left", _INT), ("right", _INT), ("center", _DOUBLE), ("radius", _DOUBLE), ("sums", _LONG),
]


def _list(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values).reshape(-1)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))


def _block(ids: pa.Array, labels: pa.Array, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row: the ids and labels of a block, and for each part its points and tree."""
    if len(values) and 4.0 * values.shape[1] * float(np.abs(values).max()) ** 2 >= 2.0 ** 63:
        raise ValueError("components are too large for exact 64-bit distances")
    width = values.shape[1] // parts
    columns: dict[str, list] = {name: [] for name, _ in _TREES}
    for part in range(parts):
        points = values[:, part * width:(part + 1) * width]
        tree = anchors.build(points)
        columns["points"].append(points[tree.order].astype(np.int32))
        columns["balls"].append(np.array([len(tree.lo)], dtype=np.int32))
        for name in ("order", "lo", "hi", "left", "right", "center", "radius", "sums"):
            columns[name].append(getattr(tree, name))
    lists = [_list(np.concatenate([x.reshape(-1) for x in columns[name]])) for name, _ in _TREES]
    whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
    return pa.RecordBatch.from_arrays(
        whole + lists, names=["ids", "labels", *(name for name, _ in _TREES)])


def _trees(batch: pa.RecordBatch, row: int, parts: int):
    """The points and tree of each part of a written block."""
    flat = {name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
            for name, _ in _TREES}
    n = len(flat["order"]) // parts
    width = len(flat["points"]) // (n * parts)
    points = flat["points"].astype(np.int64).reshape(parts, n, width)
    first = 0
    for part, balls in enumerate(flat["balls"].tolist()):
        mine = slice(first, first + balls)
        wide = slice(first * width, (first + balls) * width)
        first += balls
        yield points[part], anchors.Tree(
            flat["order"][part * n:(part + 1) * n], flat["lo"][mine], flat["hi"][mine],
            flat["left"][mine], flat["right"][mine], flat["center"][wide].reshape(-1, width),
            flat["radius"][mine], flat["sums"][wide].reshape(-1, width))


def trees(rows: DataFrame, dimension: int, parts: int, scale: int) -> DataFrame:
    """One row per block of vectors with its trees; a block never leaves its task."""
    most = max(1, BLOCK_COMPONENTS // dimension)
    kinds = [rows.schema[c].dataType for c in ("vec_id", "label")]
    schema = T.StructType(
        [T.StructField(n, T.ArrayType(k)) for n, k in zip(("ids", "labels"), kinds)]
        + [T.StructField(n, T.ArrayType(k)) for n, k in _TREES])

    def run(batches):
        def block(table):
            values = table.column("vector").combine_chunks().flatten().to_numpy()
            values = np.floor(values.reshape(-1, dimension) * scale).astype(np.int64)
            return _block(table.column("vec_id").combine_chunks(),
                          table.column("label").combine_chunks(), values, parts)

        waiting, n = [], 0
        for batch in batches:
            for first in range(0, len(batch), most):
                waiting.append(batch.slice(first, most))
                n += len(waiting[-1])
                if n >= most:
                    table = pa.Table.from_batches(waiting)
                    yield block(table.slice(0, most))
                    waiting, n = table.slice(most).to_batches(), n - most
        if n:
            yield block(pa.Table.from_batches(waiting))

    return rows.mapInArrow(run, schema)


def _round(blocks: DataFrame, codebooks: np.ndarray) -> list:
    """Per part and entry with points: part, entry, count and the sum of each component."""
    parts, entries, width = codebooks.shape

    def run(batches):
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            for row in range(len(batch)):
                for part, (points, tree) in enumerate(_trees(batch, row, parts)):
                    c, s = anchors.totals(tree, points, codebooks[part])
                    counts[part] += c
                    sums[part] += s
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry],
                   *(sums[part, entry, i] for i in range(width))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns],
            names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    names = ["n", *(f"s{i}" for i in range(width))]
    found = blocks.select(*(n for n, _ in _TREES)).mapInArrow(
        run, "part int, entry int, " + ", ".join(f"{n} long" for n in names))
    exact = [F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names]
    return found.groupBy("part", "entry").agg(*exact).collect()  # parts x entries rows at most


def _coded(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    parts = len(codebooks)
    ids, labels = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                n = len(batch.column("ids")[row].values)
                code = np.zeros((n, parts), dtype=np.uint8)
                error = np.zeros(n, dtype=np.int64)
                for part, (points, tree) in enumerate(_trees(batch, row, parts)):
                    entry = anchors.nearest(tree, points, codebooks[part])
                    code[tree.order, part] = entry
                    error[tree.order] += ((points - codebooks[part][entry]) ** 2).sum(1)
                data = code.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, batch.column("labels")[row].values,
                     pa.array([data[i:i + parts] for i in range(0, len(data), parts)], pa.binary()),
                     pa.array(error)],
                    names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {ids}, label {labels}, code binary, error long")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
             label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes of all vectors by codebooks of their parts.

    Components become floor(scale * x). A part's codebook starts as that part of
    the vectors with the smallest ids; each round assigns every part to its
    nearest entry (squared distance, ties to the lower entry) and replaces the
    entries by floor(sum / count); entries without parts stay. All integers are
    exact; components beyond 64-bit distances raise ValueError.

    Dropped: vectors that are null, empty or hold null or non-finite components,
    and those of another length than the vector of the smallest id. The length
    must be a multiple of ``parts`` (else ValueError). Null ids come last as
    starting entries; equal ids go by their vectors. Repeated rows count and
    give a row each. Fewer vectors than entries give fewer entries. No vectors:
    no codes and no codebooks. Further columns are ignored.
    """
    rows = kept(vectors, vec_id, vector, label)
    seeds = rows.select("vec_id", "vector").orderBy(
        F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not seeds:
        none = rows.select("vec_id", "label", F.lit(b"").alias("code"),
                           F.lit(0).cast("long").alias("error"))
        return Compressed(none.limit(0), [])
    dimension = len(seeds[0]["vector"])
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components have no {parts} equal parts")
    same = F.size("vector") == dimension
    if any(len(s["vector"]) != dimension for s in seeds):
        seeds = rows.where(same).select("vec_id", "vector").orderBy(
            F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    blocks = stage(trees(rows.where(same), dimension, parts, scale), "metric-trees")
    start = np.floor(np.array([s["vector"] for s in seeds]) * scale).astype(np.int64)
    codebooks = start.reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for row in _round(blocks, codebooks):
            part, entry, n, *sums = row
            codebooks[part, entry] = [int(s) // int(n) for s in sums]
    return Compressed(_coded(blocks, codebooks), codebooks.tolist())


def digest(compressed: Compressed) -> DataFrame:
    """Codes in hex, errors per row and per label, and a checksum of the codebooks.

    Rows with a null label form one group of labels.
    """
    numbers = ",".join(str(x) for part in compressed.codebooks for entry in part for x in entry)
    codes = stage(compressed.codes, "codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("_label"), "label_error")
    # A label with very many rows is split by Spark's skew join; its total is one row.
    return codes.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.sha2(F.lit(numbers).cast("binary"), 256).alias("codebooks_sha256"))
