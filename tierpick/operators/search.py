"""Which weight vector would have picked best: every vector on every candidate.

The work is laid out as tiles of (block of vectors) x (bucket of candidate
groups). Candidates are copied once per block and shuffled to their tile; a
task rebuilds the vectors of its block from their position in the grid. Picks
of a (date, tier) group are decided inside a tile, and correct picks add up
over groups, so a tile yields one count per vector. A group is read as a stream
with the best score so far of each vector, so its size does not matter; large
groups first lose the candidates that no weights can let win.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.config import BOUNDS, MAX_GROUP_ROWS, TIERS, WEIGHTED
from tierpick.operators.grid import PARTS, grid_size, vectors_at
from tierpick.operators.scoring import labelled, normalise
from tierpick.operators.skew import split_hot
from tierpick.session import stage

_TILE_SCORES = 10**10  # scores of one tile, at most about
_MAX_BLOCK = 1 << 20   # vectors of one tile, at most
_CELLS = 1 << 16       # scores held at once, to stay in the processor cache
_LONG = 48             # groups from this size on are searched row-wise
_TOGETHER = 1024       # short groups walked together, rows compared together
_STRONG = 256          # rows of a skyline compared together


def search_input(df: DataFrame, order: list[str], bounds=BOUNDS) -> DataFrame:
    """Labelled candidates with their weighted features, ready for the search."""
    rows = normalise(labelled(df), bounds, keep=["date", "tims", "scored", *order])
    finite = None
    for w in WEIGHTED:
        ok = F.col(w).isNotNull() & ~F.isnan(w)
        finite = ok if finite is None else finite & ok
    return rows.where(finite)


def scores(vectors: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """float32 scores, vectors x rows, added up in the fixed order of the features.

    ``columns`` holds one contiguous line per feature.
    """
    total = vectors[:, 0, None] * columns[0]
    term = np.empty_like(total)
    for i in range(1, PARTS):
        np.multiply(vectors[:, i, None], columns[i], out=term)
        total += term
    return total


def _columns(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.T)


def _slices(n_vectors: int, n_rows: int):
    step = max(1, _CELLS // max(1, n_rows))
    for start in range(0, n_vectors, step):
        yield slice(start, min(start + step, n_vectors))


def count_hits(vectors: np.ndarray, rows: np.ndarray, hit: np.ndarray, starts: np.ndarray
               ) -> np.ndarray:
    """Correct picks of each vector over complete groups.

    ``rows`` are sorted by group and order; ``starts`` are the first rows of
    the groups. The first of several highest scores is the pick.
    """
    correct = np.zeros(len(vectors), dtype=np.int64)
    sizes = np.diff(np.append(starts, len(rows)))
    for start, size in zip(starts[sizes >= _LONG], sizes[sizes >= _LONG]):
        columns, hits = _columns(rows[start : start + size]), hit[start : start + size]
        for part in _slices(len(vectors), size):
            correct[part] += hits[np.argmax(scores(vectors[part], columns), axis=1)]
    short = sizes < _LONG
    by_size = np.argsort(-sizes[short], kind="stable")
    first, length = starts[short][by_size], sizes[short][by_size]
    for at in range(0, len(first), _TOGETHER):
        begin, count = first[at : at + _TOGETHER], length[at : at + _TOGETHER]
        correct += _count_short(vectors, rows, hit, begin, count)
    return correct


def _count_short(vectors, rows, hit, begin, count) -> np.ndarray:
    """Walk short groups together: their j-th rows against the best so far.

    ``count`` falls, so the groups that still have a j-th row come first.
    """
    layers = []
    for j in range(int(count[0])):
        index = begin[: int(np.searchsorted(-count, -j, side="left"))] + j
        layers.append((_columns(rows[index]), hit[index]))
    correct = np.empty(len(vectors), dtype=np.int64)
    for part in _slices(len(vectors), len(begin)):
        block = vectors[part]
        best = scores(block, layers[0][0])
        won = np.repeat(layers[0][1][None, :], len(block), axis=0)
        for columns, hits in layers[1:]:
            live = len(hits)
            other, ahead, held = scores(block, columns), best[:, :live], won[:, :live]
            better = (other > ahead).view(np.int8)
            np.maximum(ahead, other, out=ahead)
            # Hits are 0 or 1: take over the bit where the score is better.
            better &= held ^ hits
            held ^= better
        correct[part] = won.sum(axis=1, dtype=np.int64)
    return correct


def _group_starts(date: np.ndarray, tims: np.ndarray) -> np.ndarray:
    new = np.ones(len(date), dtype=bool)
    new[1:] = (date[1:] != date[:-1]) | (tims[1:] != tims[:-1])
    return np.flatnonzero(new)


def _block_vectors(block: int, block_size: int, steps: int, step: float):
    low = block * block_size
    ids = np.arange(low, min(low + block_size, grid_size(steps)), dtype=np.int64)
    return ids, vectors_at(ids, steps).astype(np.float32) * np.float32(step)


class _Running:
    """Best score so far and its outcome, for each vector, of one group read in pieces."""

    def __init__(self, n: int):
        self.best = np.empty(n, dtype=np.float32)
        self.won = np.zeros(n, dtype=np.int64)
        self.key, self.empty = None, True

    def open(self, key: tuple):
        self.key, self.empty = key, True

    def add(self, vectors: np.ndarray, rows: np.ndarray, hit: np.ndarray):
        """Later rows of the group; only a higher score replaces the best."""
        for start in range(0, len(rows), _CELLS):
            columns = _columns(rows[start:start + _CELLS])
            hits = hit[start:start + _CELLS]
            for part in _slices(len(vectors), columns.shape[1]):
                table = scores(vectors[part], columns)
                where = np.argmax(table, axis=1)
                top = np.take_along_axis(table, where[:, None], axis=1)[:, 0]
                better = (top > self.best[part]) | self.empty
                self.best[part][better] = top[better]
                self.won[part][better] = hits[where[better]]
            self.empty = False


def _tile_counts(steps: int, step: float, block_size: int):
    """mapInPandas body for sorted tiles: one count per vector and tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, vectors, correct, running = None, None, None, None

        def counts():
            if running.key is not None:
                np.add(correct, running.won, out=correct)
            ids = np.arange(len(correct), dtype=np.int64) + block * block_size
            return pd.DataFrame({"wid": ids, "correct": correct})

        for batch in batches:
            for number, frame in batch.groupby("block", sort=True):
                if number != block:
                    if block is not None:
                        yield counts()
                    block = number
                    vectors = _block_vectors(block, block_size, steps, step)[1]
                    correct = np.zeros(len(vectors), dtype=np.int64)
                    running = _Running(len(vectors))
                day, tims = frame["day"].to_numpy(), frame["tims"].to_numpy()
                rows = frame[list(WEIGHTED)].to_numpy(dtype=np.float32)
                hit = frame["hit"].to_numpy(dtype=np.int8)
                starts = _group_starts(day, tims)
                first = 0
                if running.key == (day[0], tims[0]):  # goes on from the last batch
                    first = starts[1] if len(starts) > 1 else len(rows)
                    running.add(vectors, rows[:first], hit[:first])
                    starts = starts[1:]
                if not len(starts):
                    continue
                if running.key is not None:
                    correct += running.won
                # The last group may go on in the next batch.
                last = starts[-1]
                if len(starts) > 1:
                    correct += count_hits(
                        vectors, rows[first:last], hit[first:last], starts[:-1] - first)
                running.open((day[last], tims[last]))
                running.add(vectors, rows[last:], hit[last:])
        if block is not None:
            yield counts()

    return run


class Skyline:
    """Rows that no earlier row equals or beats in all features.

    Weights are not negative and rounding keeps the order of numbers, so the
    score of a row that is beaten never exceeds that of the earlier one, which
    also wins the tie. Rows come in their order, in pieces.
    """

    def __init__(self):
        self.rows = np.empty((0, PARTS), dtype=np.float32)  # strong rows first

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Which of the next rows stay."""
        stays = np.zeros(len(rows), dtype=bool)
        for start in range(0, len(rows), _TOGETHER):
            piece = rows[start:start + _TOGETHER]
            alive = np.arange(len(piece))
            for at in range(0, len(self.rows), _STRONG):
                if not len(alive):
                    break
                alive = alive[~_beaten(piece[alive], self.rows[at:at + _STRONG]).any(axis=1)]
            earlier = np.tri(len(alive), k=-1, dtype=bool)
            alive = alive[~(_beaten(piece[alive], piece[alive]) & earlier).any(axis=1)]
            stays[start + alive] = True
            joined = np.concatenate([self.rows, piece[alive]])
            self.rows = joined[np.argsort(-joined.sum(axis=1), kind="stable")]
        return stays


def _beaten(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """[i, j]: row i is equalled or beaten by other j in all features."""
    beaten = others[:, 0] >= rows[:, 0, None]
    for i in range(1, PARTS):
        beaten &= others[:, i] >= rows[:, i, None]
    return beaten


def _skyline_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body for sorted parts of groups: the rows of each part's skyline."""
    key, skyline = None, None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("day", "tims", "part")], axis=1)
        rows = np.stack([batch.column(w).to_numpy() for w in WEIGHTED], axis=1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        stays = []
        for first, last in zip([0, *new], [*new, len(batch)]):
            if tuple(keys[first]) != key:
                key, skyline = tuple(keys[first]), Skyline()
            stays.append(skyline.add(rows[first:last]))
        yield batch.filter(pa.array(np.concatenate(stays)))


def drop_beaten(rows: DataFrame, order: list[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Take rows that can't win with any weights out of groups above ``max_rows``.

    Such a group is cut into parts, each part keeps its skyline, and what is left
    is cut anew, now mostly into one part. Smaller groups stay as they are, so
    the best of every group stays for all weights.
    """
    hot = (
        rows.groupBy("day", "tims").agg(F.count("*").alias("_n"))
        .where(F.col("_n") > max_rows).select("day", "tims")
    )
    left = rows.join(hot, ["day", "tims"], "left_semi")
    for _ in range(2):
        parts = split_hot(left, ["day", "tims"], order, max_rows)
        parts = parts.repartition("day", "tims", "part").sortWithinPartitions(
            "day", "tims", "part", *order)
        left = stage(parts.mapInArrow(_skyline_rows, parts.schema).drop("part"), "skyline")
    return rows.join(hot, ["day", "tims"], "left_anti").unionByName(left)


def tile_layout(rows: int, vectors: int, cores: int, largest: int = 0) -> tuple[int, int]:
    """Number of blocks of vectors and of buckets of candidates.

    A block costs one more copy of the candidates in the shuffle, a bucket one
    more count per vector; the split weighs the two at about 40 and 16 bytes.
    The largest group lies in one bucket, so it asks for blocks of its own.
    """
    tiles = max(2 * cores, rows * vectors // _TILE_SCORES)
    blocks = round((0.4 * vectors * tiles / max(rows, 1)) ** 0.5)
    least = max(1, -(-vectors // _MAX_BLOCK), largest * vectors // _TILE_SCORES)
    blocks = min(max(blocks, least), vectors)
    return blocks, max(1, -(-tiles // blocks))


@dataclass
class Shape:
    """Size of a search input, from one aggregate over its groups."""

    rows: int
    largest: int
    picks: int
    dates: int


def input_shape(candidates: DataFrame) -> Shape:
    row = candidates.groupBy("date", "tims").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        F.count("*").alias("picks"), F.countDistinct("date").alias("dates"),
    ).first()
    return Shape(**row.asDict())


def evaluate_grid(candidates: DataFrame, steps: int, order: list[str],
                  step: float | None = None, max_group_rows: int = MAX_GROUP_ROWS,
                  shape: Shape | None = None) -> DataFrame:
    """Correct picks of every vector of the grid: wid (lexicographic place), correct.

    ``candidates`` come from ``search_input``. The smallest ``order`` wins a tie.
    Groups above ``max_group_rows`` lose the rows that can't win before they are
    copied to the blocks.
    """
    spark = candidates.sparkSession
    step = 1.0 / steps if step is None else step
    size = grid_size(steps)
    shape = shape or input_shape(candidates)
    rows = candidates.select(
        F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"),
        F.col("tims").cast("int").alias("tims"),
        (F.col("scored") > 0).cast("int").alias("hit"),
        *WEIGHTED, *order,
    )
    n, largest = shape.rows, shape.largest
    if largest > max_group_rows:
        rows = stage(drop_beaten(rows, order, max_group_rows), "candidates")
        left = rows.groupBy("day", "tims").count().agg(F.sum("count"), F.max("count")).first()
        n, largest = left[0], left[1]
    blocks, buckets = tile_layout(n, size, spark.sparkContext.defaultParallelism, largest)
    block_size = -(-size // blocks)
    blocks = -(-size // block_size)

    copies = rows.withColumn("bucket", F.pmod(F.xxhash64("day", "tims"), F.lit(buckets)))
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tile = (F.col("block") * buckets + F.col("bucket")).cast("int")
    tiles = copies.repartitionById(blocks * buckets, tile).sortWithinPartitions(
        "block", "day", "tims", *order
    )
    counts = tiles.select("block", "day", "tims", "hit", *WEIGHTED).mapInPandas(
        _tile_counts(steps, step, block_size), "wid long, correct long"
    )
    return counts.groupBy("wid").agg(F.sum("correct").alias("correct"))


def with_weights(results: DataFrame, steps: int, step: float | None = None) -> DataFrame:
    """Add the weights that belong to ``wid``, in the tasks that hold the rows."""
    step = 1.0 / steps if step is None else step
    fields = ", ".join(f"{w} float" for w in WEIGHTED)
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in results.schema.fields)

    def run(batches):
        for batch in batches:
            table = vectors_at(batch["wid"].to_numpy(), steps).astype(np.float32) * np.float32(step)
            for i, w in enumerate(WEIGHTED):
                batch[w] = table[:, i]
            yield batch

    return results.mapInPandas(run, f"{own}, {fields}")


def best_weights(results: DataFrame, tie: str = "first") -> DataFrame:
    """The vector with the most correct picks; ties go to the first or last in the grid."""
    place = F.col("wid").asc() if tie == "first" else F.col("wid").desc()
    return results.orderBy(F.col("correct").desc(), place).limit(1)


def search(candidates: DataFrame, steps: int, order: list[str], tie: str = "first",
           step: float | None = None, **kw) -> DataFrame:
    """Best vector with its correct picks, the picks made and the slots."""
    rows = stage(candidates, "search")  # read several times below
    shape = input_shape(rows)
    results = evaluate_grid(rows, steps, order, step, shape=shape, **kw)
    best = with_weights(best_weights(results, tie), steps, step)
    return best.withColumn("picks", F.lit(shape.picks).cast("long")).withColumn(
        "slots", F.lit(shape.dates * len(TIERS)).cast("long")
    )
