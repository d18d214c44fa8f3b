import random
from math import comb

import numpy as np
import pytest

from tierpick.config import WEIGHTED
from tierpick.operators import grid, search


def test_grid_is_complete(spark):
    for steps in (1, 3, 5):
        frame = grid.weight_grid(spark, steps)
        check = grid.grid_check(frame).first()
        assert check["vectors"] == comb(steps + 6, 6) == grid.grid_size(steps)
        assert check["worst"] < 1e-6
        assert frame.distinct().count() == check["vectors"]


def test_steps_are_cut_off():
    assert [grid.steps_of(s) for s in (5, 2.5, 1, 3, 25)] == [20, 40, 100, 33, 4]
    assert grid.grid_size(20) == 230230 and grid.grid_size(100) == 1705904746


def test_vectors_by_place(spark):
    ks = [f"k{i}" for i in range(7)]
    frame = grid.weight_grid(spark, 4).orderBy(*ks).select(*ks).toPandas().to_numpy()
    assert (grid.vectors_at(np.arange(grid.grid_size(4)), 4) == frame).all()
    last = grid.vectors_at(np.array([grid.grid_size(100) - 1, 0]), 100)
    assert last.tolist() == [[100, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 100]]


SCHEMA = "date date, tims int, scored int, n int, " + ", ".join(f"{w} float" for w in WEIGHTED)


def candidates(spark, sizes, seed=3):
    random.seed(seed)
    rows, n = [], 0
    for g, size in enumerate(sizes):
        for _ in range(size):
            features = [random.choice([0.0, 0.25, 0.5, 0.75, 1.0]) for _ in WEIGHTED]
            rows.append((f"2024-01-{g // 3 + 1:02d}", g % 3 + 1, random.randint(0, 1), n, *features))
            n += 1
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA.replace("date date", "date string"))
    return frame.withColumn("date", frame["date"].cast("date")), rows


def brute_force(rows, steps):
    vectors = grid.vectors_at(np.arange(grid.grid_size(steps)), steps).astype(np.float32)
    vectors *= np.float32(1.0 / steps)
    groups = {}
    for row in sorted(rows, key=lambda r: r[3]):
        groups.setdefault(row[:2], []).append(row)
    result = []
    for w in vectors:
        correct = 0
        for members in groups.values():
            best = None
            for row in members:
                score = np.float32(0)
                for i in range(7):
                    score = np.float32(score + np.float32(np.float32(row[4 + i]) * w[i]))
                if best is None or score > best[0]:
                    best = (score, row[2])
            correct += best[1]
        result.append(correct)
    return result


@pytest.mark.parametrize("limit", [10**6, 20])
def test_every_vector_equals_brute_force(spark, limit):
    """Once with whole groups, once with large groups reduced to what can win."""
    frame, rows = candidates(spark, [1, 2, 90, 3, 4, 60, 5, 1, 7])
    found = search.evaluate_grid(frame, 3, ["n"], max_group_rows=limit).orderBy("wid").collect()
    assert [r["wid"] for r in found] == list(range(grid.grid_size(3)))
    assert [r["correct"] for r in found] == brute_force(rows, 3)


def test_groups_across_batches(spark):
    frame, rows = candidates(spark, [30, 45, 50, 47, 48, 49])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = search.evaluate_grid(frame, 2, ["n"]).orderBy("wid").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["correct"] for r in found] == brute_force(rows, 2)


def test_best_vector_first_and_last(spark):
    frame, rows = candidates(spark, [4, 4, 4, 4])
    want = brute_force(rows, 2)
    top = [i for i, c in enumerate(want) if c == max(want)]
    for tie, place in (("first", top[0]), ("last", top[-1])):
        best = search.search(frame, 2, ["n"], tie).first()
        assert (best["wid"], best["correct"]) == (place, max(want))
        vector = grid.vectors_at(np.array([place]), 2)[0] / 2
        assert [best[w] for w in WEIGHTED] == vector.tolist()
        assert (best["picks"], best["slots"]) == (4, 6)


def test_tile_layout_covers_the_grid():
    for rows, vectors, cores in ((10**4, 230230, 8), (10**9, 230230, 4000), (10**5, 10**9, 4000),
                                 (1, 7, 8), (0, 7, 1)):
        blocks, buckets = search.tile_layout(rows, vectors, cores)
        assert 1 <= blocks <= vectors and buckets >= 1
        assert -(-vectors // blocks) <= 1 << 20


def test_skyline_keeps_what_no_earlier_row_beats():
    rng = np.random.default_rng(4)
    for _ in range(20):
        rows = rng.integers(-2, 4, (rng.integers(1, 400), 7)).astype(np.float32)
        rows[:, rng.integers(0, 7)] = 1
        skyline, at, stays = search.Skyline(), 0, []
        while at < len(rows):
            n = int(rng.integers(1, 90))
            stays += skyline.add(rows[at:at + n]).tolist()
            at += n
        assert stays == [not (rows[:i] >= rows[i]).all(axis=1).any() for i in range(len(rows))]


def test_a_group_of_a_million_rows(spark):
    """Equal with and without the filter, and to the scores of all rows."""
    n = 1_000_000
    features = [f"CAST(pmod(hash(id, {i}), 1000) / 1000 AS float) AS {w}"
                for i, w in enumerate(WEIGHTED)]
    frame = spark.range(n).selectExpr(
        "date '2024-01-01' AS date", "1 AS tims", "int(pmod(hash(id), 3) = 0) AS scored", "id AS n",
        *features)
    found = search.evaluate_grid(frame, 2, ["n"]).orderBy("wid").collect()
    plain = search.evaluate_grid(frame, 2, ["n"], max_group_rows=n).orderBy("wid").collect()
    assert found == plain
    table = frame.orderBy("n").toPandas()
    columns = np.ascontiguousarray(table[list(WEIGHTED)].to_numpy(np.float32).T)
    vectors = grid.vectors_at(np.arange(grid.grid_size(2)), 2).astype(np.float32) * np.float32(0.5)
    best = [int(table["scored"][search.scores(v[None], columns)[0].argmax()]) for v in vectors]
    assert [r["correct"] for r in found] == best
    reduced = search.drop_beaten(frame.selectExpr(
        "datediff(date, date '1970-01-01') AS day", "tims", "scored AS hit", "n", *WEIGHTED), ["n"])
    assert 0 < reduced.count() < n / 20
