import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tierpick.llm import anchors, vector_codes


def nearest(points, entries):
    return ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)


def some_points(rng):
    n, width = rng.integers(1, 400), rng.integers(1, 5)
    points = rng.integers(-6, 7, (n, width)) if rng.random() < 0.5 else rng.integers(
        -3000, 3000, (n, width))
    if rng.random() < 0.3:
        points[: n // 2] = points[0]
    return points, points[rng.integers(0, n, min(n, rng.integers(1, 17)))]


def test_trees_give_the_nearest_entries_and_their_sums():
    rng = np.random.default_rng(1)
    for _ in range(150):
        points, entries = some_points(rng)
        tree = anchors.build(points)
        placed = points[tree.order]
        assert sorted(tree.order.tolist()) == list(range(len(points)))
        best = nearest(placed, entries)
        assert (anchors.nearest(tree, placed, entries) == best).all()
        counts, sums = anchors.totals(tree, placed, entries)
        for e in range(len(entries)):
            assert counts[e] == (best == e).sum()
            assert (sums[e] == placed[best == e].sum(0)).all()


def test_balls_hold_their_points_and_cache_their_sums():
    points, _ = some_points(np.random.default_rng(4))
    tree = anchors.build(points)
    placed = points[tree.order]
    for b in range(len(tree.lo)):
        mine = placed[tree.lo[b]:tree.hi[b]]
        assert (tree.sums[b] == mine.sum(0)).all()
        assert (np.sqrt(((mine - tree.center[b]) ** 2).sum(1)) <= tree.radius[b]).all()
        if tree.left[b] >= 0:
            assert tree.lo[tree.left[b]] == tree.lo[b] and tree.hi[tree.right[b]] == tree.hi[b]
            assert tree.hi[tree.left[b]] == tree.lo[tree.right[b]]


def test_far_apart_groups_are_owned_whole():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(0, 50, (300, 8)) + 10_000 * k for k in range(4)])
    owned, owner, places, _ = anchors.assign(
        anchors.build(points), points, points[[0, 300, 600, 900]])
    assert len(places) == 0 and sorted(set(owner.tolist())) == [0, 1, 2, 3] and len(owned) < 20


def brute_force(rows, parts=8, entries=16, rounds=6):
    good = [(k, v, g) for k, v, g in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return [], ""
    points = np.floor(np.array([v for _, v, _ in good]) * 4096).astype(np.int64)
    points = points.reshape(len(good), parts, -1)
    books = [points[:entries, p].copy() for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            best = nearest(points[:, p], books[p])
            for e in range(len(books[p])):
                mine = points[best == e, p]
                if len(mine):
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    codes = np.array([nearest(points[:, p], books[p]) for p in range(parts)]).T
    errors = [sum(int(((points[i, p] - books[p][codes[i, p]]) ** 2).sum()) for p in range(parts))
              for i in range(len(good))]
    by_label = defaultdict(int)
    for (_, _, g), e in zip(good, errors):
        by_label[g] += e
    text = ",".join(str(x) for b in books for e in b for x in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return [(k, bytes(c.tolist()).hex(), e, by_label[g], sha)
            for (k, _, g), c, e in zip(good, codes, errors)], sha


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "'x' AS code", "1L AS error", "2 AS part", "'y' AS _label", "5 AS points").repartition(3)


def check(spark, rows):
    got = vector_codes.digest(vector_codes.compress(frame_of(spark, rows)))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_force(rows)[0], key=str)


@pytest.mark.parametrize("block", [16 * 40, 1 << 18])
def test_query_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK_COMPONENTS", block)
    rng = random.Random(block)

    def vector():
        return [round(rng.gauss(0, 0.3), rng.choice([1, 5])) for _ in range(16)]

    rows = [(i, vector(), rng.choice([0, 0, 0, 1, None])) for i in range(200)]
    rows += [rows[3]] * 90  # a group of repeated rows
    rows += [(None, vector(), 1), (5, vector(), None), (5, None, 1), (6, [], 1),
             (7, [None] + vector()[1:], 0), (-1, [math.nan] + vector()[1:], 0),
             (-2, [math.inf] + vector()[1:], 0), (8, [-0.0] * 16, 1)]
    rng.shuffle(rows)
    check(spark, rows)


def test_fewer_vectors_than_entries_and_none(spark):
    check(spark, [(2, [0.1] * 8, 1), (1, [-0.1] * 8, None), (9, [0.1] * 8, 1)])
    check(spark, [])
    check(spark, [(1, None, 2)])


def test_lengths(spark):
    rows = [(1, [0.1] * 8, 1), (2, [0.2] * 16, 1), (3, [0.3] * 8, 1)]
    codes = vector_codes.compress(frame_of(spark, rows)).codes
    assert sorted(r["vec_id"] for r in codes.collect()) == [1, 3]
    with pytest.raises(ValueError):
        vector_codes.compress(frame_of(spark, [(1, [0.1] * 9, 1)]))
