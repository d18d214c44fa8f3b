import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tierpick.llm import sharding

ROWS = [(i, "t" * (i % 7)) for i in range(400)] + [
    (500, None), (501, "é😀"), (502, "x" * 50_000), (503, "a"), (503, "a"), (None, "n")]


def test_sizes_checksums_slots_and_growth(documents):
    got = sharding.assign(documents(*ROWS)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({i for i, _ in ROWS})
    assert {r.law for r in got} == {"key"}
    assert 20 <= sum(r.grown_shard == 8 for r in got) <= 75  # a ninth is 45


def drawn(key, level, node, weight):
    """The draw of a node, apart from Spark."""
    seed = 42
    for value in (key, 3 * node + level):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", value), seed)
    return -math.log(((seed >> 11) + 0.5) * 2.0 ** -53) / weight


def descended(key, tree):
    """Region, rack and shard of a key by plain descent."""
    path = []
    for level in range(3):
        weights = defaultdict(float)
        for leaf in tree:
            if list(leaf[:level]) == path and leaf[3] > 0:
                weights[leaf[level]] += leaf[3]
        path.append(min((drawn(key, level, node, w), node) for node, w in weights.items())[1])
    return tuple(path)


# Weights differ at every level; regions, racks and shards don't fill up evenly.
UNEVEN = [(0, 0, 0, 1.0), (0, 0, 1, 2.5), (0, 1, 2, 4.0), (1, 2, 3, 0.5), (1, 3, 4, 1.0),
          (1, 3, 5, 3.0), (1, 3, 6, 0.0), (2, 4, 7, 6.0)]


def test_shards_like_plain_descent(spark):
    trees = {"a": sharding.even_tree(8), "b": sharding.grown(sharding.even_tree(8)), "c": UNEVEN}
    rows = spark.range(-500, 1500).select("id", *[
        sharding.shard_of(F.col("id"), t).alias(n) for n, t in trees.items()]).collect()
    for r in rows:
        for name, tree in trees.items():
            assert r[name] == descended(r.id, tree)[2], (r.id, name)


def test_every_level_gets_rows_by_weight(spark):
    total = 20_000
    counts = Counter(r.s for r in spark.range(total).select(
        sharding.shard_of(F.col("id"), UNEVEN).alias("s")).collect())
    for level in range(3):
        for node in {leaf[level] for leaf in UNEVEN}:
            own = [leaf for leaf in UNEVEN if leaf[level] == node]
            share = sum(leaf[3] for leaf in own) / sum(leaf[3] for leaf in UNEVEN)
            got = sum(counts[leaf[2]] for leaf in own)
            assert abs(got - share * total) <= 5 * math.sqrt(share * total), (level, node)


def test_weight_moves_rows_into_its_subtree_only(spark):
    ids = spark.range(6000)
    tree = sharding.even_tree(8)
    place = {s: (r, k, s) for r, k, s, _ in tree}
    heavy = [(r, k, s, 3.0 if s == 5 else w) for r, k, s, w in tree]
    empty = [(r, k, s, 0.0 if s == 5 else w) for r, k, s, w in tree]
    rows = ids.select(*[sharding.shard_of(F.col("id"), t).alias(n)
                        for n, t in (("a", tree), ("b", heavy), ("c", empty))]).collect()
    # Shard 5 lies in region 1, rack 2: at the first level where a row moves, it moves into
    # the node above 5 (heavier) or out of it (empty).
    for r in rows:
        for after, into in ((r.b, True), (r.c, False)):
            if after != r.a:
                level = next(i for i in range(3) if place[r.a][i] != place[after][i])
                end = place[after if into else r.a]
                assert end[level] == place[5][level] and end[:level] == place[5][:level]
    assert all(r.c != 5 for r in rows)
    counts = Counter(r.b for r in rows)
    assert abs(counts[5] - 1800) < 150 and abs(counts[0] - 600) < 110


def test_every_added_shard_takes_rows_only_into_itself(spark):
    for start in (1, 2, 3, 8, 11):
        trees = [sharding.even_tree(start)]
        for _ in range(3):
            trees.append(sharding.grown(trees[-1]))
        rows = spark.range(1500).select(*[
            sharding.shard_of(F.col("id"), t).alias(f"n{n}") for n, t in enumerate(trees)]).collect()
        for n in range(3):
            assert all(r[f"n{n + 1}"] in (r[f"n{n}"], start + n) for r in rows)
            assert any(r[f"n{n + 1}"] == start + n for r in rows)


def test_no_documents(documents):
    assert sharding.assign(documents().limit(0)).count() == 0
