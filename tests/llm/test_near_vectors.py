import math

import numpy as np
import pytest

from tierpick.llm import hnsw, near_vectors


def brute_force(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of all rows, comparing all pairs."""
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [near_vectors.unit(np.array([v]))[0] if usable(v) else None for _, v in rows]
    near = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None
             and len(a) == len(b) and a @ b >= threshold] for i, a in enumerate(units)]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near[i]), least, key is not None and key == least))
    return out


def copies(rng, center, n, noise):
    return [(center + rng.normal(0, noise, len(center))).tolist() for _ in range(n)]


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS row", "2 AS shard", "'x' AS node", "3 AS n_links", "'k' AS u").repartition(3)
    got = near_vectors.near_copies(frame, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_force(rows), key=str)


@pytest.mark.parametrize("shard_rows", [None, 100])
def test_query_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (200, 24)).tolist()
    vectors += copies(rng, rng.normal(0, 1, 24), 120, 0.05)     # one close group
    vectors += copies(rng, rng.normal(0, 1, 24), 60, 0.2)       # about as far apart as the threshold
    chain = rng.normal(0, 1, (2, 24))
    vectors += [(math.cos(t) * chain[0] + math.sin(t) * chain[1]).tolist()
                for t in np.arange(0, 1.5, 0.15)]               # links in a chain
    vectors += [vectors[0]] * 50                                # repeated rows
    order = rng.permutation(len(vectors))
    rows = [(int(k), vectors[k]) for k in order]
    rows += [(None, vectors[250]), (None, vectors[251]), (7, vectors[260]), (7, vectors[260]),
             (900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23),
             (904, [math.nan] * 24), (905, [math.inf] + [0.0] * 23), (906, [1.0] * 8),
             (907, [2.0] * 8), (908, [1e-200] * 8), (909, [1e300] * 8)]
    check(spark, rows, shard_rows=shard_rows)


def test_small_tables(spark):
    check(spark, [])
    check(spark, [(3, None)])
    check(spark, [(3, [1.0, 0.0])])
    check(spark, [(None, [1.0, 0.0]), (None, [1.0, 0.1])])


def test_components_of_ids_of_the_graphs_are_the_least(spark):
    rng = np.random.default_rng(6)
    group = copies(rng, rng.normal(0, 1, 16), 90, 0.02)
    rows = [(1000 - k, v) for k, v in enumerate(group)]
    got = near_vectors.near_copies(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=30)
    assert {(r["n_links"], r["component_id"]) for r in got.collect()} == {(89, 911)}


def clustered(rng, n=3000):
    centers = rng.normal(0, 1, (10, 32))
    vectors = centers[rng.integers(0, 10, n)] + rng.normal(0, 0.8, (n, 32))
    vectors[n - 400:] = vectors[0] + rng.normal(0, 0.1, (400, 32))
    return near_vectors.unit(vectors)


def test_recall_of_the_graph_search():
    vectors = clustered(np.random.default_rng(7)).astype(np.float32)
    graph, node_row, row_node = hnsw.build(
        vectors, near_vectors._levels(np.arange(len(vectors)), 3.0), 1.1)
    assert sorted(node_row.tolist()) == list(range(len(vectors))) and (row_node >= 0).all()
    placed = vectors[node_row]
    cut = np.full(len(placed), 0.95, dtype=np.float32)
    query, node = near_vectors.audited(graph, placed, cut, True)
    true = placed @ placed.T >= 0.95
    assert true[query, node].all()
    assert len(query) >= 0.999 * true.sum() and true.sum() > 100_000


def test_cells_lie_within_their_angle():
    vectors = clustered(np.random.default_rng(8))
    graph, node_row, row_node = hnsw.build(
        vectors, near_vectors._levels(np.arange(len(vectors)), 3.0), 0.98)
    assert (np.sum(vectors * vectors[node_row[row_node]], axis=1) >= 0.98 - 1e-5).all()
    assert [len(layer) for layer in graph.layers] == sorted(
        (len(layer) for layer in graph.layers), reverse=True)
    assert len(node_row) == len(graph.vectors) < len(vectors)
