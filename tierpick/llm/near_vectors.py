"""Near copies among embeddings: small-world graphs per shard, all shards queried.

Vectors are dealt to shards by a hash of their row. A shard's graph (``hnsw``)
has one node per cell: vectors within half the threshold's angle of a node link
with each other, so a group of copies costs one node and none of its pairs is
ever listed. Every pair of shards meets in a task of its own: the cells of one
are looked up in the graph of the other, the beam of a query doubles while all
of it is within reach, and all beams double while an audit against a full scan
misses links. Cells that surely link or surely don't are decided by angles, all
others by cosines of their members in double precision. A task sends the number
of links per vector and a spanning forest of its cells.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.llm import hnsw
from tierpick.llm.components import components
from tierpick.session import stage

THRESHOLD = 0.95
#: Vectors per shard: about 32 times the root of their number, between these.
SHARD_ROWS = (4096, 131072)
BEAM = 24
AUDITED = 64         # queries per pair of shards that are checked by a full scan
AUDIT_RECALL = 0.999

_MARGIN = 1e-7       # radians that rounding may not cover
_SINGLE = 1e-5       # error of a similarity in single precision
_CELLS = 1 << 22     # cosines held at once


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    vectors = vectors.astype(np.float64)
    with np.errstate(over="ignore"):
        size = np.sqrt((vectors ** 2).sum(1, keepdims=True))
    odd = ~np.isfinite(size[:, 0]) | (size[:, 0] < 1e-140)  # squares too large or too small
    if odd.any():
        vectors[odd] /= np.abs(vectors[odd]).max(1, keepdims=True)
        size[odd] = np.sqrt((vectors[odd] ** 2).sum(1, keepdims=True))
    return vectors / size


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class Shard:
    """Vectors in order of their cells, the node of a cell first."""

    def __init__(self, vectors: np.ndarray, cells: np.ndarray):
        self.unit = unit(vectors)
        self.start, self.size = cells[:-1], np.diff(cells)
        self.cell = np.repeat(np.arange(len(self.size)), self.size)
        self.nodes = self.unit[self.start]
        angle = _angle((self.unit * self.nodes[self.cell]).sum(1))
        angle[self.start] = 0
        self.radius = np.maximum.reduceat(angle, self.start)

    def members(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all members of the cells, and where each cell begins among them."""
        size = self.size[cells]
        begin = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.start[cells] - begin, size), begin


def within(graph: hnsw.Graph, queries: np.ndarray, cut: np.ndarray, beam: int):
    """Pairs (query, node) with a similarity of at least the query's cut.

    A beam all of whose nodes are within reach may have missed some and is
    doubled; beams near the size of the graph give way to a full scan.
    """
    found, todo = [], np.arange(len(queries))
    nodes = len(graph.vectors)
    while len(todo) and 4 * beam < nodes:
        ids, sims = graph.search(queries[todo], beam)
        done = sims[:, -1] < cut[todo]
        row, column = np.nonzero((sims >= cut[todo][:, None]) & (ids >= 0) & done[:, None])
        found.append((todo[row], ids[row, column]))
        todo = todo[~done]
        beam *= 2
    step = max(1, _CELLS // nodes)
    for first in range(0, len(todo), step):
        part = todo[first:first + step]
        row, node = np.nonzero(queries[part] @ graph.vectors.T >= cut[part][:, None])
        found.append((part[row], node))
    return tuple(np.concatenate([np.asarray(f[k], dtype=np.int64) for f in found] or [
        np.zeros(0, dtype=np.int64)]) for k in (0, 1))


def audited(graph: hnsw.Graph, queries: np.ndarray, cut: np.ndarray, own: bool):
    """``within`` with beams as wide as an audit asks for.

    Half of the audited queries are those with the most pairs found, the others
    are spread over all. A shard's own cells must find themselves as well.
    """
    beam = BEAM
    while True:
        query, node = within(graph, queries, cut, beam)
        if 4 * beam >= len(graph.vectors):
            return query, node
        many = np.bincount(query, minlength=len(queries))
        checked = np.unique(np.concatenate([
            np.argsort(-many, kind="stable")[:AUDITED // 2],
            np.linspace(0, len(queries) - 1, AUDITED // 2).astype(np.int64)]))
        true = (queries[checked] @ graph.vectors.T >= cut[checked][:, None]).sum()
        passed = many[checked].sum() >= AUDIT_RECALL * true
        if own:
            passed &= (query == node).sum() >= AUDIT_RECALL * len(queries)
        if passed:
            return query, node
        beam *= 2


def linked_cells(a: Shard, b: Shard, graph: hnsw.Graph, threshold: float, own: bool):
    """Links between two shards (or inside one): links per vector of each, pairs of linked cells."""
    reach = math.acos(threshold)
    cut = np.cos(np.minimum(np.pi, reach + a.radius + b.radius.max() + _MARGIN)) - _SINGLE
    x, y = audited(graph, a.nodes.astype(np.float32), cut.astype(np.float32), own)
    if own:
        x, y = np.minimum(x, y), np.maximum(x, y)
        pairs = np.unique(np.stack([x[x < y], y[x < y]]), axis=1)
        x, y = pairs
    links_a = np.zeros(len(a.unit), dtype=np.int64)
    links_b = links_a if own else np.zeros(len(b.unit), dtype=np.int64)
    if own:
        links_a += (a.size - 1)[a.cell]  # a cell's members all link
    cosine = np.concatenate([np.zeros(0)] + [
        (a.nodes[x[i:i + 65536]] * b.nodes[y[i:i + 65536]]).sum(1)
        for i in range(0, len(x), 65536)])
    angle, wide = _angle(cosine), a.radius[x] + b.radius[y]
    single = (a.size[x] == 1) & (b.size[y] == 1)
    whole = np.where(single, cosine >= threshold, angle + wide <= reach - _MARGIN)
    open_ = ~whole & ~single & (angle - wide <= reach + _MARGIN)
    linked = whole.copy()
    by_a, by_b = np.zeros(len(a.size), dtype=np.int64), np.zeros(len(b.size), dtype=np.int64)
    np.add.at(by_a, x[whole], b.size[y[whole]])
    np.add.at(by_b, y[whole], a.size[x[whole]])
    links_a += by_a[a.cell]
    links_b += by_b[b.cell]
    at = np.flatnonzero(open_)
    at = at[np.argsort(x[at], kind="stable")]
    for mine in np.split(at, np.flatnonzero(np.diff(x[at])) + 1) if len(at) else []:
        left, _ = a.members(x[mine[:1]])
        right, begin = b.members(y[mine])
        hit = np.zeros(len(right), dtype=bool)
        step = max(1, _CELLS // len(left))
        for first in range(0, len(right), step):
            part = right[first:first + step]
            close = a.unit[left] @ b.unit[part].T >= threshold
            links_a[left] += close.sum(1)
            links_b[part] += close.sum(0)  # places don't repeat: cells are distinct
            hit[first:first + step] = close.any(0)
        linked[mine] = np.logical_or.reduceat(hit, begin)
    return links_a, links_b, x[linked], y[linked]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each of n cells the least one that it reaches by the pairs (x, y)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[x], least[y])
        if (low == least[x]).all() and (low == least[y]).all():
            return least
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        least = least[least]


_SHARD = (
    "shard int, rows array<long>, ids array<long>, vectors array<{kind}>, cells array<int>, "
    "head_rows array<long>, head_ids array<long>, layers array<int>, links array<int>"
)


def _heads(rows: np.ndarray, ids: np.ndarray, null: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The member that names each cell: the least id, null ids last, then the least row."""
    cell = np.repeat(np.arange(len(cells) - 1), np.diff(cells))
    return np.lexsort((rows, ids, null, cell))[cells[:-1]]


def _levels(rows: np.ndarray, top: float) -> np.ndarray:
    """Levels of nodes, drawn by their rows: each level has 1 / NEIGHBOURS of the one below."""
    h = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    drawn = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    return np.minimum(np.floor(-np.log(drawn) / math.log(hnsw.NEIGHBOURS)), top).astype(np.int64)


def _build(table: pa.Table, threshold: float) -> pa.RecordBatch:
    rows = table.column("row").to_numpy()
    order = np.argsort(rows)  # a task that is run again gives the same graph
    table, rows = table.take(pa.array(order)), rows[order]
    values = table.column("vector").combine_chunks().flatten()
    vectors = values.to_numpy().reshape(len(rows), -1)
    ids = table.column("id").combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    plain = ids.fill_null(0).to_numpy()
    graph, node_row, row_node = hnsw.build(
        unit(vectors), _levels(rows, math.log(len(rows) + 1, hnsw.NEIGHBOURS)),
        math.cos(0.49 * math.acos(threshold)))
    follows = np.ones(len(rows), dtype=bool)
    follows[node_row] = False
    order = np.lexsort((follows, row_node))
    cells = np.concatenate([[0], np.cumsum(np.bincount(row_node))])
    head = order[_heads(rows[order], plain[order], null[order], cells)]
    layers = np.array([len(layer) for layer in graph.layers])
    links = np.concatenate([layer.reshape(-1) for layer in graph.layers])

    def row(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays([
        pa.array([table.column("shard")[0].as_py()], pa.int32()), row(pa.array(rows[order])),
        row(ids.take(pa.array(order))), row(pa.array(vectors[order].reshape(-1))),
        row(pa.array(cells, pa.int32())), row(pa.array(rows[head])), row(ids.take(pa.array(head))),
        row(pa.array(layers, pa.int32())), row(pa.array(links, pa.int32())),
    ], names=["shard", "rows", "ids", "vectors", "cells", "head_rows", "head_ids", "layers",
              "links"])


def shards(rows: DataFrame, threshold: float, count: int) -> DataFrame:
    """One row per shard: its vectors by cell, and its graph."""
    def run(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            yield _build(pa.Table.from_batches(parts), threshold)

    kind = rows.schema["vector"].dataType.elementType.simpleString()
    # One shard per partition.
    return rows.repartitionById(count, F.col("shard")).mapInArrow(run, _SHARD.format(kind=kind))


def _written_shard(batch: pa.RecordBatch, i: int) -> dict:
    """A shard row with its columns as arrays; ids may hold nulls and stay Arrow arrays."""
    out = {name: batch.column(name)[i].values for name in (
        "rows", "vectors", "cells", "head_rows", "head_ids", "layers", "links")}
    return {name: values if name == "head_ids" else values.to_numpy()
            for name, values in out.items() if values is not None}


def _graph(shard: dict, nodes: np.ndarray) -> hnsw.Graph:
    layers, first = [], 0
    for level, n in enumerate(shard["layers"].tolist()):
        width = hnsw.NEIGHBOURS * (1 if level else 2)
        layers.append(shard["links"][first:first + n * width].reshape(n, width))
        first += n * width
    return hnsw.Graph(nodes.astype(np.float32), layers)


_FOUND = "row long, links long, u_row long, u_id long, v_row long, v_id long"


def _compare(left: dict, right: dict, threshold: float, own: bool):
    n = len(left["cells"]) - 1, len(right["cells"]) - 1
    a = Shard(left["vectors"].reshape(len(left["rows"]), -1), left["cells"])
    b = a if own else Shard(right["vectors"].reshape(len(right["rows"]), -1), right["cells"])
    links_a, links_b, x, y = linked_cells(a, b, _graph(right, b.nodes), threshold, own)
    rows, links = [left["rows"][links_a > 0]], [links_a[links_a > 0]]
    if own:
        least = forest(n[0], x, y)
        heads, head_ids = left["head_rows"], left["head_ids"]
    else:
        rows.append(right["rows"][links_b > 0])
        links.append(links_b[links_b > 0])
        least = forest(sum(n), x, n[0] + y)
        heads = np.concatenate([left["head_rows"], right["head_rows"]])
        head_ids = pa.concat_arrays([left["head_ids"], right["head_ids"]])
    u = np.flatnonzero(least != np.arange(len(least)))
    rows, links = np.concatenate(rows), np.concatenate(links)
    none = pa.nulls(len(rows), pa.int64()), pa.nulls(len(u), pa.int64())

    def column(counted, joined):
        return pa.concat_arrays([counted, joined])

    return pa.RecordBatch.from_arrays([
        column(pa.array(rows), none[1]), column(pa.array(links), none[1]),
        column(none[0], pa.array(heads[u])), column(none[0], head_ids.take(pa.array(u))),
        column(none[0], pa.array(heads[least[u]])),
        column(none[0], head_ids.take(pa.array(least[u])))],
        names=["row", "links", "u_row", "u_id", "v_row", "v_id"])


def _meetings(graphs: DataFrame, groups: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """Both shards of each pair (b <= s) side by side in one partition per pair."""
    pair, first = F.lit(None).cast("int"), 0
    b, s = F.col("b"), F.col("s")
    last = F.lit(None).cast("int")
    begin = F.lit(None).cast("int")
    for base, count in groups:
        inside = (F.col("shard") >= base) & (F.col("shard") < base + count)
        begin, last = (F.when(inside, F.lit(base)).otherwise(begin),
                       F.when(inside, F.lit(base + count - 1)).otherwise(last))
        place = F.lit(first) + F.floor((s - base) * (s - base + 1) / 2).cast("int") + (b - base)
        pair = F.when((b >= base) & (b < base + count), place).otherwise(pair)
        first += count * (count + 1) // 2
    asks = graphs.withColumn("s", F.explode(F.sequence(F.col("shard"), last))).withColumn(
        "b", F.col("shard")).where("b < s")
    asks = asks.withColumns({"layers": F.lit(None).cast("array<int>"),
                             "links": F.lit(None).cast("array<int>")})
    answers = graphs.withColumn("b", F.explode(F.sequence(begin, F.col("shard")))).withColumn(
        "s", F.col("shard"))
    columns = ["rows", "vectors", "cells", "head_rows", "head_ids", "layers", "links"]
    both = asks.select(pair.cast("int").alias("pair"), (b == s).alias("own"), *columns).unionByName(
        answers.select(pair.cast("int").alias("pair"), (b == s).alias("own"), *columns))
    return both, first


def links_of(graphs: DataFrame, groups: list[tuple[int, int]], threshold: float) -> DataFrame:
    """Links per row and pair of shards, and the forests of linked cells."""
    def run(batches):
        waiting: dict = {}
        for batch in batches:
            for i in range(len(batch)):
                pair, own = batch.column("pair")[i].as_py(), batch.column("own")[i].as_py()
                shard = _written_shard(batch, i)
                if own:
                    yield _compare(shard, shard, threshold, True)
                elif pair not in waiting:
                    waiting[pair] = shard
                else:
                    other = waiting.pop(pair)
                    asks, answers = (other, shard) if "links" in shard else (shard, other)
                    yield _compare(asks, answers, threshold, False)

    meetings, pairs = _meetings(graphs, groups)
    return meetings.repartitionById(pairs, F.col("pair")).mapInArrow(run, _FOUND)


def _node(row: str, key: str):
    """A cell by the member that names it; sorts by id, null ids last."""
    return F.struct(F.col(key).isNull().cast("int").alias("missing"),
                    F.coalesce(F.col(key), F.lit(0)).alias("id"), F.col(row).alias("row"))


def near_copies(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                threshold: float = THRESHOLD, shard_rows: int | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows with a cosine of at least ``threshold``
    (0 < threshold < 1), ``component_id`` is the smallest id reachable by links,
    ``kept`` marks the row with that id. Graphs give the candidates, so a link
    may be missed (tests ask for a recall of 0.999); none below the threshold is counted.

    Vectors that are null, empty or zero or hold null or non-finite components
    link with nothing; so do vectors of different lengths. Repeated rows are
    rows of their own and link with each other. Ids are integers; a null id is
    never the name of a component that has another id, and is not kept. No rows
    give no rows; further columns are ignored.
    """
    v = F.col(vector)
    rows = stage(vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("vector"),
                                F.monotonically_increasing_id().alias("row")), "vectors")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < np.inf))
    usable = rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    lengths = usable.groupBy(F.size("vector").alias("length")).count().orderBy("length").collect()
    groups, shard, first = [], F.lit(None).cast("int"), 0
    for length, n in lengths:  # vectors of one length are compared with each other
        size = shard_rows or min(max(SHARD_ROWS[0], int(32 * math.sqrt(n))), SHARD_ROWS[1])
        count = -(-n // size)
        groups.append((first, count))
        mine = F.lit(first) + F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
        shard = F.when(F.size("vector") == length, mine).otherwise(shard)
        first += count
    own = rows.select("row", "id")
    if not groups:
        return own.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                          F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    graphs = stage(shards(usable.withColumn("shard", shard), threshold, first), "graphs")
    found = stage(links_of(graphs, groups, threshold), "links")
    counts = found.where("row IS NOT NULL").groupBy("row").agg(F.sum("links").alias("n_links"))
    joined = components(found.where("u_row IS NOT NULL").select(
        _node("u_row", "u_id").alias("u"), _node("v_row", "v_id").alias("v")))
    sizes = F.transform(F.sequence(F.lit(1), F.size("cells") - 1), lambda i: F.struct(
        F.element_at("head_rows", i).alias("head_row"), F.element_at("head_ids", i).alias("head_id"),
        F.slice("rows", F.element_at("cells", i) + 1,
                F.element_at("cells", i + 1) - F.element_at("cells", i)).alias("rows")))
    cells = graphs.select(F.explode(sizes).alias("c")).select(
        F.explode("c.rows").alias("row"), F.col("c.head_row"), F.col("c.head_id"))
    cells = cells.select("row", _node("head_row", "head_id").alias("node"))
    named = cells.join(joined, "node", "left").select(
        "row", F.coalesce("component", "node").alias("top"))
    out = own.join(counts, "row", "left").join(named, "row", "left")
    component = F.when(F.col("top").isNull(), F.col("id")).when(
        F.col("top.missing") == 0, F.col("top.id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
