"""A hierarchical navigable small-world graph over unit vectors, worked on in batches.

Nodes are numbered by falling level, so a level's nodes are the first ones.
Vectors that lie within a small angle of a node become members of its cell
instead of nodes; a group of copies is one node, however large it is.
Similarities are cosines in single precision; callers verify what they use.
"""

import numpy as np

NEIGHBOURS = 12      # per node on the upper levels, twice as many on the lowest
BUILD_BEAM = 48
BATCH = 512
_SEEN = 1 << 24      # pairs of query and node noted at once
_EXPAND = 4          # nodes of a beam expanded together
_NEWCOMERS = 32      # new neighbours considered per node and batch


class Graph:
    """``layers[l]`` holds the neighbours (-1: none) of the nodes of level l or higher."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors = vectors
        self.layers = layers

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the nodes of its beam and their similarities, most similar first."""
        ids = np.full((len(queries), beam), -1, dtype=np.int32)
        sims = np.full((len(queries), beam), -np.inf, dtype=np.float32)
        # A beam search notes the nodes it has seen per query.
        step = max(1, min(BATCH, _SEEN // max(1, len(self.vectors))))
        for first in range(0, len(queries), step):
            part = slice(first, first + step)
            entry = np.zeros((len(queries[part]), 1), dtype=np.int32)
            for level in range(len(self.layers) - 1, 0, -1):
                entry, _ = self._beam(level, queries[part], entry, 1)
            ids[part], sims[part] = self._beam(0, queries[part], entry, beam)
        return ids, sims

    def _beam(self, level: int, queries: np.ndarray, entry: np.ndarray, beam: int):
        """Beam search on one level; a beam ends when all its nodes are expanded."""
        links = self.layers[level]
        n, many = len(links), len(queries)
        seen = np.full(many * n, -1, dtype=np.int32)
        ids = np.full((many, beam), -1, dtype=np.int32)
        sims = np.full((many, beam), -np.inf, dtype=np.float32)
        done = np.zeros((many, beam), dtype=bool)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        rows, columns = np.nonzero(ids >= 0)
        sims[rows, columns] = np.einsum(
            "kd,kd->k", queries[rows], self.vectors[ids[rows, columns]])
        seen[rows * n + ids[rows, columns]] = 0
        active = np.arange(many)
        while len(active):
            open_ = (ids[active] >= 0) & ~done[active]
            going = open_.any(1)
            active, open_ = active[going], open_[going]
            if not len(active):
                break
            step = min(_EXPAND, beam)
            picked = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            real = np.take_along_axis(open_, picked, 1)
            done[active[:, None], picked] |= real
            near = links[ids[active[:, None], picked]]
            near[~real] = -1
            near = near.reshape(len(active), -1)
            r, c = np.nonzero(near >= 0)
            v = near[r, c]
            key = active[r] * n + v
            fresh = seen[key] < 0
            r, c, v, key = r[fresh], c[fresh], v[fresh], key[fresh]
            turn = np.arange(len(key), dtype=np.int32)
            seen[key] = turn  # of a node that is met twice the last one counts
            once = seen[key] == turn
            r, c, v = r[once], c[once], v[once]
            s = np.einsum("kd,kd->k", queries[active[r]], self.vectors[v])
            better = s > sims[active[r], -1]
            r, c, v, s = r[better], c[better], v[better], s[better]
            changed = np.unique(r)
            if not len(changed):
                continue
            row = np.searchsorted(changed, r)
            count = np.bincount(row)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            new_ids = np.full((len(changed), count.max()), -1, dtype=np.int32)
            new_sims = np.full(new_ids.shape, -np.inf, dtype=np.float32)
            new_ids[row, place], new_sims[row, place] = v, s
            a = active[changed]
            all_sims = np.concatenate([sims[a], new_sims], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[a] = np.take_along_axis(all_sims, order, 1)
            ids[a] = np.take_along_axis(np.concatenate([ids[a], new_ids], axis=1), order, 1)
            done[a] = np.take_along_axis(
                np.concatenate([done[a], np.zeros(new_ids.shape, dtype=bool)], axis=1), order, 1)
        return ids, sims


def _chosen(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates: those nearer to the row than to a chosen one.

    Candidates come most similar first; places left over go to the nearest others.
    """
    between = vectors[ids] @ vectors[ids].transpose(0, 2, 1)
    valid = ids >= 0
    kept = np.zeros(ids.shape, dtype=bool)
    for j in range(ids.shape[1]):
        hidden = (kept & (between[:, j] > sims[:, j, None])).any(1)
        kept[:, j] = valid[:, j] & ~hidden & (kept.sum(1) < most)
    order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(np.where(valid, ids, -1), order, 1)


def _linked_back(graph: Graph, level: int, node: np.ndarray, neighbour: np.ndarray):
    """Let the neighbours link back to new nodes, choosing anew where a list is full."""
    links = graph.layers[level]
    rows, columns = np.nonzero(neighbour >= 0)
    to, new = neighbour[rows, columns], node[rows]
    sims = np.einsum("kd,kd->k", graph.vectors[to], graph.vectors[new])
    order = np.lexsort((-sims, to))
    to, new, sims = to[order], new[order], sims[order]
    touched, count = np.unique(to, return_counts=True)
    place = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
    few = place < _NEWCOMERS
    row = np.repeat(np.arange(len(touched)), count)[few]
    for first in range(0, len(touched), BATCH):
        mine = (row >= first) & (row < first + BATCH)
        part = touched[first:first + BATCH]
        add = np.full((len(part), min(_NEWCOMERS, count.max())), -1, dtype=np.int32)
        add[row[mine] - first, place[few][mine]] = new[few][mine]
        ids = np.concatenate([links[part], add], axis=1)
        s = np.einsum("qd,qcd->qc", graph.vectors[part], graph.vectors[ids])
        s[ids < 0] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")
        links[part] = _chosen(graph.vectors, np.take_along_axis(ids, order, 1),
                              np.take_along_axis(s, order, 1), links.shape[1])


def build(vectors: np.ndarray, levels: np.ndarray, cell: float) -> tuple[Graph, np.ndarray, np.ndarray]:
    """Graph over unit vectors (rows): (graph, the row of each node, the node of each row).

    Rows go in by falling ``levels``, in batches. A batch finds its neighbours in
    the graph so far and among its own rows. A row whose similarity with a node
    is at least ``cell`` joins that node's cell.
    """
    n, dimension = vectors.shape
    vectors = vectors.astype(np.float32)
    order = np.argsort(-levels, kind="stable")
    placed = np.zeros((n, dimension), dtype=np.float32)
    top = int(levels.max())
    graph = Graph(placed[:0], [np.zeros((0, NEIGHBOURS * (2 if l == 0 else 1)), dtype=np.int32)
                               for l in range(top + 1)])
    node_row = np.zeros(n, dtype=np.int64)
    row_node = np.full(n, -1, dtype=np.int64)
    nodes = first = 0
    while first < n:
        level = int(levels[order[first]])
        last = min(n, first + max(64, min(BATCH, nodes)))
        while levels[order[last - 1]] != level:  # one level per batch
            last -= 1
        rows = order[first:last]
        first = last
        batch = vectors[rows]
        own = batch @ batch.T
        if nodes:
            ids, sims = graph.search(batch, BUILD_BEAM)
            joins = sims[:, 0] >= cell
            row_node[rows[joins]] = ids[joins, 0]
        else:
            joins = np.zeros(len(rows), dtype=bool)
        leads = ~joins
        close = np.triu(own >= cell, 1)
        member_of = np.full(len(rows), -1)
        for j in np.flatnonzero(leads & close.any(0)):
            earlier = np.flatnonzero(close[:, j] & leads & (np.arange(len(rows)) < j))
            if len(earlier):
                leads[j] = False
                member_of[j] = earlier[own[earlier, j].argmax()]
        lead = np.flatnonzero(leads)
        new = nodes + np.arange(len(lead))
        place = np.full(len(rows), -1, dtype=np.int64)
        place[lead] = new
        row_node[rows[lead]] = new
        late = member_of >= 0
        row_node[rows[late]] = place[member_of[late]]
        if not len(lead):
            continue
        node_row[new] = rows[lead]
        placed[new] = batch[lead]
        before, nodes = nodes, nodes + len(lead)
        graph.vectors = placed[:nodes]
        fellows = own[np.ix_(lead, lead)].copy()
        np.fill_diagonal(fellows, -np.inf)
        nearest = np.argsort(-fellows, axis=1)[:, :BUILD_BEAM // 2]
        fellow_ids = new[nearest].astype(np.int32)
        fellow_sims = np.take_along_axis(fellows, nearest, 1)
        fellow_ids[np.isinf(fellow_sims)] = -1
        entry = np.zeros((len(lead), 1), dtype=np.int32)
        for l in range(len(graph.layers) - 1, -1, -1):
            width = graph.layers[l].shape[1]
            if l > level:
                if before:
                    entry, _ = graph._beam(l, batch[lead], entry, 1)
                continue
            all_ids, all_sims = fellow_ids, fellow_sims
            if before:
                old_ids, old_sims = (ids[lead], sims[lead]) if l == 0 else graph._beam(
                    l, batch[lead], entry, BUILD_BEAM)
                entry = old_ids
                all_ids = np.concatenate([old_ids, fellow_ids], axis=1)
                all_sims = np.concatenate([old_sims, fellow_sims], axis=1)
            nearest = np.argsort(-all_sims, axis=1, kind="stable")
            chosen = _chosen(graph.vectors, np.take_along_axis(all_ids, nearest, 1),
                             np.take_along_axis(all_sims, nearest, 1), width)
            if chosen.shape[1] < width:
                chosen = np.pad(chosen, ((0, 0), (0, width - chosen.shape[1])), constant_values=-1)
            graph.layers[l] = np.concatenate([graph.layers[l], chosen.astype(np.int32)])
            _linked_back(graph, l, new, chosen)
    return graph, node_row[:nodes], row_node
