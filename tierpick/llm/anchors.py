"""Metric trees by the anchors hierarchy, and the nearest-entry search through them.

A tree is built from the middle: about sqrt(n) anchors, each owning the points
nearest to it, are found first. Every anchor's points become a subtree in the
same way, and the anchors are joined upwards, always the two whose common ball
is smallest. Each ball keeps the number and the sum of its points.
"""

from dataclasses import dataclass

import numpy as np

LEAF_POINTS = 96


@dataclass
class Tree:
    """Balls as arrays; ball b holds the points order[lo[b]:hi[b]], leaves have left -1."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def owners(points: np.ndarray, k: int) -> np.ndarray:
    """The number of each point's anchor, for at most k anchors; fewer if points coincide.

    The point farthest from its anchor becomes the next anchor. It can only take
    points that are farther from their anchor than half the way between the two.
    """
    owner = np.zeros(len(points), dtype=np.int64)
    anchors = [points[0]]
    distance = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(anchors) < k:
        new = int(distance.argmax())
        if distance[new] == 0:
            break
        between = np.sqrt(((np.array(anchors) - points[new]) ** 2).sum(1))
        may = np.flatnonzero(distance > between[owner] / 2)
        nearer = np.sqrt(((points[may] - points[new]) ** 2).sum(1))
        take = nearer < distance[may]
        taken = may[take]
        owner[taken] = len(anchors)
        distance[taken] = nearer[take]
        anchors.append(points[new])
    return owner


class _Builder:
    def __init__(self, points: np.ndarray):
        self.points = points
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaf: list[np.ndarray | None] = []

    def _add(self, left: int, right: int, leaf: np.ndarray | None) -> int:
        self.left.append(left)
        self.right.append(right)
        self.leaf.append(leaf)
        return len(self.left) - 1

    def grow(self, at: np.ndarray):
        """Ball of the points ``at``: (number, center, radius, count)."""
        mine = self.points[at]
        center = mine.mean(0)
        if len(at) > LEAF_POINTS:
            owner = owners(mine, int(np.ceil(np.sqrt(len(at)))))
            many = int(owner.max()) + 1
            if many > 1:
                return self._joined([self.grow(at[owner == a]) for a in range(many)
                                     if (owner == a).any()])
        radius = float(np.sqrt(((mine - center) ** 2).sum(1).max()))
        return self._add(-1, -1, at), center, radius, len(at)

    def _joined(self, balls: list):
        """Join the two balls with the smallest common ball until one is left."""
        number = [b[0] for b in balls]
        center = np.array([b[1] for b in balls])
        radius = np.array([b[2] for b in balls])
        size = np.array([b[3] for b in balls], dtype=float)
        k = len(balls)

        def common(i):
            apart = np.sqrt(((center - center[i]) ** 2).sum(1))
            total = size + size[i]
            return np.maximum(apart * size / total + radius[i], apart * size[i] / total + radius)

        cost = np.array([common(i) for i in range(k)])
        np.fill_diagonal(cost, np.inf)
        for _ in range(k - 1):
            i, j = divmod(int(cost.argmin()), k)
            radius[i] = cost[i, j]
            center[i] = (center[i] * size[i] + center[j] * size[j]) / (size[i] + size[j])
            size[i] += size[j]
            number[i] = self._add(number[i], number[j], None)
            gone = np.isinf(cost[i])
            gone[i] = False
            cost[j] = cost[:, j] = np.inf
            fresh = common(i)
            fresh[gone] = fresh[i] = fresh[j] = np.inf
            cost[i] = cost[:, i] = fresh
        return number[i], center[i], float(radius[i]), int(size[i])


def build(points: np.ndarray) -> Tree:
    """Tree over integer points (rows)."""
    builder = _Builder(points.astype(np.float64))
    root = builder.grow(np.arange(len(points)))[0]
    old = [root]  # balls in the order in which they are written, parents first
    for b in old:
        if builder.left[b] >= 0:
            old += (builder.left[b], builder.right[b])
    place = {b: i for i, b in enumerate(old)}
    n = len(old)
    left, right = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    lo, hi = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    order, stack = [], [(0, False)]
    at = 0
    while stack:
        b, closed = stack.pop()
        if closed:
            hi[b] = at
            continue
        lo[b] = at
        leaf = builder.leaf[old[b]]
        if leaf is not None:
            order.append(leaf)
            at += len(leaf)
            hi[b] = at
        else:
            left[b], right[b] = place[builder.left[old[b]]], place[builder.right[old[b]]]
            stack += [(b, True), (int(right[b]), False), (int(left[b]), False)]
    order = np.concatenate(order)
    sorted_points = points[order]
    before = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
    np.cumsum(sorted_points, axis=0, out=before[1:])
    sums = before[hi] - before[lo]
    center = sums / (hi - lo)[:, None]
    radius = np.array([
        ((sorted_points[a:b] - c) ** 2).sum(1).max() for a, b, c in zip(lo, hi, center)])
    # Rounded up, so that every point surely lies in its ball.
    radius = np.sqrt(radius) * (1 + 1e-9) + 1e-6
    return Tree(order.astype(np.int32), lo, hi, left, right, center, radius, sums)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places lo[i] .. hi[i] - 1 and the i of each."""
    counts = hi - lo
    which = np.repeat(np.arange(len(lo)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - lo, counts), which


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray):
    """Nearest entry of all points; ties go to the lower entry.

    ``points`` are in the tree's order. Gives balls that one entry owns (balls,
    entries), and the places of the other points with their entries. A ball
    inherits the entries its parent could not rule out. Entry e goes if for all
    points of the ball entry b is nearer: |c-e|^2 - |c-b|^2 > 2 r |e-b|, with a
    margin that covers rounding. Distances of single points are exact integers.
    """
    k = len(entries)
    alive = np.ones((1, k), dtype=bool)
    for e in range(1, k):  # the same entry again never wins a tie
        alive[0, e] = not (entries[:e] == entries[e]).all(1).any()
    exact = entries.astype(np.float64)
    apart = np.sqrt(((exact[:, None] - exact[None]) ** 2).sum(2))
    balls = np.zeros(1, dtype=np.int64)
    owned, owner, places, chosen = [], [], [], []
    while len(balls):
        squared = ((tree.center[balls][:, None] - exact[None]) ** 2).sum(2)
        best = np.where(alive, squared, np.inf).argmin(1)
        least = squared[np.arange(len(balls)), best][:, None]
        lost = squared - least - 1e-9 * (squared + least) - 1 > (
            2 * tree.radius[balls][:, None] * apart[best])
        alive &= ~lost
        one = alive.sum(1) == 1
        owned.append(balls[one])
        owner.append(best[one])
        leaf = ~one & (tree.left[balls] < 0)
        if leaf.any():
            at, which = _spread(tree.lo[balls[leaf]], tree.hi[balls[leaf]])
            near = np.full(len(at), np.iinfo(np.int64).max)
            mine = np.zeros(len(at), dtype=np.int64)
            for e in range(k):
                open_ = np.flatnonzero(alive[leaf, e][which])
                d = ((points[at[open_]] - entries[e]) ** 2).sum(1)
                better = d < near[open_]
                near[open_[better]] = d[better]
                mine[open_[better]] = e
            places.append(at)
            chosen.append(mine)
        down = ~one & ~leaf
        balls, alive = (np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]),
                        np.concatenate([alive[down], alive[down]]))
    none = [np.zeros(0, dtype=np.int64)]
    return tuple(np.concatenate(x or none) for x in (owned, owner, places, chosen))


def totals(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points of each entry; owned balls add their cached ones."""
    owned, owner, places, chosen = assign(tree, points, entries)
    counts = np.zeros(len(entries), dtype=np.int64)
    sums = np.zeros(entries.shape, dtype=np.int64)
    np.add.at(counts, owner, (tree.hi - tree.lo)[owned].astype(np.int64))
    np.add.at(sums, owner, tree.sums[owned])
    np.add.at(counts, chosen, 1)
    np.add.at(sums, chosen, points[places])
    return counts, sums


def nearest(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each point, in the tree's order."""
    owned, owner, places, chosen = assign(tree, points, entries)
    out = np.zeros(len(points), dtype=np.int64)
    at, which = _spread(tree.lo[owned], tree.hi[owned])
    out[at] = owner[which]
    out[places] = chosen
    return out
