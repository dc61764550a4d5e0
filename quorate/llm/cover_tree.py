"""Cover trees over integer vectors, searched for the best inner products in windows.

Vectors get one more component that gives all of a tree the same norm, so that a large
inner product with a query is a small distance. Each level halves the covering radius;
a node keeps the largest distance from its centre to anything below it, which bounds
the inner products of everything below it from both sides. A tree is a dict of arrays,
so tasks can store it and hand it on.
"""

from __future__ import annotations

from collections import deque

import numpy as np

# Nodes of so few points are not split further.
LEAF = 8
# Pairs of query and node taken from the frontier at a time, best bounds first.
SLICE = 4096
EXACT = float(1 << 53)
NONE_YET = -(1 << 62)
NO_ID = (1 << 63) - 1


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree of at least one vector; ``vectors`` are 32-bit integers."""
    x = vectors.astype(np.float64)
    norms = np.einsum("ij,ij->i", x, x)
    top = norms.max()
    lifted = np.column_stack([x, np.sqrt(top - norms)])

    def distance(members: np.ndarray, centre: int) -> np.ndarray:
        apart = lifted[members] - lifted[centre]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    centre, radius, first, last, inner = [], [], [], [], []
    order: list[np.ndarray] = []
    placed = nodes = 1
    placed = 0
    every = np.arange(len(ids))
    todo = deque([(every, 0, distance(every, 0))])
    while todo:
        members, middle, away = todo.popleft()
        reach = float(away.max())
        centre.append(middle)
        radius.append(reach)
        if reach == 0 or len(members) <= LEAF:
            inner.append(False)
            first.append(placed)
            placed += len(members)
            last.append(placed)
            order.append(members)
            continue
        nearest, owner, centres = away.copy(), np.zeros(len(members), np.int64), [middle]
        while nearest.max() > reach / 2:
            fresh = int(members[nearest.argmax()])
            to_fresh = distance(members, fresh)
            closer = to_fresh < nearest
            nearest = np.where(closer, to_fresh, nearest)
            owner[closer] = len(centres)
            centres.append(fresh)
        inner.append(True)
        first.append(nodes)
        nodes += len(centres)
        last.append(nodes)
        by_owner = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
        for at, part in zip(centres, np.split(by_owner, ends[:-1]), strict=True):
            todo.append((members[part], at, nearest[part]))
    return {
        "ids": ids, "labels": labels, "vectors": vectors.astype(np.int32), "top": np.array(top),
        "centre": np.array(centre), "radius": np.array(radius), "first": np.array(first),
        "last": np.array(last), "inner": np.array(inner), "points": np.concatenate(order),
    }


class Queries:
    """Queries with score windows, and the best ``k`` points of each window so far.

    ``low`` and ``high`` (one row a query, one column a window) bound scores, both ends
    included. With ``same_label`` only points of the query's label count, without it only
    points of other labels. A point with the query's own id and label never counts.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray,
                 low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> None:
        self.ids, self.labels, self.same_label = ids, labels, same_label
        self.vectors = vectors.astype(np.int64)
        self.low, self.high, self.k = low, high, k
        self.norm = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.scores = np.full((*low.shape, k), NONE_YET, np.int64)
        self.found = np.full((*low.shape, k), NO_ID, np.int64)
        self.verified = 0

    def _products(self, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        if self.norm[queries].max() * np.sqrt((points.astype(np.float64) ** 2).sum(1).max()) < EXACT:
            return (self.vectors[queries].astype(np.float64) @ points.T.astype(np.float64)).astype(
                np.int64)
        return self.vectors[queries] @ points.T.astype(np.int64)

    def _alive(self, queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs may still hold a point some window wants."""
        wanted = np.maximum(self.low[queries], self.scores[queries, :, -1])
        return ((most[:, None] >= wanted) & (least[:, None] <= self.high[queries])).any(axis=1)

    def _bounds(self, queries: np.ndarray, scores: np.ndarray, radius: np.ndarray,
                top: float) -> tuple[np.ndarray, np.ndarray]:
        """The inner products possible within ``radius`` of a centre of this score."""
        whole = self.norm[queries] ** 2 + top
        apart = np.sqrt(np.maximum(whole - 2.0 * scores, 0))
        slack = 1.0 + 1e-9 * whole
        return ((whole - (apart + radius) ** 2) / 2 - slack,
                (whole - np.maximum(apart - radius, 0) ** 2) / 2 + slack)

    def _offer(self, tree: dict[str, np.ndarray], queries: np.ndarray, points: np.ndarray,
               scores: np.ndarray) -> None:
        """Take exact scores (query x point) into the windows they belong to."""
        self.verified += scores.size
        alike = self.labels[queries][:, None] == tree["labels"][points]
        own = alike & (self.ids[queries][:, None] == tree["ids"][points])
        usable = (alike if self.same_label else ~alike) & ~own
        for window in range(self.low.shape[1]):
            least = np.maximum(self.low[queries, window], self.scores[queries, window, -1])
            row, column = np.nonzero(
                usable & (scores >= least[:, None])
                & (scores <= self.high[queries, window][:, None])
            )
            if not len(row):
                continue
            some = np.unique(row)
            q = np.concatenate([queries[row], np.repeat(queries[some], self.k)])
            score = np.concatenate([scores[row, column],
                                    self.scores[queries[some], window].ravel()])
            name = np.concatenate([tree["ids"][points[column]],
                                   self.found[queries[some], window].ravel()])
            order = np.lexsort((name, -score, q))
            q = q[order]
            begin = np.r_[True, q[1:] != q[:-1]]
            rank = np.arange(len(q)) - np.maximum.accumulate(
                np.where(begin, np.arange(len(q)), 0))
            kept = rank < self.k
            at = q[kept], np.full(kept.sum(), window), rank[kept]
            self.scores[at], self.found[at] = score[order][kept], name[order][kept]

    def search(self, tree: dict[str, np.ndarray]) -> None:
        """Best-first descent of one tree by all queries."""
        top = float(tree["top"])
        every = np.arange(len(self.ids))
        root = self._products(every, tree["vectors"][tree["centre"][:1]])[:, 0]
        least, most = self._bounds(every, root, tree["radius"][0], top)
        front = [every, np.zeros(len(every), np.int64), least, most]
        while len(front[0]):
            alive = self._alive(front[0], front[2], front[3])
            front = [part[alive] for part in front]
            order = np.argsort(-front[3], kind="stable")
            taken, rest = order[:SLICE], order[SLICE:]
            grown = [[part[rest]] for part in front]
            queries, nodes = front[0][taken], front[1][taken]
            for node in np.unique(nodes).tolist():
                fresh = self._expanded(tree, queries[nodes == node], node, top)
                for parts, part in zip(grown, fresh, strict=True):
                    parts.append(part)
            front = [np.concatenate(parts) for parts in grown]

    def _expanded(self, tree: dict[str, np.ndarray], queries: np.ndarray, node: int,
                  top: float) -> tuple[np.ndarray, ...]:
        """Verify the points of a leaf, or bound the children of an inner node."""
        low, high = tree["first"][node], tree["last"][node]
        if not tree["inner"][node]:
            points = tree["points"][low:high]
            self._offer(tree, queries, points, self._products(queries, tree["vectors"][points]))
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2
        scores = self._products(queries, tree["vectors"][tree["centre"][low:high]])
        radius = tree["radius"][low:high]
        # All points of a child without extent have the score of its centre.
        single = np.flatnonzero((radius == 0) & ~tree["inner"][low:high])
        if len(single):
            begin, end = tree["first"][low + single], tree["last"][low + single]
            column = np.repeat(single, end - begin)
            within = np.arange(len(column)) - np.repeat(np.cumsum(end - begin) - (end - begin),
                                                        end - begin)
            points = tree["points"][np.repeat(begin, end - begin) + within]
            self._offer(tree, queries, points, scores[:, column])
        wide = np.flatnonzero(radius > 0)
        q = np.repeat(queries, len(wide))
        child = np.tile(low + wide, len(queries))
        least, most = self._bounds(q, scores[:, wide].ravel(), np.tile(radius[wide], len(queries)),
                                   top)
        alive = self._alive(q, least, most)
        return q[alive], child[alive], least[alive], most[alive]
