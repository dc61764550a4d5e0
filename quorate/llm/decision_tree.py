"""A small decision tree: fitted on the driver on a table of some hundred rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np


def _impurity(ones: np.ndarray, size: np.ndarray) -> np.ndarray:
    share = ones / size
    return size * 2 * share * (1 - share)


@dataclass
class Tree:
    """Splits as nested tuples (column, bound, below, above); leaves are True or False."""

    root: Any

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
        """Grow by the split that leaves the least Gini impurity, until pure or ``depth``.

        Ties go to the first column and the lowest bound; a tied leaf is True.
        """
        def grown(rows: np.ndarray, left: int) -> Any:
            label = y[rows]
            if left == 0 or label.all() or not label.any():
                return bool(2 * label.sum() >= len(label))
            best = None
            for column in range(x.shape[1]):
                order = rows[np.argsort(x[rows, column], kind="stable")]
                value, ones = x[order, column], np.cumsum(y[order])
                cut = np.flatnonzero(value[1:] > value[:-1]) + 1
                if not len(cut):
                    continue
                loss = _impurity(ones[cut - 1], cut) + _impurity(
                    ones[-1] - ones[cut - 1], len(order) - cut)
                k = int(loss.argmin())
                if best is None or loss[k] < best[0] - 1e-9:
                    bound = float(value[cut[k] - 1] + value[cut[k]]) / 2
                    best = float(loss[k]), column, bound
            if best is None:
                return bool(2 * label.sum() >= len(label))
            _, column, bound = best
            below = x[rows, column] <= bound
            return column, bound, grown(rows[below], left - 1), grown(rows[~below], left - 1)

        return cls(grown(np.arange(len(y)), depth))

    def __call__(self, row: list[float]) -> bool:
        node = self.root
        while node is not True and node is not False:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node
