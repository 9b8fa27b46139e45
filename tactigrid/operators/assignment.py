"""Optimal one-to-one assignment: shortest augmenting paths with potentials, in numpy."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost that use as many rows and columns as there can be."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    price_row, price_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach, via, settled = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, base = start, -1, 0.0
        while True:
            trial = base + c[row] - price_row[row] - price_col
            better = ~settled & (trial < reach)
            reach[better], via[better] = trial[better], column
            column = int(np.where(settled, np.inf, reach).argmin())
            base = reach[column]
            settled[column] = True
            if owner[column] < 0:
                break
            row = int(owner[column])
        inside = settled & (np.arange(m) != column)
        for j in np.flatnonzero(inside):
            price_row[owner[j]] += base - reach[j]
        price_row[start] += base
        price_col[inside] -= base - reach[inside]
        while column >= 0:
            before = int(via[column])
            owner[column] = owner[before] if before >= 0 else start
            column = before
    pairs = [(int(i), int(j)) for j, i in enumerate(owner) if i >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)
