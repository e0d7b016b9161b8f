"""Least-cost assignment."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, one for each row or each column, whichever are fewer.

    Shortest augmenting paths with dual prices, O(n^2 m).
    """
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, length, last = start, 0.0, -1
        while row >= 0:
            through = length + c[row] - row_price[row] - col_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], last
            open_ = np.where(done, np.inf, reach)
            last = int(np.argmin(open_))
            length = reach[last]
            done[last] = True
            row = int(owner[last])
        row_price[start] += length
        for col in np.flatnonzero(done):
            if col != last:
                row_price[owner[col]] += length - reach[col]
            col_price[col] -= length - reach[col]
        while last >= 0:
            before = int(via[last])
            owner[last] = owner[before] if before >= 0 else start
            last = before
    pairs = [(int(owner[j]), int(j)) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


def assign_within(cost: np.ndarray, gate: float = 1e6) -> list[tuple[int, int]]:
    """The assignment without pairs that cost the gate or more."""
    cost = np.where(np.isfinite(cost), cost, gate)
    return [(i, j) for i, j in assign(cost) if cost[i, j] < gate]


def assign_many(cost: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The row of each column [b, m], -1 for none, as `assign` gives it, of many problems at once.

    Problem k is cost[k, :rows[k], :columns[k]] with no more rows than columns; what lies beyond is not read.
    """
    size, n, m = cost.shape
    cost = np.where((np.arange(m) < columns[:, None])[:, None], cost, np.inf)
    row_price, col_price, owner = np.zeros((size, n)), np.zeros((size, m)), np.full((size, m), -1)
    for start in range(n):
        at = np.flatnonzero(start < rows)
        c, price, reach, via, done = cost[at], col_price[at], np.full((len(at), m), np.inf), np.full((len(at), m), -1), np.zeros((len(at), m), bool)
        row, length, last = np.full(len(at), start), np.zeros(len(at)), np.full(len(at), -1)
        run = np.arange(len(at))
        while len(run):
            through = length[run, None] + c[run, row[run]] - row_price[at[run], row[run]][:, None] - price[run]
            better = ~done[run] & (through < reach[run])
            reach[run] = np.where(better, through, reach[run])
            via[run] = np.where(better, last[run, None], via[run])
            last[run] = np.argmin(np.where(done[run], np.inf, reach[run]), axis=1)
            length[run] = reach[run, last[run]]
            done[run, last[run]] = True
            row[run] = owner[at[run], last[run]]
            run = run[row[run] >= 0]
        row_price[at, start] += length
        b, col = np.nonzero(done & (np.arange(m) != last[:, None]))
        row_price[at[b], owner[at[b], col]] += length[b] - reach[b, col]
        col_price[at[b], col] -= length[b] - reach[b, col]
        run = np.arange(len(at))
        while len(run):
            before = via[run, last[run]]
            owner[at[run], last[run]] = np.where(before >= 0, owner[at[run], before], start)
            last[run] = before
            run = run[before >= 0]
    return owner


def assign_groups(group_rows: np.ndarray, group_columns: np.ndarray, cost: np.ndarray, gate: float = 1e6) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns paired by `assign_within` in each of many groups.

    A group has group_rows[k] rows and group_columns[k] columns; both are numbered on from group to group, and `cost`
    holds the groups' matrices one after the other, row by row.
    """
    cost = np.where(np.isfinite(cost), cost, gate)
    n, m = np.asarray(group_rows), np.asarray(group_columns)
    first_row, first_column, first = (np.concatenate([[0], np.cumsum(v)[:-1]]).astype(int) for v in (n, m, n * m))
    group = np.repeat(np.arange(len(n)), n * m)
    place = np.arange(len(cost)) - first[group]
    i, j = place // np.maximum(m[group], 1), place % np.maximum(m[group], 1)
    row, column, inside = first_row[group] + i, first_column[group] + j, cost < gate
    # where no row and no column has two pairs within the gate, those pairs are the assignment
    several = (np.bincount(row[inside], minlength=n.sum())[row] > 1) | (np.bincount(column[inside], minlength=m.sum())[column] > 1)
    hard = np.zeros(len(n), bool)
    hard[group[inside & several]] = True
    easy = inside & ~hard[group]
    rows, columns = [row[easy]], [column[easy]]
    # those of about one size together, so that little is padded
    turned = n > m
    wide, high = np.maximum(n, m), np.minimum(n, m)
    sizes = np.ceil(np.log2(np.maximum(wide, 1))).astype(int)
    for size in np.unique(sizes[hard]):
        some = np.flatnonzero(hard & (sizes == size))
        number = np.full(len(n), -1)
        number[some] = np.arange(len(some))
        of = number[group] >= 0
        g, k = group[of], number[group[of]]
        grid = np.full((len(some), high[some].max(), wide[some].max()), gate)
        grid[k, np.where(turned[g], j[of], i[of]), np.where(turned[g], i[of], j[of])] = cost[of]
        owner = assign_many(grid, high[some], wide[some])
        b, c = np.nonzero(owner >= 0)
        r = owner[b, c]
        ok = grid[b, r, c] < gate
        b, c, r = b[ok], c[ok], r[ok]
        g = some[b]
        rows.append(first_row[g] + np.where(turned[g], c, r))
        columns.append(first_column[g] + np.where(turned[g], r, c))
    return np.concatenate(rows), np.concatenate(columns)
