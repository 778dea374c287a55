"""Earth mover's distance by min-cost flow on quantized masses and costs."""

from __future__ import annotations

import numpy as np

#: Masses and costs are rounded to this many steps.
STEPS = 1_000_000


def transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> tuple[int, np.ndarray]:
    """Cheapest way to ship min(sum of supply, sum of demand): (cost, flow), all integers.

    Successive shortest augmenting paths on the dense bipartite graph, with node potentials; each search
    is a vectorised Dijkstra over the columns.
    """
    supply, demand = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    n, m = cost.shape
    cost = cost.astype(np.int64)
    flow = np.zeros((n, m), np.int64)
    row_pot, col_pot = np.zeros(n, np.int64), np.zeros(m, np.int64)
    far = np.iinfo(np.int64).max // 4
    left = min(int(supply.sum()), int(demand.sum()))
    while left > 0:
        # a common root leads to every row with supply left; its potential is 0
        row_d, col_d = np.where(supply > 0, -row_pot, far), np.full(m, far)
        row_from, col_from = np.full(n, -1), np.full(m, -1)
        row_done, col_done = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            r = int(np.where(row_done, far, row_d).argmin())
            c = int(np.where(col_done, far, col_d).argmin())
            rd, cd = far if row_done[r] else row_d[r], far if col_done[c] else col_d[c]
            if min(rd, cd) >= far:
                break
            if rd <= cd:
                row_done[r] = True
                new = rd + cost[r] + row_pot[r] - col_pot
                better = ~col_done & (new < col_d)
                col_d[better], col_from[better] = new[better], r
            else:
                col_done[c] = True
                back = flow[:, c] > 0
                new = cd - cost[:, c] - row_pot + col_pot[c]
                better = back & ~row_done & (new < row_d)
                row_d[better], row_from[better] = new[better], c
        sinks = np.flatnonzero((demand > 0) & (col_d < far))
        end = int(sinks[np.argmin(col_d[sinks] + col_pot[sinks])])
        path, c = [], end
        while True:
            r = int(col_from[c])
            path.append((r, c, 1))
            if row_from[r] < 0:
                break
            c2 = int(row_from[r])
            path.append((r, c2, -1))
            c = c2
        amount = min(int(supply[r]), int(demand[end]), *(int(flow[i, j]) for i, j, s in path if s < 0))
        for i, j, s in path:
            flow[i, j] += s * amount
        supply[r] -= amount
        demand[end] -= amount
        left -= amount
        reach = row_d < far
        row_pot[reach] += row_d[reach]
        reach_c = col_d < far
        col_pot[reach_c] += col_d[reach_c]
    return int((flow * cost).sum()), flow


def emd(p: np.ndarray, q: np.ndarray, cost: np.ndarray, penalty: float = 0.0, with_flow: bool = False):
    """Distance between masses ``p`` and ``q`` under a ground cost matrix; ``penalty`` is charged on the difference of the sums (-1: the largest cost).

    All-zero costs and empty sides give the penalty part only.
    """
    p, q, cost = np.asarray(p, float), np.asarray(q, float), np.asarray(cost, float)
    largest = max(p.sum(), q.sum()) if len(p) or len(q) else 0.0
    top = cost.max() if cost.size else 0.0
    extra = (largest - min(p.sum(), q.sum())) * (top if penalty == -1 else penalty)
    if not cost.size or top <= 0 or largest <= 0:
        return (extra, np.zeros(cost.shape)) if with_flow else extra
    mass, price = STEPS / largest, STEPS / top
    total, flow = transport(np.floor(p * mass + 0.5), np.floor(q * mass + 0.5), np.floor(cost * price + 0.5))
    value = total / mass / price + extra
    return (value, flow / mass) if with_flow else value


def emd_line(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray) -> float:
    """Distance of equal masses on a line, in closed form: the area between the sums of mass up to each place."""
    at = np.concatenate([x, y])
    order = np.argsort(at, kind="stable")
    ahead = np.cumsum(np.concatenate([p, -q])[order])[:-1]
    return float(np.abs(ahead) @ np.diff(at[order]))


def emd_metric(p: np.ndarray, q: np.ndarray, cost: np.ndarray, penalty: float = 0.0) -> float:
    """As ``emd`` where the ground cost is a metric over shared bins: common mass stays in place at no cost."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    common = np.minimum(p, q)
    return emd(p - common, q - common, cost, penalty)


def emd_signatures(first: list[tuple], second: list[tuple], ground, penalty: float = 0.0) -> float:
    """Between two signatures: lists of (feature, weight), and a ground distance of two features."""
    cost = np.array([[ground(a, b) for b, _ in second] for a, _ in first], float).reshape(len(first), len(second))
    return emd([w for _, w in first], [w for _, w in second], cost, penalty)
