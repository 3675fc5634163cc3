"""A robust-pruned graph over unit vectors, and greedy search in it, for many vectors at once."""

from __future__ import annotations

import numpy as np

AT_ONCE = 100_000


def neighbours(offsets: np.ndarray, targets: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joined adjacency lists of nodes, and for each entry the place in nodes that it comes from."""
    n = offsets[nodes + 1] - offsets[nodes]
    owner = np.repeat(np.arange(len(nodes)), n)
    first = np.cumsum(n) - n
    return targets[np.arange(len(owner)) - first[owner] + offsets[nodes][owner]], owner


def search_graph(x: np.ndarray, offsets: np.ndarray, targets: np.ndarray, queries: np.ndarray, start: int, beam: int, at_least: float | None = None, slack: float = 0.03):
    """Greedy search from start: the best ``beam`` nodes of each query (-1: none), and all pairs (query, node) met with a cosine of at_least.

    Each round expands the best four open nodes of every beam, and all new nodes in
    range (with some slack) whether a beam holds them or not; it ends when none is left.
    """
    m, n = len(queries), len(x)
    reach = np.inf if at_least is None else at_least - slack
    met = np.full(m * n, -1, np.int32)
    best, sims, fresh = np.full((m, beam), -1, np.int64), np.full((m, beam), -2.0, x.dtype), np.zeros((m, beam), dtype=bool)
    rows, nodes, new = np.arange(m), np.full(m, start), queries @ x[start]
    met[rows * n + nodes] = 0
    hits = []
    while True:
        if at_least is not None:
            hits.append((rows * n + nodes)[new >= at_least - 1e-5])  # single precision: the caller verifies
        far = new >= reach
        # the best new nodes of each query beside its beam
        order = np.argsort(4.0 * rows - new)
        r, v, s = rows[order], nodes[order], new[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep, touched = rank < beam, r[rank == 0]
        at = (np.cumsum(rank == 0) - 1)[keep], beam + rank[keep]
        wide = [np.concatenate([a[touched], np.full((len(touched), beam), empty, a.dtype)], axis=1) for a, empty in ((best, -1), (sims, -2.0), (fresh, False))]
        for a, values in zip(wide, (v, s, s < reach), strict=True):
            a[at] = values[keep]
        top = np.argsort(-wide[1], axis=1, kind="stable")[:, :beam]
        best[touched], sims[touched], fresh[touched] = (np.take_along_axis(a, top, axis=1) for a in wide)
        i, j = np.nonzero(fresh & (np.cumsum(fresh, axis=1) <= 4))
        fresh[i, j] = False
        of, front = np.concatenate([i, rows[far]]), np.concatenate([best[i, j], nodes[far]])
        if not len(front):
            return best, divmod(np.concatenate(hits), n) if hits else None
        near, owner = neighbours(offsets, targets, front)
        keys = of[owner] * n + near
        keys = keys[met[keys] < 0]
        met[keys] = np.arange(len(keys), dtype=np.int32)
        keys = keys[met[keys] == np.arange(len(keys))]  # each node once
        rows, nodes = np.divmod(keys, n)
        new = np.empty(len(keys), x.dtype)
        for a in range(0, len(keys), AT_ONCE):
            new[a : a + AT_ONCE] = np.einsum("ij,ij->i", queries[rows[a : a + AT_ONCE]], x[nodes[a : a + AT_ONCE]])


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of the candidates of each point (-1: none) at most ``degree``: one goes when a nearer one that stays is alpha times nearer to it than the point is."""
    sims = np.where(pool >= 0, np.einsum("ij,ikj->ik", x[points], x[np.maximum(pool, 0)]), -2)
    sims[pool == points[:, None]] = -2
    order = np.argsort(-sims, axis=1, kind="stable")
    pool, sims = np.take_along_axis(pool, order, axis=1), np.take_along_axis(sims, order, axis=1)
    live = sims > -2
    live[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    y = x[np.maximum(pool, 0)]
    between, to_point = alpha * (1 - np.matmul(y, y.transpose(0, 2, 1))), 1 - sims
    kept = np.zeros(live.shape, dtype=bool)
    for j in range(pool.shape[1]):
        kept[:, j] = live[:, j] & (kept.sum(axis=1) < degree)
        drop = kept[:, j, None] & (between[:, j] <= to_point)
        drop[:, : j + 1] = False
        live &= ~drop
    out = np.full((len(points), degree), -1, np.int64)
    r, c = np.nonzero(kept)
    out[r, (np.cumsum(kept, axis=1) - 1)[r, c]] = pool[r, c]
    return out


def build_graph(x: np.ndarray, degree: int = 12, alpha: float = 1.2, beam: int = 16, most: int = 2048, seed: int = 5) -> np.ndarray:
    """Neighbours of each row of x (2 * degree columns, -1: none), by greedy insertion of batches that double up to ``most``."""
    degree = max(3, degree)
    n, width = len(x), 2 * degree
    near = np.full((n, width), -1, np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    done = min(1, n)
    while done < n:
        batch = order[done : min(n, max(2 * done, 16), done + most)]
        has = near >= 0
        pool, _ = search_graph(x, np.concatenate([[0], np.cumsum(has.sum(axis=1))]), near[has], x[batch], int(order[0]), beam)
        if done < beam:  # the first ones also know each other
            pool = np.concatenate([pool, np.broadcast_to(batch, (len(batch), len(batch)))], axis=1)
        far = order[rng.integers(0, done, (len(batch), 2))]  # long edges keep every cluster in reach
        out = np.concatenate([robust_prune(x, batch, pool, degree - 2, alpha), far], axis=1)
        out[far[:, 0] == far[:, 1], -1] = -1
        out[:, -2:][(out[:, -2:, None] == out[:, None, :-2]).any(axis=2)] = -1
        near[batch, :degree] = np.take_along_axis(out, np.argsort(out < 0, axis=1, kind="stable"), axis=1)
        # edges back, a list that overflows is pruned again
        r, c = np.nonzero(out >= 0)
        by = np.argsort(out[r, c], kind="stable")
        to, back = out[r, c][by], batch[r][by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        held = (near[nodes] >= 0).sum(axis=1)
        fits = held + count <= width
        some = np.repeat(fits, count)
        near[to[some], (np.repeat(held, count) + place)[some]] = back[some]
        over = np.flatnonzero(~fits)
        if len(over):
            pool = np.concatenate([near[nodes[over]], np.full((len(over), width), -1, np.int64)], axis=1)
            at = np.full(len(nodes), -1)
            at[over] = np.arange(len(over))
            some = ~some & (place < width)
            pool[np.repeat(at, count)[some], width + place[some]] = back[some]
            near[nodes[over]] = -1
            near[nodes[over], :degree] = robust_prune(x, nodes[over], pool, degree, alpha)
        done += len(batch)
    return near
