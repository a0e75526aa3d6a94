"""A robust-pruned directed graph over the vectors of one shard, and beam search in it: numpy, whole batches at a time.

Largest inner products are nearest neighbours on a sphere: every vector is divided by the shard's largest norm and gets
one more coordinate that brings it to length 1; a query gets 0 there. Vectors enter in batches of growing size: a
greedy search through the graph so far proposes neighbours, relaxed distance pruning keeps diverse ones, and each kept
edge is offered in reverse. Nodes that no path from the entry reaches get an edge from the nearest that is reached.

Hundreds of near copies would fill a beam and end the search among themselves. A vector that comes closer than NEAR of the
usual distance to a node which is there already is therefore no node of its own but a follower of that one; searches look
at all followers of a node that can still matter.
"""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, RELAX, BATCH, WIDE, NEAR = 32, 64, 1.2, 512, 4, 0.15


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 whose first coordinates are the given ones in a common scale."""
    x = vectors / np.abs(vectors).max()  # so that no square overflows
    size = np.einsum("nd,nd->n", x, x)
    rest = np.sqrt(np.maximum(size.max() - size, 0.0))
    return np.ascontiguousarray(np.column_stack([x, rest]) / np.sqrt(size.max()), dtype=np.float32)


def beam(z: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best `width` nodes found for each query (-1: none), and all nodes that were expanded on the way (-1: none)."""
    b = len(queries)
    ids, sims = np.full((b, width), -1, np.int32), np.full((b, width), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = entry, queries @ z[entry]
    done, seen = np.zeros((b, width), bool), np.zeros((b, len(z)), bool)
    seen[:, entry] = True
    trail, live, wide = [], np.arange(b), min(WIDE, width)
    while True:
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_, wide - 1, axis=1)[:, :wide]
        ok = np.isfinite(np.take_along_axis(open_, pick, 1))
        some = ok.any(axis=1)
        live, pick, ok = live[some], pick[some], ok[some]
        if not len(live):
            break
        at = live[:, None]
        now = np.where(ok, ids[at, pick], -1)
        done[at, pick] |= ok
        step = np.full((b, wide), -1, np.int32)
        step[live] = now
        trail.append(step)
        met = np.where(ok[:, :, None], graph[now], -1).reshape(len(live), -1)
        met.sort(axis=1)
        fresh = met >= 0
        fresh[:, 1:] &= met[:, 1:] != met[:, :-1]
        fresh &= ~seen[at, met]
        r, c = np.nonzero(fresh)
        node = met[r, c]
        seen[live[r], node] = True
        sim = np.full(met.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("fd,fd->f", z[node], queries[live[r]])
        all_sims = np.concatenate([sims[live], sim], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, met, -1)], axis=1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(met.shape, bool)], axis=1), top, 1)
    return ids, np.concatenate(trail, axis=1)


def prune(z: np.ndarray, own: np.ndarray, offered: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Of the offered nodes (-1: none; distinct in a row) the nearest is kept and drops all that it is `relax` times nearer
    to than `own` is; then the nearest that is left, until `degree` are kept."""
    out = np.full((len(own), degree), -1, np.int32)
    for k in range(0, len(own), 128):
        mine, cand = own[k : k + 128], offered[k : k + 128]
        ok = (cand >= 0) & (cand != mine[:, None])
        gap = np.where(ok, 2 - 2 * np.einsum("bcd,bd->bc", z[cand], z[mine]), np.inf)
        order = np.argsort(gap, axis=1, kind="stable")
        cand, gap = np.take_along_axis(cand, order, 1), np.take_along_axis(gap, order, 1)
        v = z[cand]
        among = (2 - 2 * (v @ v.transpose(0, 2, 1))) * np.float32(relax * relax)
        alive, rows = np.isfinite(gap), np.arange(len(mine))
        for turn in range(degree):
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[k : k + 128][has, turn] = cand[has, first[has]]
            alive[has] &= (among[rows, first] > gap)[has]
            alive[rows, first] = False
    return out


def _offer(z: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int, relax: float) -> None:
    """Every edge new -> node also as node -> new; a full node prunes what it has with what it is offered."""
    source, column = np.nonzero(graph[new] >= 0)
    node, source = graph[new][source, column], new[source]
    while len(node):
        order = np.argsort(node, kind="stable")
        node, source = node[order], source[order]
        nodes, first, times = np.unique(node, return_index=True, return_counts=True)
        turn = np.arange(len(node)) - np.repeat(first, times)
        now = turn < degree  # the others wait for the next round
        offers = np.full((len(nodes), degree), -1, np.int32)
        offers[np.repeat(np.arange(len(nodes)), times)[now], turn[now]] = source[now]
        both = np.concatenate([graph[nodes], offers], axis=1)
        fits = (both >= 0).sum(axis=1) <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
        graph[nodes[fits]] = packed[fits]
        if not fits.all():
            graph[nodes[~fits]] = prune(z, nodes[~fits], both[~fits], degree, relax)
        node, source = node[~now], source[~now]


def _reached(graph: np.ndarray, entry: int) -> np.ndarray:
    seen, edge = np.zeros(len(graph), bool), np.array([entry])
    while len(edge):
        seen[edge] = True
        edge = np.unique(graph[edge])
        edge = edge[(edge >= 0) & ~seen[edge]]
    return seen


def _connect(z: np.ndarray, graph: np.ndarray, entry: int, nodes: np.ndarray) -> np.ndarray:
    """Edges to nodes that can't be reached, in columns of their own where there is no room."""
    lost = nodes[~_reached(graph, entry)[nodes]]
    while len(lost):
        for k in range(0, len(lost), BATCH):
            some = lost[k : k + BATCH]
            found, _ = beam(z, graph, entry, z[some], BUILD_BEAM)
            best = np.where(found >= 0, np.einsum("bcd,bd->bc", z[found], z[some]), -np.inf).argmax(axis=1)
            for node, near in zip(some, found[np.arange(len(some)), best], strict=True):
                free = np.flatnonzero(graph[near] < 0)
                if not len(free):
                    free = [graph.shape[1]]
                    graph = np.concatenate([graph, np.full((len(graph), 2), -1, np.int32)], axis=1)
                graph[near, free[0]] = node
        lost = nodes[~_reached(graph, entry)[nodes]]
    return graph


def build(z: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, relax: float = RELAX, near: float = NEAR):
    """(neighbours of every node or -1, home, entry, radius): home is the node a vector follows (itself, if it is one), at
    a distance of at most radius; the entry node is nearest to the mean. Same input, same graph."""
    n = len(z)
    entry = int((z @ z.mean(axis=0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    graph, home = np.full((n, degree), -1, np.int32), np.arange(n, dtype=np.int32)
    start = order[: 2 * degree]
    gaps = np.maximum(2 - 2 * z[start] @ z[start].T, 0)
    within = float(near * near * np.quantile(gaps, 0.9))
    nodes = []
    for k, node in enumerate(start):
        close = [j for j in nodes if gaps[k, j] <= within]
        if close:
            home[node] = start[close[0]]
        else:
            nodes.append(k)
    nodes = start[nodes]
    graph[nodes] = prune(z, nodes, np.tile(nodes, (len(nodes), 1)), degree, relax)
    at = len(start)
    while at < n:
        new = order[at : at + min(BATCH, at)]
        at += len(new)
        found, met = beam(z, graph, entry, z[new], width)
        sims = np.where(found >= 0, np.einsum("bcd,bd->bc", z[found], z[new]), -np.inf)
        best = sims.argmax(axis=1)
        follows = 2 - 2 * sims[np.arange(len(new)), best] <= within
        home[new[follows]] = found[np.arange(len(new)), best][follows]
        new, met = new[~follows], met[~follows]
        graph[new] = prune(z, new, met, degree, relax)
        _offer(z, graph, new, degree, relax)
    return _connect(z, graph, entry, np.flatnonzero(home == np.arange(n))), home, entry, within**0.5
