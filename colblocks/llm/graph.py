"""A flat proximity graph of unit vectors: robust pruning, insertion by greedy search, range search from medoids. Pure numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DEGREE, BEAM, REACH, ALPHA, STEP, QUERIES = 24, 32, 16, 1.2, 4, 256  # BEAM where the graph is built, REACH where it is searched


def medoids(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Rows to start searches from: those nearest to about sqrt(n) / 2 centres of ``x`` and to its mean, and as many again, each the one farthest
    from all before, so that no group lies apart from every start."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), max(1, int(np.sqrt(len(x)) / 2)), replace=False))]
    for _ in range(3):
        near = np.concatenate([(x[a : a + 1024] @ c.T).argmax(axis=1) for a in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = sums
    centres = np.concatenate([c, x.mean(axis=0, keepdims=True)])
    best, at = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ centres.T
        top = s.argmax(axis=0)
        value = s[top, np.arange(len(centres))]
        at, best = np.where(value > best, a + top, at), np.maximum(value, best)
    at = np.unique(at)
    covered, more = np.full(len(x), -np.inf, x.dtype), []
    for start in at:
        covered = np.maximum(covered, x @ x[start])
    while len(more) < len(at) and covered.min() < 1 - 1e-6:
        more.append(int(covered.argmin()))
        covered = np.maximum(covered, x @ x[more[-1]])
    return np.unique(np.concatenate([at, np.array(more, np.int64)]))


def robust_prune(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """``degree`` out-edges of each node of ``found`` (one row each, -1 for none): the nearest first, and after each the ones dropped to which it is
    nearer, by the factor ALPHA, than the node is. -1 pads."""
    out = np.full((len(nodes), degree), -1, np.int32)
    for a in range(0, len(nodes), 512):
        p, c = nodes[a : a + 512], np.sort(found[a : a + 512], axis=1)
        repeat = np.concatenate([np.zeros((len(c), 1), bool), c[:, 1:] == c[:, :-1]], axis=1)
        alive = (c >= 0) & (c != p[:, None]) & ~repeat
        v = x[c]
        to = np.where(alive, 2 - 2 * np.matmul(v, x[p][:, :, None])[:, :, 0], np.inf)
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        every = np.arange(len(p))
        for r in range(degree):
            left = np.where(alive, to, np.inf)
            best = left.argmin(axis=1)
            some = np.isfinite(left[every, best])
            if not some.any():
                break
            out[a + every[some], r] = c[every[some], best[some]]
            alive &= ALPHA**2 * between[every, best] > to
            alive[every, best] = False
    return out


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, in no order."""
    return np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)


def greedy(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(beam, similarities) of each query after greedy search from ``starts``; the beam holds the ``width`` best found, in no order, -1 pads."""
    n, every = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    seen[:, starts] = True
    s = queries @ x[starts].T
    top = _best(s, width)
    beam, sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    beam[:, : top.shape[1]], sims[:, : top.shape[1]] = starts[top], s[every, top]
    done = beam < 0
    active = np.arange(n)
    while len(active):
        rows = active[:, None]
        pick = _best(np.where(done[active], -np.inf, sims[active]), STEP)
        fresh = ~done[rows, pick]
        done[rows, pick] = True
        new = np.where(fresh[:, :, None], edges[beam[rows, pick]], -1).reshape(len(active), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        q, k = np.nonzero(~seen[rows, new])
        node = new[q, k]
        seen[active[q], node] = True
        sim = np.full(new.shape, -np.inf, np.float32)
        sim[q, k] = np.einsum("pd,pd->p", queries[active[q]], x[node])
        ids = np.concatenate([beam[active], np.where(sim > -np.inf, new, -1)], axis=1)
        sim = np.concatenate([sims[active], sim], axis=1)
        old = np.concatenate([done[active], sim[:, width:] == -np.inf], axis=1)
        order = _best(sim, width)
        here = np.arange(len(active))[:, None]
        beam[active], sims[active], done[active] = ids[here, order], sim[here, order], old[here, order]
        active = active[~done[active].all(axis=1)]
    return beam, sims


def build(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """The graph's lists, a row of DEGREE to a node, -1 pads. Nodes enter in a seeded order and in batches that double, each found by greedy search
    over the graph so far, pruned, and linked back; lists that overflow are pruned again."""
    x = x.astype(np.float32)
    edges = np.full((len(x), DEGREE), -1, np.int32)
    starts = medoids(x)
    rest = np.setdiff1d(np.arange(len(x)), starts)
    order = np.concatenate([starts, np.random.default_rng(seed).permutation(rest)])
    at = 0
    while at < len(order):
        size = len(starts) if at == 0 else min(max(at // 2, 1), 4096)
        batch = order[at : at + size]
        for a in range(0, len(batch), QUERIES):
            part = batch[a : a + QUERIES]
            beam, _ = greedy(x, edges, starts, x[part])
            edges[part] = robust_prune(x, part, beam)
        to, back = edges[batch].ravel(), np.repeat(batch, DEGREE)
        to, back = to[to >= 0], back[to >= 0]
        by = np.lexsort((back, to))
        to, back = to[by], back[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 512):
            some = slice(a, a + 512)
            width = int(count[some].max())
            cols = np.arange(width)
            lists = np.where(cols < count[some, None], back[np.minimum(first[some, None] + cols, len(back) - 1)], -1)
            edges[nodes[some]] = _merged(x, nodes[some], edges[nodes[some]], lists)
        at += size
    return edges


def _merged(x: np.ndarray, nodes: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Old and new lists in one: as they are if they fit, else pruned; very long new lists go in by pieces of 64."""
    for a in range(0, new.shape[1], 64):
        piece = np.sort(np.concatenate([old, new[:, a : a + 64]], axis=1), axis=1)[:, ::-1]
        piece[:, 1:][piece[:, 1:] == piece[:, :-1]] = -1
        piece = np.sort(piece, axis=1)[:, ::-1]
        full = (piece >= 0).sum(axis=1) > DEGREE
        old = piece[:, :DEGREE].copy()
        if full.any():
            old[full] = robust_prune(x, nodes[full], piece[full])
    return old


def restricted(ids: np.ndarray, owner: np.ndarray, near: np.ndarray) -> np.ndarray:
    """United lists (node ``owner`` names id ``near``, in order of owner) as a matrix over the nodes ``ids``; ids from elsewhere fall out."""
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, near, sorter=order), len(ids) - 1)
    here = ids[order[at]] == near
    owner, to = owner[here], order[at[here]]
    count = np.bincount(owner, minlength=len(ids))
    edges = np.full((len(ids), max(1, int(count.max(initial=0)))), -1, np.int32)
    edges[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = to
    return edges


def range_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(i, j, from, to): rows j of ``x`` found at ``threshold`` or more of row i of ``queries``, by ranges of queries, in order.

    A beam reaches the neighbourhood; from there every found row in range, or not more than a fifth of the range's angle beyond it, is expanded until
    no new one comes. A query that finds more than two beams and 1/96 of ``x`` is in a dense group, whose lists cost more to follow than ``x`` to read:
    it is compared with ``x``. All is verified in double precision.
    """
    outer = np.cos(min(np.pi, 1.2 * np.arccos(min(1.0, threshold))))
    error = 1.2e-7 * (x.shape[1] + 4)
    x32 = x.astype(np.float32)
    widest = max(2 * BEAM, len(x) // (4 * DEGREE))
    for a in range(0, len(queries), QUERIES):
        q64 = queries[a : a + QUERIES]
        q32 = q64.astype(np.float32)
        beam, sims = greedy(x32, edges, starts, q32, REACH)
        hit = sims >= outer
        fq, fn = np.nonzero(hit)[0], beam[hit].astype(np.int64)
        seen = np.zeros((len(q64), len(x) + 1), bool)  # anew: what fell off a full beam may be in range
        seen[:, -1] = True
        seen[fq, fn] = True
        pairs = [(fq, fn)]
        count = np.bincount(fq, minlength=len(q64))
        while len(fq):
            go = count[fq] <= widest
            fq, fn = fq[go], fn[go]
            key = np.unique((fq[:, None] * (len(x) + 1) + np.where(edges[fn] < 0, len(x), edges[fn])).ravel())
            fq, fn = np.divmod(key, len(x) + 1)
            new = ~seen[fq, fn]
            fq, fn = fq[new], fn[new]
            seen[fq, fn] = True
            near = np.einsum("pd,pd->p", q32[fq], x32[fn]) >= outer
            fq, fn = fq[near], fn[near]
            count += np.bincount(fq, minlength=len(q64))
            pairs.append((fq, fn))
        i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        dense = np.flatnonzero(count > widest)
        if len(dense):
            keep = count[i] <= widest
            di, dj = np.nonzero(q32[dense] @ x32.T >= threshold - error)
            i, j = np.concatenate([i[keep], dense[di]]), np.concatenate([j[keep], dj])
        by = np.lexsort((j, i))
        i, j = i[by], j[by]
        keep = np.concatenate([np.einsum("pd,pd->p", q64[i[b : b + 65536]], x[j[b : b + 65536]]) >= threshold for b in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        yield a + i[keep], j[keep], a, min(a + QUERIES, len(queries))
