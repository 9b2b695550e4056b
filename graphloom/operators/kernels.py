"""Sequential algorithms on one component or a small graph, in numpy; they run in one task each."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np

#: Cells of a row whose ends' bits are ored one after the other; of a longer row, so many at a time.
HOP_CELLS = 256
#: Rows whose ends' bits are gathered at once.
HOP_ROWS = 4096
#: Links that are lists of Python's numbers at once.
LISTED = 1 << 16
#: A row of links is an array when it has more than one in so many communities as neighbours.
WIDE = 16
MERGES = "step int, delta double, index0 long, index1 long"


def greedy_links(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, norm: float, directed: bool, strength: dict[int, tuple[float, float]]) -> list[tuple[float, int, int]]:
    """Merges (gain, index0, index1) of linked communities by best gain, until none are linked.

    Gains are rounded to single precision where they are compared; of equal gains the first in the order of (i, j) wins: undirected
    pairs stand as i > j, directed links as they point. Gains wait in a heap; a merge makes those around its community anew.
    """
    single = np.float32
    rows: dict[int, dict[int, np.float32]] = {}
    into: dict[int, set[int]] = {}
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.astype(single), strict=True):
        rows.setdefault(a, {})[b] = w
        rows.setdefault(b, {})
        into.setdefault(b, set()).add(a)
        into.setdefault(a, set())
    out = {v: strength[v][0] for v in rows}
    inn = {v: strength[v][1] for v in rows}

    def expected(i: int, j: int) -> np.float32:
        return single(-out[i] * inn[j] / norm)

    def gain(i: int, j: int) -> float:
        if directed:
            return float(single(single(rows[i][j] + expected(i, j)) + single(rows[j].get(i, single(0)) + expected(j, i))))
        return float(single(2.0 * single(rows[i][j] + expected(i, j))))

    stamp = dict.fromkeys(rows, 0)
    heap = [(-gain(i, j), i, j, 0, 0) for i in rows for j in rows[i] if (i != j if directed else i > j)]
    heapq.heapify(heap)
    log = []
    while heap:
        minus, i, j, si, sj = heapq.heappop(heap)
        if stamp.get(i) != si or stamp.get(j) != sj or j not in rows[i]:
            continue
        log.append((-minus, i, j))
        # j goes into i: rows, then columns.
        for k, w in rows.pop(j).items():
            k2 = i if k == j else k
            rows[i][k2] = single(rows[i].get(k2, single(0)) + w)
            into[k].discard(j)
            into[k2].add(i)
        for k in into.pop(j):
            if k in rows and j in rows[k]:
                rows[k][i] = single(rows[k].get(i, single(0)) + rows[k].pop(j))
                into[i].add(k)
        out[i] += out.pop(j)
        inn[i] += inn.pop(j)
        del stamp[j]
        stamp[i] += 1
        for k in rows[i].keys() | into[i]:
            if k == i:
                continue
            for a, b in ((i, k), (k, i)):
                if b in rows[a] and (directed or a > b):
                    heapq.heappush(heap, (-gain(a, b), a, b, stamp[a], stamp[b]))
    return log


class _Links:
    """Links of communities in both directions, without loops: for each a dictionary of neighbours and weights, or an array of n weights (absent: NaN) where that is smaller."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int):
        names = list(range(n))
        self.n, self.rows = n, [{} for _ in names]
        # Most weights are the same few numbers, which needn't be held for each link; a few links at a time, as lists are large.
        known: dict[float, float] = {}
        for low in range(0, len(src), LISTED):
            some = slice(low, low + LISTED)
            for a, b, w in zip(src[some].tolist(), dst[some].tolist(), weight[some].tolist(), strict=True):
                self.rows[a][names[b]] = self.rows[b][names[a]] = known.setdefault(w, w) if len(known) < LISTED else w

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        near = self.rows[i]
        if isinstance(near, dict):
            if len(near) * WIDE <= self.n:
                return np.fromiter(near.keys(), np.int64, len(near)), np.fromiter(near.values(), np.float32, len(near))
            wide = np.full(self.n, np.nan, np.float32)
            wide[list(near)] = list(near.values())
            self.rows[i] = near = wide
        known = np.flatnonzero(~np.isnan(near))
        return known, near[known]

    def merge(self, i: int, j: int) -> None:
        """j goes into i; weights are added in single precision."""
        rows, near, (ks, ws) = self.rows, self.rows[i], self.row(j)
        ks, ws = ks[ks != i], ws[ks != i]
        rows[j] = {}
        if isinstance(near, dict):
            del near[j]
            own = np.array([near.get(k, np.nan) for k in ks.tolist()], np.float32)
        else:
            near[j] = np.nan
            own = near[ks]
        summed = np.where(np.isnan(own), ws, own + ws)
        if not isinstance(near, dict):
            near[ks] = summed
        for k, w in zip(ks.tolist(), summed.tolist(), strict=True):
            row = rows[k]
            if isinstance(row, dict):
                del row[j]
            else:
                row[j] = np.nan
            row[i] = w
            if isinstance(near, dict):
                near[k] = w


def greedy_neighbours(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, norm: float, strength: dict[int, float]) -> list[tuple[float, int, int]]:
    """The merges of :func:`greedy_links` for an undirected graph, from its cells in one direction; ``norm`` is neither 0 nor infinite.

    A merge changes the gains of all pairs of one community, so no heap holds pairs: each community keeps its best pair with a lower one, and
    waits in the heap with that. Where the pair got worse or went, its old gain stays as a bound, and the community's pairs are
    looked through only when that comes up.
    """
    keep = src != dst
    src, dst, weight = src[keep], dst[keep], weight[keep]
    ids = np.union1d(src, dst)
    n, names = len(ids), ids.tolist()
    out = np.array([strength[v] for v in names], float)
    links = _Links(np.searchsorted(ids, src), np.searchsorted(ids, dst), weight.astype(np.float32), n)
    # The best gain with a lower community or a bound of it, the first such community, and whether it is a bound only.
    best, mate, bound = np.full(n, -np.inf, np.float32), np.full(n, -1), np.zeros(n, bool)
    heap: list[tuple[float, int]] = []
    log: list[tuple[float, int, int]] = []

    def gains(i: int, ks: np.ndarray, ws: np.ndarray) -> np.ndarray:
        return np.float32(2.0) * (ws + (-(out[i] * out[ks]) / norm).astype(np.float32))

    def keep_best(i: int, ks: np.ndarray, gain: np.ndarray) -> None:
        bound[i], best[i] = False, -np.inf
        if len(ks):
            best[i] = gain.max()
            mate[i] = ks[gain == best[i]].min()
            heapq.heappush(heap, (-float(best[i]), i))

    def look(i: int) -> None:
        ks, ws = links.row(i)
        lower = ks < i
        keep_best(i, ks[lower], gains(i, ks[lower], ws[lower]))

    for i in range(n):
        look(i)
    while heap:
        minus, i = heapq.heappop(heap)
        if best[i] != -minus:
            continue
        if bound[i]:
            look(i)
            continue
        j = int(mate[i])
        log.append((-minus, names[i], names[j]))
        links.merge(i, j)
        out[i] += out[j]
        best[j] = -np.inf
        ks, ws = links.row(i)
        gain = gains(i, ks, ws)
        lower = ks < i
        keep_best(i, ks[lower], gain[lower])
        bound[ks[mate[ks] == j]] = True
        ks, gain = ks[~lower], gain[~lower]
        old = best[ks]
        bound[ks[(gain < old) & (mate[ks] == i)]] = True
        tied = ks[(gain == old) & ~bound[ks]]
        mate[tied] = np.minimum(mate[tied], i)
        more, gain = ks[gain > old], gain[gain > old]
        best[more], mate[more], bound[more] = gain, i, False
        for k, g in zip(more.tolist(), gain.tolist(), strict=True):
            heapq.heappush(heap, (-g, k))
    return log


def greedy_pairs(matrix: np.ndarray, out: np.ndarray, inn: np.ndarray, norm: float, directed: bool, minimize: bool, which: str) -> list[tuple[float, int, int]]:
    """Merges by best gain among ``which`` pairs of communities: ``any`` or those without a link (``apart``).

    The matrix is dense and changes in place (absent: NaN). Pairs are compared in single precision. Directed: the first pair in the order of
    (i, j), i > j. Undirected: among unlinked pairs the extreme product of weights rules, ties by id; a linked pair has to
    be strictly better.
    """
    n = len(out)
    single = np.float32
    alive = np.ones(n, bool)
    sign = -1.0 if minimize else 1.0
    low = np.tril(np.ones((n, n), bool), -1)
    log = []
    while alive.sum() > 1:
        expected = (-np.outer(out, inn) / norm).astype(single)
        plain = np.nan_to_num(matrix, nan=0.0).astype(single)
        pairs = low & alive[:, None] & alive[None, :]
        if directed:
            gains = ((plain + expected).astype(single) + (plain + expected).astype(single).T).astype(single)
            best = _first(gains, pairs, sign)
        else:
            gains = (2.0 * (plain + expected).astype(single)).astype(single)
            linked = ~np.isnan(matrix)
            best = _first((2.0 * -np.outer(out, out) / norm).astype(single), pairs & ~linked, sign)
            if which == "any":
                other = _first(gains, pairs & linked, sign)
                if best is None or (other is not None and sign * other[0] > sign * best[0]):
                    best = other
        if best is None:
            break
        gain, i, j = best
        log.append((gain, i, j))
        known = ~np.isnan(matrix)
        row = np.where(known[i] | known[j], np.nan_to_num(matrix[i]) + np.nan_to_num(matrix[j]), np.nan)
        matrix[i], matrix[j] = row, np.nan
        known = ~np.isnan(matrix)
        column = np.where(known[:, i] | known[:, j], np.nan_to_num(matrix[:, i]) + np.nan_to_num(matrix[:, j]), np.nan)
        matrix[:, i], matrix[:, j] = column, np.nan
        out[i] += out[j]
        out[j] = 0
        if inn is not out:
            inn[i] += inn[j]
            inn[j] = 0
        alive[j] = False
    return log


def greedy_scattered(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, norm: float, strength: np.ndarray, minimize: bool, which: str) -> list[tuple[float, int, int]]:
    """The merges of :func:`greedy_pairs` for undirected graphs without negative strengths, in memory that grows with vertices and links.

    An unlinked pair's gain depends on the product of two strengths alone. So vertices are kept by strength, strengths in order, and
    pairs of strengths are looked at from the extreme product on, as long as they can still win; within a pair of strengths the
    first pair of ids without a link counts. Linked pairs wait in a heap.
    """
    single = np.float32
    sign = -1.0 if minimize else 1.0
    out = [float(x) for x in strength]
    rows: list[dict[int, float]] = [{} for _ in out]
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        rows[a][b] = w
    members: dict[float, list[int]] = {}
    for v, x in enumerate(out):
        members.setdefault(x, []).append(v)
    values, stamp, heap, log = sorted(members), [0] * len(out), [], []

    def apart(x: float, y: float) -> float:
        return float(single(2.0 * -(x * y) / norm))

    def push(i: int, j: int) -> None:
        gain = float(single(2.0) * (single(rows[i][j]) + single(-(out[i] * out[j]) / norm)))
        heapq.heappush(heap, (-sign * gain, i, j, stamp[i], stamp[j], gain))

    def first(x: float, y: float) -> tuple[int, int] | None:
        xs, ys = members[x], members[y]
        for i in xs if x == y else heapq.merge(xs, ys):
            for j in xs if out[i] == y else ys:
                if j >= i:
                    break
                if j not in rows[i]:
                    return i, j
        return None

    def scattered() -> tuple[float, int, int, float] | None:
        best = None
        order = values[::-1] if minimize else values
        for at, x in enumerate(order):
            if best is not None and sign * apart(x, x) < -best[0]:
                break
            for y in order[at:] if at else order:
                gain = apart(x, y)
                if best is not None and sign * gain < -best[0]:
                    break
                pair = first(x, y)
                if pair is not None and (best is None or (-sign * gain, *pair) < best[:3]):
                    best = (-sign * gain, *pair, gain)
        return best

    def leave(v: int) -> None:
        own = members[out[v]]
        del own[bisect_left(own, v)]
        if not own:
            del members[out[v]], values[bisect_left(values, out[v])]

    if which == "any":
        for i, row in enumerate(rows):
            for j in row:
                if j < i:
                    push(i, j)
    while True:
        while heap and (stamp[heap[0][1]] != heap[0][3] or stamp[heap[0][2]] != heap[0][4]):
            heapq.heappop(heap)
        best = scattered()
        # A linked pair has to be strictly better.
        if heap and (best is None or heap[0][0] < best[0]):
            best = (*heap[0][:3], heap[0][5])
        if best is None:
            return log
        _, i, j, gain = best
        log.append((gain, i, j))
        leave(i), leave(j)
        near, gone = rows[i], rows[j]
        loops = [near.pop(i, None), gone.pop(i, None), near.pop(j, None), gone.pop(j, None)]
        for k, w in gone.items():
            del rows[k][j]
            near[k] = rows[k][i] = near.get(k, 0.0) + w
        if any(w is not None for w in loops):
            kept = [w or 0.0 for w in loops]
            near[i] = (kept[0] + kept[1]) + (kept[2] + kept[3])
        rows[j] = {}
        out[i] += out[j]
        stamp[i], stamp[j] = stamp[i] + 1, -1
        if out[i] not in members:
            insort(values, out[i])
            members[out[i]] = []
        insort(members[out[i]], i)
        if which == "any":
            for k in near:
                if k != i:
                    push(max(i, k), min(i, k))


def numbered(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all ends in ascending order, and the cells in their numbers, in the order of ``src``."""
    if not len(src):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = min(src.min(), dst.min())
    span = int(max(src.max(), dst.max())) - int(low) + 1
    if span <= 4 * len(src):
        # Ids that lie close together are marked in place of being sorted.
        there = np.zeros(span, bool)
        there[src - low] = there[dst - low] = True
        ids, place = np.flatnonzero(there) + low, np.cumsum(there) - 1
        src, dst = place[src - low], place[dst - low]
    else:
        ids = np.union1d(src, dst)
        src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    # Short numbers are sorted by their digits.
    order = np.argsort(src.astype(np.uint16) if len(ids) <= 1 << 16 else src, kind="stable")
    return ids, src[order], dst[order]


def least_linked(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ends in ascending order, and for each the least id that links lead to, in either direction."""
    ids, near, far = numbered(src, dst)
    root = np.arange(len(ids))
    while True:
        a, b = root[near], root[far]
        apart = a != b
        if not apart.any():
            return ids, ids[root]
        near, far, a, b = near[apart], far[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def targets_at_once(n: int, most: int) -> int:
    """From how many targets of n vertices :func:`hop_bits` should search at once, so that a table of bits has 64 MB; ``most`` at most."""
    return min(most, max(256, (1 << 29) // max(1, n) // 64 * 64))


def hop_bits(src: np.ndarray, dst: np.ndarray, n: int, targets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(hops, bits) round by round: bit k of row v is set if ``targets[k]`` is at just so many hops from v. ``src`` is in ascending order."""
    at = np.arange(len(targets))
    bits = np.zeros((n, -(-len(targets) // 64)), np.uint64)
    np.bitwise_or.at(bits, (targets, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    full = np.bitwise_or.reduce(bits, axis=0)
    seen, hops = bits.copy(), 0
    while most is None or hops < most:
        hops += 1
        # Only cells count that lead from a row that lacks bits to one that got some in the last round.
        lacks, got = (seen != full).any(axis=1), bits.any(axis=1)
        use = slice(None) if lacks.all() and got.all() else lacks[src] & got[dst]
        near, far = src[use], dst[use]
        new = np.zeros_like(bits)
        if len(near):
            starts = np.append(0, np.flatnonzero(near[1:] != near[:-1]) + 1)
            new[near[starts]] = _ored(bits, far, starts, np.append(starts[1:], len(far)))
        new &= ~seen
        if not new.any():
            return
        seen |= new
        yield hops, new
        bits = new


def _ored(bits: np.ndarray, far: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row, which has one cell at least: the bits of the vertices ``far[start:end]``, ored.

    The first cells of many rows are gathered at once, then the second ones, and so on; rows are taken by length, so those that go on come first, and
    long ones are cut. A few rows at a time, so that what is gathered stays small.
    """
    sizes = ends - starts
    if sizes.max() > HOP_CELLS:
        pieces = -(-sizes // HOP_CELLS)
        first = np.cumsum(pieces) - pieces
        row = np.repeat(np.arange(len(starts)), pieces)
        low = starts[row] + (np.arange(len(row)) - first[row]) * HOP_CELLS
        return np.bitwise_or.reduceat(_ored(bits, far, low, np.minimum(low + HOP_CELLS, ends[row])), first, axis=0)
    order = np.argsort(-sizes, kind="stable")
    found = np.empty((len(starts), bits.shape[1]), np.uint64)
    more = np.empty((min(HOP_ROWS, len(starts)), bits.shape[1]), np.uint64)
    for at in range(0, len(order), HOP_ROWS):
        rows = order[at : at + HOP_ROWS]
        cell, size = starts[rows], sizes[rows]
        own = bits[far[cell]]
        for k, m in enumerate(np.searchsorted(-size, -np.arange(1, size[0])).tolist(), 1):
            np.take(bits, far[cell[:m] + k], axis=0, out=more[:m], mode="clip")
            own[:m] |= more[:m]
        found[rows] = own
    return found


def _first(gains: np.ndarray, pairs: np.ndarray, sign: float) -> tuple[float, int, int] | None:
    if not pairs.any():
        return None
    at = int(np.where(pairs, sign * gains.astype(float), -np.inf).argmax())
    i, j = divmod(at, gains.shape[1])
    return float(gains[i, j]), i, j


def spread_colours(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the cells in ascending order, and each one's colour: in that order the least that no lower neighbour has."""
    keep = dst <= src
    ids, near, far = numbered(src[keep], dst[keep])
    colours = np.zeros(len(ids), np.int64)
    starts = np.searchsorted(near, np.arange(len(ids) + 1)).tolist()
    for i, (low, high) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        lower = far[low:high]
        taken = np.zeros(high - low + 2, bool)
        # More colours than neighbours can't all be taken.
        taken[np.minimum(colours[lower[lower < i]], high - low + 1)] = True
        taken[-1] = False
        colours[i] = taken.argmin()
    return ids, colours


def sample_blocks(src: np.ndarray, dst: np.ndarray, n: int, sweeps: int, most: int, seed: int, states: list | None = None) -> list[tuple[int, int, float]]:
    """(sweep, groups, log probability) of a degree-corrected block model whose number of groups is sampled along.

    Moves take a vertex to another group or to a new one; a group that loses its last vertex goes. Acceptance is that of Metropolis and
    Hastings for exactly these proposals. ``states`` gets the groups of all vertices after each sweep.
    """
    rng = np.random.default_rng(seed)
    keep = src != dst
    neighbours = [dst[keep & (src == v)] for v in range(n)] if n < 5000 else np.split(dst[keep][np.argsort(src[keep], kind="stable")], np.cumsum(np.bincount(src[keep], minlength=n))[:-1])
    degree = np.array([len(x) for x in neighbours])
    links = degree.sum() / 2
    density = 2 * links / (n * n) if n else 0.0
    g = rng.integers(0, min(most, max(1, n // 2)), n)
    g = np.unique(g, return_inverse=True)[1] if n else g
    lg = math.lgamma

    def parts(sizes: np.ndarray, kappa: np.ndarray, m: np.ndarray, which: list[int]) -> float:
        """What the groups in ``which`` contribute."""
        total = 0.0
        for r in which:
            total += lg(sizes[r] + 1) + kappa[r] * math.log(sizes[r]) + lg(sizes[r]) - lg(kappa[r] + sizes[r])
        k = len(sizes)
        done = set()
        for r in which:
            for s in range(k):
                if (min(r, s), max(r, s)) in done:
                    continue
                done.add((min(r, s), max(r, s)))
                half = 0.5 if r == s else 1.0
                total += lg(m[r, s] + 1) - (m[r, s] + 1) * math.log(half * density * sizes[r] * sizes[s] + 1)
        return total

    k = int(g.max()) + 1 if n else 0
    sizes, kappa = np.bincount(g, minlength=k), np.bincount(g, degree, minlength=k)
    m = np.zeros((k, k))
    for v in range(n):
        np.add.at(m, (g[v], g[neighbours[v]]), 1.0)
    m[np.diag_indices(k)] /= 2
    prior = -math.log(n - 1) if n > 2 else 0.0
    out = []
    for sweep in range(sweeps):
        for _ in range(n):
            new = n < 3 or rng.integers(0, n - 1) == 0
            if (new and k == most) or (not new and k == 1):
                continue
            r = int(rng.integers(0, k))
            members = np.flatnonzero(g == r)
            if new and len(members) == 1:
                continue
            u = int(rng.choice(members))
            s = k if new else int(rng.integers(0, k - 1))
            s += not new and s >= r
            size2, kappa2, m2 = np.append(sizes, 0) if new else sizes.copy(), np.append(kappa, 0) if new else kappa.copy(), np.pad(m, (0, 1)) if new else m.copy()
            d = np.bincount(g[neighbours[u]], minlength=len(size2)).astype(float)
            size2[r] -= 1
            size2[s] += 1
            kappa2[r] -= degree[u]
            kappa2[s] += degree[u]
            for t in range(len(size2)):
                if t == r:
                    m2[r, r] -= d[r]
                    m2[r, s] += d[r]
                    m2[s, r] = m2[r, s]
                elif t == s:
                    m2[r, s] -= d[s]
                    m2[s, r] = m2[r, s]
                    m2[s, s] += d[s]
                else:
                    m2[r, t] -= d[t]
                    m2[t, r] = m2[r, t]
                    m2[s, t] += d[t]
                    m2[t, s] = m2[s, t]
            gone = size2[r] == 0
            g2 = None
            if gone:
                left = np.delete(np.arange(len(size2)), r)
                size2, kappa2, m2 = size2[left], kappa2[left], m2[np.ix_(left, left)]
                g2 = g.copy()
                g2[u] = s
                g2 = g2 - (g2 > r)
            every = list(range(k))
            before = parts(sizes, kappa, m, every if gone or new else [r, s])
            after = parts(size2, kappa2, m2, list(range(len(size2))) if gone or new else [r, s])
            change = after - before + (len(size2) - k) * prior
            # Proposal of this move, and of the one that undoes it.
            to_new, to_old = 1.0 / max(n - 1, 1), 1 - 1.0 / max(n - 1, 1)
            forth = (to_new if new else to_old / (k - 1)) / (k * len(members))
            k2 = len(size2)
            back_size = size2[s - (gone and s > r)]
            back = (to_new if gone else to_old / max(k2 - 1, 1)) / (k2 * back_size)
            if math.log(max(rng.random(), 1e-300)) < change + math.log(back / forth):
                if gone:
                    g = g2
                else:
                    g[u] = s
                sizes, kappa, m, k = size2, kappa2, m2, k2
        out.append((sweep, k, k * prior + parts(sizes, kappa, m, list(range(k)))))
        if states is not None:
            states.append((g.copy(), k))
    return out


def sample_blocks_heat(src: np.ndarray, dst: np.ndarray, n: int, sweeps: int, most: int, seed: int, states: list | None = None) -> list[tuple[int, int, float]]:
    """(sweep, groups, log probability) of the same kind of block model where groups may be empty; vertices move by heat bath.

    A move draws a vertex and gives it a group in proportion to the probability of the state that results. Before one move in n + 1 the
    number of groups may change: half of the time an empty group goes, otherwise one comes with probability groups / (n + groups). ``states``
    gets the groups of all vertices after each sweep.
    """
    rng = np.random.default_rng(seed)
    keep = src != dst
    src, dst = src[keep], dst[keep]
    order = np.argsort(src, kind="stable")
    neighbours = np.split(dst[order], np.cumsum(np.bincount(src, minlength=n))[:-1]) if n else []
    degree = np.array([len(x) for x in neighbours], int)
    density = degree.sum() / (n * n) if n else 0.0
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * degree.sum() + n + 2)))])
    g = rng.integers(0, most, n)
    k = most
    sizes, kappa = np.bincount(g, minlength=k), np.bincount(g, degree, minlength=k).astype(int)
    m = np.zeros((k, k), int)
    np.add.at(m, (g[src], g[dst]), 1)

    def own(size: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Of a group by itself; ``inner`` counts each inner link twice."""
        some = np.maximum(size, 1)
        value = factorials[size] + ends * np.log(some) + factorials[some - 1] - factorials[ends + some - 1]
        value = value + factorials[inner // 2] - (inner // 2 + 1) * np.log(0.5 * density * size * size + 1)
        return np.where(size > 0, value, 0.0)

    def cross(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return factorials[links] - (links + 1) * np.log(density * a * b + 1)

    def energy() -> float:
        upper = np.triu(cross(m, sizes[:, None], sizes[None, :]), 1).sum()
        return float(own(sizes, kappa, np.diag(m)).sum() + upper)

    value, out = energy() if n else 0.0, []
    for sweep in range(sweeps):
        for _ in range(n):
            if rng.random() * (n + 1) < 1:
                empty = np.flatnonzero(sizes == 0)
                if rng.random() < 0.5:
                    if len(empty):
                        gone = int(rng.choice(empty))
                        left = np.delete(np.arange(k), gone)
                        sizes, kappa, m, g, k = sizes[left], kappa[left], m[np.ix_(left, left)], g - (g > gone), k - 1
                elif rng.random() * (n + k) < k and k < most:
                    sizes, kappa, m, k = np.append(sizes, 0), np.append(kappa, 0), np.pad(m, (0, 1)), k + 1
            u = int(rng.integers(0, n))
            r, d, ends = int(g[u]), np.bincount(g[neighbours[u]], minlength=k), degree[u]
            every = np.arange(k)
            other = (every[:, None] != every[None, :]) & (every[None, :] != r)
            # A row for each group s that the vertex could go to: what the pairs of r and s with all third groups were and would be.
            thirds = cross(m[r] - d, sizes[r] - 1, sizes) - cross(m[r], sizes[r], sizes)
            change = np.where(other, thirds[None, :], 0.0).sum(axis=1)
            change += np.where(other, cross(m + d[None, :], sizes[:, None] + 1, sizes[None, :]) - cross(m, sizes[:, None], sizes[None, :]), 0.0).sum(axis=1)
            met = np.where(every == r, 0, m[r] + d[r] - d)
            change += cross(met, sizes[r] - 1, sizes + 1) - cross(m[r], sizes[r], sizes)
            change += own(sizes + 1, kappa + ends, np.diag(m) + 2 * d) - own(sizes, kappa, np.diag(m))
            change += own(sizes[r] - 1, kappa[r] - ends, m[r, r] - 2 * d[r]) - own(sizes[r], kappa[r], m[r, r])
            change[r] = 0.0
            share = np.cumsum(np.exp(change - change.max()))
            s = min(int(np.searchsorted(share, rng.random() * share[-1], side="right")), k - 1)
            if s != r:
                g[u] = s
                sizes[r], sizes[s] = sizes[r] - 1, sizes[s] + 1
                kappa[r], kappa[s] = kappa[r] - ends, kappa[s] + ends
                m[r] -= d
                m[:, r] -= d
                m[s] += d
                m[:, s] += d
                value += float(change[s])
        out.append((sweep, k, value))
        if states is not None:
            states.append((g.copy(), k))
    return out
