"""The planar arrangements of the segments within cells: nodes, faces with their winding numbers, boundaries.

Coordinates are whole numbers relative to a cell's south-west corner. Those of nodes are odd; the sides of a cell lie
at 0 and ``size``, both even, and only points where segments were cut at a side have one coordinate there. So no node
lies on a side by chance, and rounding leads across none.

Many cells are solved at once: each is moved east by its number times twice the size, so that no two of them meet, and
every step is one of arrays over all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Rounds of noding; rounded crossings may bring about new ones, which are fewer every time.
ROUNDS = 12
#: Pairs that are compared at once.
PAIRS = 1 << 20


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, number): rows in order, where each distinct one begins in that order, and the number of each row's."""
    order = np.lexsort(rows.T[::-1])
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after another."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)


def portions(count: np.ndarray, most: int = PAIRS) -> Iterator[tuple[int, int]]:
    """Ranges of things with ``count`` pairs each that have about ``most`` together."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _merged(e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct segments (ax, ay, bx, by), smaller end first, with the sums of their windings; those without any go."""
    keep = (e[:, :2] != e[:, 2:]).any(1)
    e, n = e[keep], n[keep]
    if not len(e):
        return e, n
    back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e[back] = e[back][:, [2, 3, 0, 1]]
    n[back] *= -1
    order, first, _ = distinct(e)
    e, total = e[order[first]], np.add.reduceat(n[order], first, axis=0)
    some = (total != 0).any(1)
    return e[some], total[some]


def _candidates(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of boxes of two lists that meet; by x through sorted starts, by y through a test."""
    order = np.argsort(low2[:, 0], kind="stable")
    starts = low2[order, 0]
    widest = int((high2[:, 0] - low2[:, 0]).max(initial=0))
    first = np.searchsorted(starts, low[:, 0] - widest, "left")
    count = np.searchsorted(starts, high[:, 0], "right") - first
    ends = np.cumsum(count)
    at = 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(at, to), count[at:to])
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to]) + np.repeat(first[at:to], count[at:to])]
        ok = (low2[j, 0] <= high[i, 0]) & (low[i, 0] <= high2[j, 0]) & (low2[j, 1] <= high[i, 1]) & (low[i, 1] <= high2[j, 1])
        yield i[ok], j[ok]
        at = to


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _marks(e: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point): where edges have to be split: at crossings, rounded, and at nodes nearer than one unit."""
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    edges, points = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
    for i, j in _candidates(low, high, low, high):
        i, j = i[i < j], j[i < j]
        p, r, q, s = e[i, :2], e[i, 2:] - e[i, :2], e[j, :2], e[j, 2:] - e[j, :2]
        det, t, u = _cross(r, s), _cross(q - p, s), _cross(q - p, r)
        sign = np.sign(det)
        hit = (det != 0) & (t * sign > 0) & (t * sign < det * sign) & (u * sign > 0) & (u * sign < det * sign)
        p = p[hit]
        east = p * (1, 0) // (2 * size) * (2 * size)  # digits of the place within the cell are not to be lost
        where = p - east + r[hit] * (t[hit] / det[hit])[:, None]
        where = (np.rint((where - 1) / 2) * 2 + 1).astype(np.int64) + east
        edges += [i[hit], j[hit]]
        points += [where, where]
    ends = np.concatenate([e[:, :2], e[:, 2:]])
    order, first, _ = distinct(ends)
    nodes = ends[order[first]]
    for i, j in _candidates(low - 1, high + 1, nodes, nodes):
        p, r, q = e[i, :2], e[i, 2:] - e[i, :2], nodes[j] - e[i, :2]
        length, along = (r * r).sum(1).astype(float), (q * r).sum(1).astype(float)
        near = (np.abs(_cross(r, q).astype(float)) < np.sqrt(length)) & (along > 0) & (along < length)
        edges.append(i[near])
        points.append(nodes[j[near]])
    edge, point = np.concatenate(edges), np.concatenate(points)
    new = (point != e[edge, :2]).any(1) & (point != e[edge, 2:]).any(1)
    return edge[new], point[new]


def noded(e: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments (ax, ay, bx, by) with windings, split until no two meet but at their ends; equal ones are one."""
    e, n = _merged(e, n)
    for _ in range(ROUNDS):
        edge, point = _marks(e, size)
        if not len(edge):
            break
        along = ((point - e[edge, :2]) * (e[edge, 2:] - e[edge, :2])).sum(1)
        every = np.arange(len(e))
        which = np.concatenate([every, edge, every])
        place = np.concatenate([np.full(len(e), -(2**62)), along, np.full(len(e), 2**62)])
        at = np.concatenate([e[:, :2], point, e[:, 2:]])
        order = np.lexsort((place, which))
        which, at = which[order], at[order]
        same = which[:-1] == which[1:]
        e, n = _merged(np.hstack([at[:-1], at[1:]])[same], n[which[:-1][same]])
    return e, n


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the smallest one that links (a, b) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _frames(e: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sides, corners): the sides of all cells that have segments, split at the nodes on them, and their south-west corners."""
    far = 2 * size
    nodes = np.concatenate([e[:, :2], e[:, 2:]])
    cells = np.unique(nodes[:, 0] // far)
    cell, place = nodes[:, 0] // far, np.stack([nodes[:, 0] % far, nodes[:, 1]], 1)
    sides = []
    for axis, value in ((1, 0), (0, size), (1, size), (0, 0)):
        here = place[:, axis] == value
        on = np.concatenate([np.stack([cell[here], place[here, 1 - axis]], 1), *(np.stack([cells, np.full(len(cells), v)], 1) for v in (0, size))])
        order, first, _ = distinct(on)
        on = on[order[first]]
        line = np.empty((len(on), 2), np.int64)
        line[:, axis], line[:, 1 - axis] = value, on[:, 1]
        line[:, 0] += on[:, 0] * far
        sides.append(np.hstack([line[:-1], line[1:]])[on[:-1, 0] == on[1:, 0]])
    return np.concatenate(sides), np.stack([cells * far, np.zeros_like(cells)], 1)


def _west(e: np.ndarray, nodes: np.ndarray, islands: np.ndarray, size: int) -> np.ndarray:
    """The first segment west of each node in ``islands``, at its height or just above; the frame is there if nothing else is."""
    far = 2 * size
    first = np.searchsorted(e[:, 0], nodes[islands, 0] // far * far, "left")
    count = np.searchsorted(e[:, 0], nodes[islands, 0], "left") - first
    ends = np.cumsum(count)
    hit = np.empty(len(islands), np.int64)
    at = 0
    while at < len(islands):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        i, j = np.repeat(np.arange(at, to), count[at:to]), runs(first[at:to], count[at:to])
        y = nodes[islands[i], 1]
        ok = (np.minimum(e[j, 1], e[j, 3]) <= y) & (y < np.maximum(e[j, 1], e[j, 3]))
        i, j, y = i[ok], j[ok], y[ok]
        run, rise = e[j, 2] - e[j, 0], e[j, 3] - e[j, 1]
        x = e[j, 0] % far + run * ((y - e[j, 1]) / rise)
        ok = x < nodes[islands[i], 0] % far
        order = np.lexsort(((run / rise)[ok], x[ok], i[ok]))  # of those that leave one node upwards the last one
        hit[i[ok][order]] = j[ok][order]
        at = to
    return hit


def _wound(face: np.ndarray, twin: np.ndarray, inner: np.ndarray, delta: np.ndarray, seeds: np.ndarray, base: np.ndarray, same: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Windings of faces, from the ``seeds`` with windings ``base`` on over inner half-edges and between faces that are the same."""
    h = np.flatnonzero(inner)
    none = np.zeros((len(same[0]), delta.shape[1]), np.int64)
    origin, to, less = np.concatenate([face[h], *same]), np.concatenate([face[twin[h]], *same[::-1]]), np.concatenate([delta[h], none, none])
    order = np.argsort(origin, kind="stable")
    to, less = to[order], less[order]
    first = np.searchsorted(origin[order], np.arange(len(face) + 1))
    wound, known = np.zeros((len(face), delta.shape[1]), np.int64), np.zeros(len(face), bool)
    wound[seeds], known[seeds] = base, True
    while len(seeds):
        count = first[seeds + 1] - first[seeds]
        over, near = runs(first[seeds], count), np.repeat(seeds, count)
        new = ~known[to[over]]
        over, near = over[new], near[new]
        wound[to[over]] = wound[near] - less[over]
        known[to[over]] = True
        seeds = np.unique(to[over])
    return wound


def chained(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, member, closed): things in the order in which each leads to the next (-1: to none), a line after another."""
    n = len(after)
    led = np.zeros(n, bool)
    led[after[after >= 0]] = True
    lines, members, left = [], [], np.ones(n, bool)
    lines_before, closed = 0, []
    for shut in (False, True):
        if shut:  # rings begin with their least one
            least = jump = np.arange(n)
            jump = np.where(left, after, jump)
            while True:
                less = np.minimum(least, least[jump])
                if (less == least).all():
                    break
                least, jump = less, jump[jump]
            at = np.flatnonzero(left & (least == np.arange(n)))
        else:
            at = np.flatnonzero(~led)
        of = np.arange(len(at)) + lines_before
        lines_before += len(at)
        closed.append(np.full(len(at), shut))
        while len(at):
            left[at] = False
            lines.append(of)
            members.append(at)
            on = after[at]
            more = (on >= 0) & left[on]
            at, of = on[more], of[more]
    line, member = np.concatenate([np.empty(0, np.int64), *lines]), np.concatenate([np.empty(0, np.int64), *members])
    order = np.argsort(line, kind="stable")
    return line[order], member[order], np.concatenate(closed)


Boundaries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def boundaries(e: np.ndarray, n: np.ndarray, cell: np.ndarray, size: int, base: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]) -> Boundaries:
    """(cell, closed, length, points): the directed lines within cells that have the inside on their left, and only there.

    ``cell`` numbers the cell of each segment from 0, ``base`` is the winding at each cell's south-west corner, ``inside``
    tells windings (one row a face) that are inside. Points of all lines follow each other, ``length`` of them a line. A
    line that is not closed goes on in another cell.
    """
    return several_boundaries(e, n, cell, size, base, [inside])[0]


def several_boundaries(e: np.ndarray, n: np.ndarray, cell: np.ndarray, size: int, base: np.ndarray, insides: list[Callable[[np.ndarray], np.ndarray]]) -> list[Boundaries]:
    """``boundaries`` of several insides, from one arrangement."""
    far = 2 * size
    e, n = noded(e + cell[:, None] * np.array([far, 0, far, 0]), n.copy(), size)
    if not len(e):
        return [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty((0, 2), np.int64))] * len(insides)
    sides, corners = _frames(e, size)
    both = np.concatenate([e, sides])
    order, start, of = distinct(both)
    e, m = both[order[start]], len(start)
    summed = np.zeros((m, n.shape[1]), np.int64)
    summed[of[: len(n)]] = n
    framed = np.zeros(2 * m, bool)
    framed[of[len(n) :]] = True
    framed[m:] = framed[:m]
    both = np.concatenate([e[:, :2], e[:, 2:]])
    order, start, tail = distinct(both)
    nodes = both[order[start]]
    head = np.concatenate([tail[m:], tail[:m]])
    step = nodes[head] - nodes[tail]
    twin = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    delta = np.concatenate([summed, -summed])
    angle = np.arctan2(step[:, 1].astype(float), step[:, 0].astype(float))
    order = np.lexsort((angle, tail))
    place = np.empty(2 * m, np.int64)
    place[order] = np.arange(2 * m)
    first = np.searchsorted(tail[order], np.arange(len(nodes) + 1))
    at = place[twin]
    start, stop = first[tail[twin]], first[tail[twin] + 1]
    follow = order[np.where(at == start, stop - 1, at - 1)]  # clockwise from the way back: the face on the left
    face = np.arange(2 * m)
    jump = follow
    while True:
        least = np.minimum(face, face[jump])
        if (least == face).all():
            break
        face, jump = least, jump[jump]
    part = least_labels(len(nodes), tail[:m], head[:m])  # a part's label is its smallest node, and so its leftmost and lowest
    corner = np.searchsorted(nodes[:, 0], corners[:, 0], "left")  # the smallest node of a cell
    eastwards = order[first[corner]]
    islands = np.setdiff1d(part, corner)
    hit = _west(e, nodes, islands, size)
    up = np.where(e[hit, 3] > e[hit, 1], hit, hit + m)
    west = order[first[islands + 1] - 1]  # the largest angle: west of it is outside the part
    wound = _wound(face, twin, ~framed, delta, face[eastwards], base[corners[:, 0] // far], (face[west], face[twin[up]]))
    # beyond a side of the cell there is what the side's own winding says
    outer = np.zeros(2 * m, bool)
    outer[face[twin[eastwards]]] = True
    left = np.where(outer[face][:, None], wound[face[twin]] + delta, wound[face])
    out = []
    for inside in insides:
        edge = inside(left) & ~inside(left - delta)
        begun = np.flatnonzero(edge)
        on = follow[begun]
        turning = np.flatnonzero(~edge[on] & (on != twin[begun]))
        while len(turning):
            on[turning] = follow[twin[on[turning]]]
            turning = turning[~edge[on[turning]] & (on[turning] != twin[begun[turning]])]
        number = np.full(2 * m, -1)
        number[begun] = np.arange(len(begun))
        line, member, closed = chained(number[on])
        heads = head[begun[member]]
        new = np.flatnonzero(np.diff(line, prepend=-1))
        points = nodes[np.insert(heads, new, tail[begun[member[new]]])]
        length = np.diff(new, append=len(line)) + 1
        where = points[np.cumsum(length) - length, 0] // far
        points[:, 0] -= np.repeat(where, length) * far
        out.append((where, closed, length, points))
    return out
