"""Suffix arrays of many short strings by induced sorting, and their permuted common prefixes.

The top level holds bytes and is induced bucket by bucket with array operations: all suffixes of a bucket that are
known take their predecessors along in one step. Levels below hold names of leftmost-smaller (LMS) substrings, whose
alphabet is large and whose length is a third at most; they are induced one by one.
"""

from __future__ import annotations

import numpy as np


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """L and S suffixes of each bucket in order, induced from LMS suffixes in the order given.

    Character 0 ends every string; ends are ordered by place.
    """
    chars = text[lms]
    order = np.argsort(chars, kind="stable")
    edges = np.searchsorted(chars[order], np.arange(width + 1))
    seeds = [lms[order[edges[c] : edges[c + 1]]] for c in range(width)]
    empty = np.empty(0, np.int32)

    def deal(found: np.ndarray, into: list[list[np.ndarray]]) -> None:
        c = text[found]
        if len(found) < 2 or c.min() == c.max():
            if len(found):
                into[int(c[0])].append(found)
            return
        by = np.argsort(c, kind="stable")
        found, c = found[by], c[by]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        for part in np.split(found, cuts):
            into[int(text[part[0]])].append(part)

    larger: list[list[np.ndarray]] = [[] for _ in range(width)]
    for c in range(width):
        k = 0
        while k < len(larger[c]):  # grows while suffixes of one bucket bring each other
            wave = larger[c][k:]
            k = len(larger[c])
            before = (np.concatenate(wave) if len(wave) > 1 else wave[0]) - 1
            before = before[before >= 0]
            deal(before[~is_s[before]], larger)
        if len(seeds[c]):
            before = seeds[c] - 1
            before = before[before >= 0]
            deal(before[~is_s[before]], larger)
    ls = [np.concatenate(x) if x else empty for x in larger]
    smaller: list[list[np.ndarray]] = [[] for _ in range(width)]  # from the bucket's end
    for c in range(width - 1, 0, -1):
        k = 0
        while k < len(smaller[c]):
            wave = smaller[c][k:]
            k = len(smaller[c])
            before = (np.concatenate(wave) if len(wave) > 1 else wave[0]) - 1
            before = before[before >= 0]
            deal(before[is_s[before]], smaller)
        if len(ls[c]):
            before = ls[c][::-1] - 1
            before = before[before >= 0]
            deal(before[is_s[before]], smaller)
    ss = [np.concatenate(x)[::-1] if x else empty for x in smaller]
    ss[0] = seeds[0]
    return ls, ss


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one."""
    step = np.sign(np.diff(text.astype(np.int32), append=np.int32(2**30)))  # the last end counts as smaller
    at = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def words8(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as one number; zeros follow the end."""
    padded = np.r_[text.astype(np.uint8), np.zeros(8, np.uint8)]
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)].astype(np.uint64)
    return out


def common(text8: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    done, n = 0, len(text8)
    while len(live) and done < most:
        x, y = a[live] + done, b[live] + done
        ok = np.maximum(x, y) < n
        live, x, y = live[ok], x[ok], y[ok]
        differ = text8[x] ^ text8[y]
        same = differ == 0
        top = np.zeros(len(live), np.int64)
        rest = differ[~same]
        lead = np.zeros(len(rest), np.int64)
        for bits in (32, 16, 8):
            high = rest >> np.uint64(64 - bits) == 0
            lead += np.where(high, bits // 8, 0)
            rest = np.where(high, rest << np.uint64(bits), rest)
        top[~same] = lead
        top[same] = 8
        out[live] += top
        live = live[same]
        done += 8
    return np.minimum(out, most)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes of ``text``: small non-negative numbers, 0 ending each string, the last one too."""
    n, width = len(text), int(text.max()) + 1
    is_s = _types(text)
    is_lms = is_s.copy()
    is_lms[1:] &= ~is_s[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms).astype(np.int32)
    _, ss = _induce(text, is_s, lms, width)
    ordered = np.concatenate(ss)
    ordered = ordered[is_lms[ordered]]
    length = np.zeros(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (length[a] > 0) & (text[a] > 0)
    ends = np.zeros(n, bool)  # substrings up to an end are like no other
    ends[lms[:-1]] = text[lms[1:]] == 0
    same &= ~ends[a] & ~ends[b]
    check = np.flatnonzero(same)
    text8 = words8(text)
    long = int(length[a[check]].max()) if len(check) else 0
    same[check] = common(text8, a[check].astype(np.int64), b[check].astype(np.int64), max(8, long)) >= length[a[check]]
    names = np.zeros(n, np.int32)
    names[ordered] = np.r_[0, np.cumsum(~same)]
    reduced = names[lms]
    if int(reduced.max()) + 1 < len(reduced):
        order = np.array(_sorted_names(reduced.tolist()), np.int64)
    else:
        order = np.argsort(reduced, kind="stable")
    ls, ss = _induce(text, is_s, lms[order], width)
    return np.concatenate([x for c in range(width) for x in (ls[c], ss[c])])


def _sorted_names(s: list[int]) -> list[int]:
    """The suffix array of a list of numbers, by induced sorting; the end of the list counts as smallest."""
    n, width = len(s), max(s) + 1
    if n < 3:
        return sorted(range(n), key=lambda i: s[i:])
    small = [False] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or s[i] == s[i + 1] and small[i + 1]
    sizes = [0] * width
    for c in s:
        sizes[c] += 1
    heads, tails, total = [0] * width, [0] * width, 0
    for c in range(width):
        heads[c] = total
        total += sizes[c]
        tails[c] = total
    after_l = [False, *(not x for x in small[:-1]), False]  # the last is for places not filled yet, which hold -1
    after_s = [False, *small[:-1], False]
    is_lms = [x and y for x, y in zip(small, after_l)]
    lms = [i for i, x in enumerate(is_lms) if x]

    def induce(seeds: list[int]) -> list[int]:
        out, tail = [-1] * n, tails[:]
        for i in reversed(seeds):
            c = s[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = heads[:]
        c = s[-1]
        out[head[c]] = n - 1
        head[c] += 1
        for i in out:  # sees what the loop itself fills in
            if after_l[i]:
                c = s[i - 1]
                out[head[c]] = i - 1
                head[c] += 1
        tail = tails[:]
        for i in reversed(out):
            if after_s[i]:
                c = s[i - 1]
                tail[c] -= 1
                out[tail[c]] = i - 1
        return out

    if not lms:
        return induce([])
    stop = [0] * n
    for i, j in zip(lms, lms[1:]):
        stop[i] = j + 1
    name, names, last = -1, [0] * n, None
    for i in induce(lms):
        if is_lms[i]:
            piece = s[i : stop[i]]  # empty for the last one, which is like no other
            if not piece or piece != last:
                name += 1
            names[i], last = name, piece
    below = [names[i] for i in lms]
    if name + 1 < len(lms):
        order = _sorted_names(below)
    else:
        order = [0] * len(lms)
        for k, c in enumerate(below):
            order[c] = k
    return induce([lms[k] for k in order])


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one sorted before it, up to ``most``.

    Permuted to text order the lengths fall by one from place to place wherever the characters before agree; only the
    others are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    here = np.arange(n)
    carried = np.zeros(n, bool)
    ok = (here > 0) & (before > 0)
    carried[ok] = (text[here[ok] - 1] == text[before[ok] - 1]) & (before[here[ok] - 1] == before[ok] - 1)
    start = np.flatnonzero(~carried)
    lcp = np.zeros(len(start), np.int64)
    some = before[start] >= 0
    limit = most + 256
    lcp[some] = common(words8(text), start[some], before[start[some]], limit)
    run = np.cumsum(~carried) - 1
    fallen = here - start[run]
    out = lcp[run] - fallen
    cut = np.flatnonzero((lcp[run] >= limit) & (out < most) & (before >= 0))  # a long match that was not measured to its end
    out[cut] = common(words8(text), cut, before[cut], most) if len(cut) else 0
    return np.clip(out, 0, most)
