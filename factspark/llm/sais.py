"""Suffix arrays by induced sorting, and which windows of a shard repeat, by permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the next one). s ends with a unique smallest symbol."""
    n = len(s)
    less = np.zeros(n, bool)
    less[:-1] = s[:-1] < s[1:]
    less[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = s[:-1] != s[1:]
    # a run of equal symbols has the type of its end
    end = np.where(differs, np.arange(n), n)
    return less[np.minimum.accumulate(end[::-1])[::-1]]


def _induce_bytes(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS suffixes in the given order. A bucket's entries are handled as arrays: what they
    induce goes to other buckets, or, within the same bucket, makes the next wave."""
    k = len(bounds) - 1
    sa = np.full(len(s), -1, np.int64)
    start, stop = bounds[:-1], bounds[1:]
    by = np.argsort(s[lms], kind="stable")
    many = np.bincount(s[lms], minlength=k)
    sa[np.repeat(stop - many, many) + np.arange(len(lms)) - np.repeat(np.cumsum(many) - many, many)] = lms[by]
    head = start.copy()

    def put(p: np.ndarray, at: np.ndarray, up: bool) -> None:
        c = s[p]
        order = np.argsort(c, kind="stable")
        c, n = c[order], np.bincount(c, minlength=k)
        nth = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        sa[at[c] + nth if up else at[c] - 1 - nth] = p[order]
        at += n if up else -n

    for c in np.flatnonzero(stop > start):
        low = start[c]
        while low < head[c]:
            j, low = sa[low : head[c]], head[c]
            p = j[j > 0] - 1
            if len(p := p[~stype[p]]):
                put(p, head, True)
        if many[c]:
            j = sa[stop[c] - many[c] : stop[c]]
            p = j[j > 0] - 1
            if len(p := p[~stype[p]]):
                put(p, head, True)
    tail = stop.copy()
    for c in np.flatnonzero(stop > start)[::-1]:
        high = stop[c]
        while high > tail[c]:
            j, high = sa[tail[c] : high][::-1], tail[c]
            p = j[j > 0] - 1
            if len(p := p[stype[p]]):
                put(p, tail, False)
        if head[c] > start[c]:
            j = sa[start[c] : head[c]][::-1]
            p = j[j > 0] - 1
            if len(p := p[stype[p]]):
                put(p, tail, False)
    sa[0] = len(s) - 1
    return sa


def _induce_names(s: list[int], stype: list[bool], lms: list[int], bounds: list[int]) -> list[int]:
    """The same over a large alphabet, one suffix at a time."""
    n = len(s)
    sa = [-1] * n
    tail = bounds[1:]
    for i in reversed(lms):
        c = s[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = bounds[:-1]
    for j in sa:
        if j > 0 and not stype[j - 1]:
            c = s[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = bounds[1:]
    for i in range(n - 1, -1, -1):
        j = sa[i]
        if j > 0 and stype[j - 1]:
            c = s[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    sa[0] = n - 1
    return sa


def _sorted(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of s, over symbols below k, that ends with a unique 0."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy() if n == 2 else np.arange(n)
    stype = _types(s)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=k))])
    is_lms = np.zeros(n, bool)
    is_lms[1:] = stype[1:] & ~stype[:-1]
    lms = np.flatnonzero(is_lms)
    if k <= 1024:
        induce = lambda order: _induce_bytes(s, stype, order, bounds)
    else:
        as_list, types, ends = s.tolist(), stype.tolist(), bounds.tolist()
        induce = lambda order: np.array(_induce_names(as_list, types, order.tolist(), ends), np.int64)
    sa = induce(lms)
    if len(lms) < 2:
        return sa
    order = sa[is_lms[np.maximum(sa, 0)] & (sa >= 0)]
    size = np.ones(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    left, at = np.flatnonzero(same), 0
    while len(left):
        differ = s[a[left] + at] != s[b[left] + at]
        same[left[differ]] = False
        at += 1
        left = left[~differ]
        left = left[size[a[left]] > at]
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(lms):
        name_of = np.zeros(n, np.int64)
        name_of[order] = names
        order = lms[_sorted(name_of[lms], int(names[-1]) + 1)]
    return induce(order)


def suffix_array(data: bytes | np.ndarray) -> np.ndarray:
    s = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    # two-byte symbols: numpy sorts these by radix, longer ones by comparison
    return _sorted(np.append(s.astype(np.uint16) + np.uint16(1), np.uint16(0)), 257)[1:]


def repeated_windows(contents: list[bytes], weights: list[int], width: int) -> list[np.ndarray]:
    """For each content, whether the window of `width` bytes at each start occurs again among all windows of all contents; a
    content of weight 2 or more stands for as many equal ones."""
    size = np.array([len(c) for c in contents], np.int64)
    s = np.frombuffer(b"".join(contents), np.uint8)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(contents)), size)
    left = np.repeat(first + size, size) - np.arange(len(s))
    valid = left >= width
    order = suffix_array(s)
    order = order[valid[order]]
    again = valid & (np.array(weights)[owner] > 1)
    if len(order) > 1:
        before = np.full(len(s) + 1, -2, np.int64)
        before[order[1:]] = order[:-1]
        at = np.sort(order[1:])
        # a window whose predecessor is one on from the predecessor of the window before it shares one byte less
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (before[at[1:]] != before[at[:-1]] + 1) | (owner[at[1:]] != owner[at[:-1]])
        new[1:] |= owner[before[at[1:]]] != owner[before[at[:-1]]]
        i, j = at[new], before[at[new]]
        most = np.minimum(left[i], left[j])
        common = np.zeros(len(i), np.int64)
        w = np.lib.stride_tricks.sliding_window_view(np.concatenate([s, np.zeros(8, np.uint8)]), 8).copy().view("<u8")[:, 0]
        on, step = np.arange(len(i)), 0
        while len(on):
            same = w[i[on] + step] == w[j[on] + step]
            stop = on[~same]
            x = w[i[stop] + step] ^ w[j[stop] + step]
            low = (x & (~x + np.uint64(1))).astype(np.float64)
            common[stop] = step + (np.log2(low).astype(np.int64) // 8)
            on, step = on[same], step + 8
            full = most[on] <= step
            common[on[full]] = step
            on = on[~full]
        common = np.minimum(common, most)
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        nth = np.cumsum(new) - 1
        shared = common[nth] - (at - at[start])
        hit = at[shared >= width]
        again[hit] = True
        again[before[hit]] = True
    return [again[f : f + n] for f, n in zip(first.tolist(), size.tolist(), strict=True)]
