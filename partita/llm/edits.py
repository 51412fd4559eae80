"""Edit distances of many pairs of letter sequences at once, bit-parallel and within bands."""

from __future__ import annotations

import numpy as np

#: Rows of a block; pairs, cells of the letters and words of the masks that a batch may have. Fewer pairs than _FEW are dealt with one by one.
_BITS, _PAIRS, _CELLS, _MASKS, _FEW = 64, 1500, 2_000_000, 4_000_000, 16
_ALL, _TOP, _ONE = np.uint64(2**64 - 1), np.uint64(63), np.uint64(1)


def _numbers(arrays: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different objects of a list, and which of them each entry is."""
    seen: dict[int, int] = {}
    of = np.array([seen.setdefault(id(v), len(seen)) for v in arrays])
    first = np.zeros(len(seen), dtype=np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    return [arrays[i] for i in first], of


def _batch(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """edits_within for pairs whose first sequence is not empty and not the longer one, with lengths that differ by `most` at the most.

    Both get the same letters put before them, so that all first sequences fill the same blocks: that changes no distance.
    Blocks lie a column behind each other, so a step moves all of them: what one hands down is there when the next needs it.
    A path of at most `most` edits strays from the diagonal by half of them, which bounds the blocks of a step.
    """
    pairs = len(xs)
    (xs, of), (ys, other) = _numbers(xs), _numbers(ys)
    m, n = (np.fromiter(map(len, v), dtype=np.int64, count=len(v)) for v in (xs, ys))
    x, y = np.concatenate(xs), np.concatenate(ys)
    there = np.zeros(int(max(x.max(), y.max())) + 1, dtype=bool)
    there[x] = True
    number = np.where(there, np.cumsum(there) + 1, 0)  # 0: not in any first sequence, 1: what is put before
    letters, blocks = int(there.sum()) + 2, -(-int(m.max()) // _BITS)
    if blocks * len(xs) * letters > _MASKS and pairs > 1:
        half, (a, b) = pairs // 2, ([xs[k] for k in of], [ys[k] for k in other])
        return np.concatenate([_batch(a[:half], b[:half], most[:half]), _batch(a[half:], b[half:], most[half:])])
    before = blocks * _BITS - m
    masks = np.zeros((blocks, len(xs), letters), dtype=np.uint64)
    owner = np.repeat(np.arange(len(xs)), m)
    at = np.arange(len(x)) - np.repeat(np.cumsum(m) - m - before, m)
    np.add.at(masks.reshape(-1), ((at >> 6) * len(xs) + owner) * letters + number[x], _ONE << (at & 63).astype(np.uint64))
    full = np.clip(before - _BITS * np.arange(blocks)[:, None], 0, _BITS)
    masks[:, :, 1] = np.where(full == _BITS, _ALL, (_ONE << (full % _BITS).astype(np.uint64)) - _ONE)
    masks = masks.reshape(-1)
    before, size = before[of], n[other]
    width = before + size
    columns, apart = int(width.max()), size - m[of]
    text = np.zeros((pairs, columns), dtype=np.int64)
    coded = np.split(number[y], np.cumsum(n)[:-1])
    for row, k, a, b in zip(text, other.tolist(), before.tolist(), width.tolist(), strict=True):
        row[:a] = 1
        row[a:b] = coded[k]
    text += of[:, None] * letters
    text = np.ascontiguousarray(text.T)
    shift = (np.arange(blocks) * (len(xs) * letters))[:, None]
    left, right = int(((most - apart) // 2).max()), int(((most + apart) // 2).max())

    done, ends = np.zeros(pairs, dtype=bool), width + blocks - 2  # the step that ends each pair
    steps, was = set(ends.tolist()), 0
    up, down = np.full((blocks, pairs), _ALL), np.zeros((blocks, pairs), dtype=np.uint64)
    plus, minus = (np.zeros((2, blocks + 1, pairs), dtype=np.uint64) for _ in range(2))
    plus[:, 0] = 1
    value = np.full(pairs, _BITS)  # at the bottom of the last block that has begun
    for s in range(columns + blocks - 1):
        lo = max(0, s - columns + 1, -((63 + right - s) // 65))
        hi = min(blocks - 1, s, (s + left) // 65)
        p0, m0, p1, m1 = plus[s & 1], minus[s & 1], plus[1 - (s & 1)], minus[1 - (s & 1)]
        if hi > was:
            value += _BITS - p0[hi].view(np.int64) + m0[hi].view(np.int64)
            was = hi
        pv, mv, hp, hm = up[lo : hi + 1], down[lo : hi + 1], p0[lo : hi + 1], m0[lo : hi + 1]
        eq = masks.take(text[s - hi : s - lo + 1][::-1] + shift[lo : hi + 1])
        xv = eq | mv
        eq |= hm
        xh = eq & pv
        xh += pv
        xh ^= pv
        xh |= eq
        ph = xh | pv
        np.invert(ph, out=ph)
        ph |= mv
        xh &= pv
        np.right_shift(ph, _TOP, out=p1[lo + 1 : hi + 2])
        np.right_shift(xh, _TOP, out=m1[lo + 1 : hi + 2])
        ph <<= _ONE
        ph |= hp
        xh <<= _ONE
        xh |= hm
        np.bitwise_and(ph, xv, out=mv)
        ph |= xv
        np.invert(ph, out=ph)
        np.bitwise_or(ph, xh, out=pv)
        p1[lo], m1[lo] = 1, 0  # above the band a column is worth one more than the one before
        value += p1[hi + 1].view(np.int64)
        value -= m1[hi + 1].view(np.int64)
        if s in steps:
            now = ends == s
            done[now] = value[now] <= most[now]
    return done


def _single(s: np.ndarray, t: np.ndarray, most: int) -> bool:
    """edits_within for one pair, with whole numbers of Python as masks; s is not empty."""
    peq: dict[int, int] = {}
    for i, c in enumerate(s.tolist()):
        peq[c] = peq.get(c, 0) | 1 << i
    full, last, score = (1 << len(s)) - 1, 1 << (len(s) - 1), len(s)
    up, down = full, 0
    for left, c in zip(range(len(t) - 1, -1, -1), t.tolist(), strict=True):
        eq = peq.get(c, 0)
        over = eq | down
        eq |= ((eq & up) + up) ^ up
        h_up = down | (~(eq | up) & full)
        h_down = up & eq
        if h_up & last:
            score += 1
        elif h_down & last:
            score -= 1
        h_up = (h_up << 1 | 1) & full
        up = ((h_down << 1) & full) | (~(over | h_up) & full)
        down = h_up & over
        if score - left > most:
            return False
    return score <= most


def edits_within(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of letter sequences (arrays of code points) is at most its number `most`, exactly.

    Pairs of like lengths are dealt with together; sequences that are the same object are prepared once.
    """
    most = np.asarray(most, dtype=np.int64)
    turned = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(xs, ys, strict=True)]
    m, n = (np.array([len(p[k]) for p in turned], dtype=np.int64) for k in (0, 1))
    out = (n <= most) & (n - m <= most)
    rest = np.flatnonzero((n - m <= most) & (n > most))  # the shorter one is not empty
    rest = rest[np.lexsort((n[rest], m[rest]))]
    start = 0
    while start < len(rest):
        first = int(m[rest[start]])
        near, far = (int(np.searchsorted(m[rest], top + _BITS // 2, side="right")) for top in (first + first // 6, 2 * first))
        stop = max(near, min(far, start + _PAIRS // 2))  # a step over few pairs costs as much as one over some hundreds
        stop = min(stop, start + max(_CELLS // (int(m[rest[stop - 1]]) * 5 // 4 + _BITS), 1))
        now = rest[start:stop]
        now = now[np.argsort((n - m)[now], kind="stable")]  # like differences of length have narrow bands
        for part in np.array_split(now, -(-len(now) // _PAIRS)):
            if len(part) < _FEW:
                out[part] = [_single(*turned[i], most[i]) for i in part]
            else:
                out[part] = _batch([turned[i][0] for i in part], [turned[i][1] for i in part], most[part])
        start = stop
    return out
