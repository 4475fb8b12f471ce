"""Small NumPy helpers used inside Arrow tasks: sequential algorithms no SQL expression covers."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence

import numpy as np


def lcs_length(left: list, right: list) -> int:
    """Longest common subsequence, one big-integer row of bits per token of ``right``."""
    masks: dict = {}
    for position, token in enumerate(left):
        masks[token] = masks.get(token, 0) | (1 << position)
    full = (1 << len(left)) - 1
    row = full
    for start in range(0, len(right), 64):      # carries above the row are cut off now and then
        for token in right[start:start + 64]:
            if token in masks:
                match = row & masks[token]
                row = (row + match) | (row ^ match)
        row &= full
    return len(left) - row.bit_count()


def lcs_lengths(codes: np.ndarray, lists: np.ndarray, rows: int, cells: int = 4_000_000) -> np.ndarray:
    """``lcs_length`` of list ``i`` and list ``rows + i``, for every i; ``codes`` are the tokens of all lists one after another.

    Rows of like size walk together: their bits stand side by side in one integer, with spare bits between for the carries.
    """
    lengths = np.bincount(lists, minlength=2 * rows)
    ends = np.cumsum(lengths)
    sizes = list(zip(lengths[:rows].tolist(), lengths[rows:].tolist()))
    order = sorted((i for i, size in enumerate(sizes) if min(size)), key=lambda i: (sum(sizes[i]), sizes[i]))
    out, start = np.zeros(rows, dtype=np.int64), 0
    while start < len(order):
        end, n, m, tokens = start, 0, 0, 0
        while end < len(order):
            i, j = sizes[order[end]]
            wide, high = max(n, i), max(m, j)
            if end > start and ((tokens + i + j) * (wide // 8 + 2) > 4 * cells or (end - start + 1) * high > cells
                                or wide > 1.25 * sizes[order[start]][0] + 16 or high > 1.25 * sizes[order[start]][1] + 16):
                break
            n, m, tokens, end = wide, high, tokens + i + j, end + 1
        some, start = order[start:end], end
        parts = [[codes[ends[at] - lengths[at]:ends[at]] for at in side] for side in (some, [rows + at for at in some])]
        if len(some) < 4:
            out[some] = [lcs_length(left.tolist(), right.tolist()) for left, right in zip(*parts)]
            continue
        place = [np.concatenate([np.arange(len(x)) for x in side]) for side in parts]
        row = [np.repeat(np.arange(len(some)), [len(x) for x in side]) for side in parts]
        flat = np.concatenate([*parts[0], *parts[1]])
        which, size = numbered((np.concatenate(row) << int(flat.max()).bit_length()) | flat)
        width = n // 8 + 2                                         # eight spare bits at least: each step may leave one more
        masks = np.zeros((size + 1) * width, dtype=np.uint8)      # of every (row, token); the last one has no bit
        np.bitwise_or.at(masks, which[:len(row[0])] * width + (place[0] >> 3), np.left_shift(1, place[0] & 7).astype(np.uint8))
        steps = np.full((m, len(some)), size)
        steps[place[1], row[1]] = which[len(row[0]):]
        masks = masks.reshape(-1, width)
        full = int.from_bytes((b"\xff" * (width - 1) + b"\0") * len(some), "little")
        bits = full
        for begin in range(0, m, 8):
            for step in steps[begin:begin + 8]:
                match = bits & int.from_bytes(masks[step].tobytes(), "little")
                bits = (bits + match) | (bits ^ match)
            bits &= full
        left = np.frombuffer((bits ^ full).to_bytes(width * len(some), "little"), dtype=np.uint8).reshape(len(some), width)
        out[some] = np.bitwise_count(left).sum(axis=1)
    return out


def in_order(keys: np.ndarray, bits: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and the places they come from.

    A key and its place are sorted as one integer of ``bits`` bits, which is several times faster than sorting places; larger keys go the slower way.
    """
    low = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (bits - low):
        place = np.argsort(keys, kind="stable")
        return keys[place], place
    packed = np.sort((keys << low) | np.arange(len(keys)))
    return packed >> low, packed & ((1 << low) - 1)


def numbered(keys: np.ndarray, bits: int = 63) -> tuple[np.ndarray, int]:
    """Numbers of equal keys (0, 1, ...) in the order of the keys, and how many there are."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), 0
    key, place = in_order(keys, bits)
    rank = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    which = np.empty(len(keys), dtype=np.int64)
    which[place] = rank
    return which, int(rank[-1]) + 1


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))


def _per_side(start: np.ndarray, side: np.ndarray, sides: int) -> list[np.ndarray]:
    """How many of every run's entries belong to each side; the runs begin at ``start``."""
    if not len(start):
        return [np.zeros(0, dtype=np.int64)] * sides
    counts = [np.add.reduceat(side == s, start, dtype=np.int64) for s in range(1, sides)]
    return [np.diff(np.append(start, len(side))) - sum(counts), *counts]


def clipped_counts(codes: np.ndarray, lists: np.ndarray, rows: int, orders: tuple[int, ...], systems: int = 1) -> dict[int, np.ndarray]:
    """Per order, and per system one after another, rows of clipped matches, hypothesis n-grams and reference n-grams.

    ``codes`` are the tokens of all lists one after another, ``lists`` the list each belongs to: lists
    0..rows-1 are the hypotheses of the first system and so on, the last ``rows`` lists their references. Two orders come from
    one sort: the n-grams of a row are sorted by the number of their first n - 2 tokens and that of their last two.
    """
    most, size = max(orders), len(codes)
    side, of_row = np.divmod(lists, max(rows, 1))
    lengths = np.bincount(lists, minlength=(systems + 1) * rows).reshape(systems + 1, rows)
    out: dict[int, np.ndarray] = {}

    def count(n: int, start: np.ndarray, sides: np.ndarray, place: np.ndarray, whole: np.ndarray) -> None:
        if n not in orders:
            return
        counts, total = _per_side(start, sides, systems + 1), np.maximum(lengths - n + 1, 0)
        row = of_row[place[start]]
        out[n] = np.stack([part for s in range(systems) for part in (
            np.bincount(row, np.minimum(counts[s], counts[-1]) * whole, rows).astype(np.int64), total[s], total[-1])])

    bits = (int(codes.max()) + 1 if size else 1).bit_length()
    after = np.zeros(size, dtype=np.int64)                # the next token plus one, 0 at the end of a list
    after[:-1] = np.where(lists[1:] == lists[:-1], codes[1:] + 1, 0)
    first = (of_row << bits) | codes
    if (max(rows, 1) - 1).bit_length() + 2 * bits + size.bit_length() > 63:
        first = numbered(first)[0]
    number, at = first, np.arange(size)                   # the n-gram that begins at each place of ``at``
    pair = tail = None                                    # of every token: its pair with the next one; of every pair: its first token, whether it has a second
    for n in range(0, most, 2):
        if pair is None:
            key, place = in_order((number << bits) | after)
            shorter = key >> bits
            whole = (key & ((1 << bits) - 1)) > 0
        else:
            kept = lists[:max(size - n, 0)] == lists[n:]
            at = at[np.searchsorted(at, np.flatnonzero(kept))]
            low = max(len(tail), 1).bit_length()
            key, where = in_order((number[at] << low) | pair[at + n])
            place, last = at[where], key & ((1 << low) - 1)
            shorter = ((key >> low) << low) | tail[last, 0]
            whole = tail[last, 1] > 0
        sides, start, longer = side[place], _starts(shorter), _starts(key)
        count(n + 1, start, sides, place, np.ones(len(start), dtype=np.int64))
        count(n + 2, longer, sides, place, whole[longer].astype(np.int64))
        if n + 2 < most:
            rank = np.zeros(len(key), dtype=np.int64)
            rank[longer[1:]] = 1
            number = np.zeros(size, dtype=np.int64)
            number[place] = np.cumsum(rank)
            if pair is None:
                pair = number
                token = np.zeros(len(key), dtype=np.int64)
                token[start[1:]] = 1
                tail = np.stack([np.cumsum(token)[longer], whole[longer]], axis=1)
    return out


def side_counts(codes: np.ndarray, lists: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, token) pairs in order, as rows and tokens, and how often each stands in list ``row`` and in list ``rows + row``."""
    bits = (int(codes.max()) if len(codes) else 0).bit_length()
    key, place = in_order((lists % rows << bits) | codes)
    start = _starts(key)
    return key[start] >> bits, key[start] & ((1 << bits) - 1), np.stack(_per_side(start, (lists // rows)[place], 2))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def dtw_cost(cost: np.ndarray) -> float:
    """Dynamic-time-warping total."""
    return float(_dtw_rows(np.cumsum(cost, axis=1), np.concatenate([[0.0], np.full(cost.shape[1], np.inf)]))[-1])


def _dtw_rows(along: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The totals in the last of some rows of a cost grid, from those in the row above them (a corner first).

    ``along`` are the costs added up along each row. Steps to the right add them, so the total of a cell is the row's costs up to
    it plus the least of what the cells to its left need without them.
    """
    last, now, least = above.copy(), np.full(len(above), np.inf), np.empty(along.shape[1])
    for costs in along:
        np.minimum(last[1:], last[:-1], out=least)
        np.subtract(least[1:], costs[:-1], out=least[1:])
        np.minimum.accumulate(least, out=least)
        np.add(least, costs, out=now[1:])
        last[0] = np.inf
        last, now = now, last
    return last


def _dtw_pair(x: np.ndarray, y: np.ndarray, cells: int = 50_000) -> float:
    """``dtw_cost(1 - x @ y.T)`` with some ``cells`` cells of the grid in memory, one row of it at least."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    row, rows = np.concatenate([[0.0], np.full(len(y), np.inf)]), max(1, cells // len(y))
    passed, steps = np.cumsum(y, axis=0).T, np.arange(1.0, len(y) + 1)
    for start in range(0, len(x), rows):
        row = _dtw_rows(steps - x[start:start + rows] @ passed, row)
    return float(row[-1])


LONG_GRID = 60_000  # cells from which a grid is walked alone


def dtw_costs(pairs: Sequence[tuple[np.ndarray, np.ndarray]], cells: int = 2_000_000) -> np.ndarray:
    """``dtw_cost(1 - x @ y.T)`` of many pairs of unit rows. Small grids of like size are stacked, up to ``cells`` cells, and
    walked together by anti-diagonals.

    A grid that is smaller than its stack is filled up at its far ends, which its own last cell does not see.
    """
    out = np.empty(len(pairs))
    shape = [(len(x), len(y)) for x, y in pairs]
    for i, (n, m) in enumerate(shape):
        if n * m > LONG_GRID:
            out[i] = _dtw_pair(*pairs[i])
    order = sorted((i for i, (n, m) in enumerate(shape) if n * m <= LONG_GRID), key=lambda i: (sum(shape[i]), shape[i]))
    start = 0
    while start < len(order):
        end, n, m = start, 0, 0
        while end < len(order):
            i, j = shape[order[end]]
            wide, high = max(n, i), max(m, j)
            if end > start and ((end - start + 1) * wide * high > cells or wide > 1.25 * shape[order[start]][0] + 4 or high > 1.25 * shape[order[start]][1] + 4):
                break
            n, m, end = wide, high, end + 1
        some, start = order[start:end], end
        if len(some) == 1:
            out[some] = _dtw_pair(*pairs[some[0]])
            continue
        cost = np.zeros((n, m, len(some)))
        for k, at in enumerate(some):
            x, y = pairs[at]
            cost[:len(x), :len(y), k] = 1.0 - x @ y.T
        flat, step = cost.reshape(n * m, len(some)), max(m - 1, 1)
        ended = np.searchsorted([sum(shape[at]) for at in some], np.arange(2, n + m + 2)).tolist()     # grids that end before each diagonal
        last_row = np.array([shape[at][0] for at in some])
        before, last, now = (np.full((n + 2, len(some)), np.inf) for _ in range(3))
        before[0] = 0.0
        for diagonal in range(2, n + m + 1):
            low, high = max(1, diagonal - m), min(n, diagonal - 1)
            best, first = now[low:high + 1], (low - 1) * m + diagonal - low - 1
            np.minimum(last[low - 1:high], last[low:high + 1], out=best)
            np.minimum(best, before[low - 1:high], out=best)
            best += flat[first:first + (high - low) * step + 1:step]
            now[low - 1] = now[high + 1] = np.inf
            if ended[diagonal - 2] < ended[diagonal - 1]:
                found = np.arange(ended[diagonal - 2], ended[diagonal - 1])
                out[[some[k] for k in found]] = now[last_row[found], found]
            before, last, now = last, now, before
    return out


def hashed_slot(feature: str, dim: int, seed: int) -> tuple[int, float]:
    """Position and sign of a feature."""
    digest = hashlib.md5(f"{seed}:{feature}".encode()).digest()
    return int.from_bytes(digest[:4]) % dim, -1.0 if digest[4] & 16 else 1.0


class KnownSlots(dict):
    """Feature -> 2 * position + (1 if the sign is negative); the table of known features is bounded."""

    def __init__(self, dim: int, seed: int, limit: int = 500_000) -> None:
        super().__init__()
        self.dim, self.seed, self.limit = dim, seed, limit

    def __reduce__(self):
        return KnownSlots, (self.dim, self.seed, self.limit)     # a copy elsewhere finds the features again

    def __missing__(self, feature: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        at, sign = hashed_slot(feature, self.dim, self.seed)
        self[feature] = 2 * at + (sign < 0)
        return self[feature]

    def vectors(self, lists: Iterable[list[str]]) -> np.ndarray:
        """Signed feature hashing of bags of strings, one row a bag."""
        found, sizes = [], []
        for features in lists:
            found += [self[f] for f in features]
            sizes.append(len(features))
        return self.summed(np.array(found, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes), len(sizes))

    def summed(self, slots: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """The slots added up by the row each belongs to."""
        return np.bincount(of * self.dim + (slots >> 1), 1.0 - 2 * (slots & 1), size * self.dim).reshape(size, self.dim)


def hashed_vector(features: list[str], dim: int, seed: int) -> np.ndarray:
    """Signed feature hashing of a bag of strings."""
    return KnownSlots(dim, seed).vectors([features])[0]


def beta_cdf(a: float, b: float, x: float, terms: int = 100_000) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz).

    A fraction that has not settled after ``terms`` steps is an error.
    """
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(b, a, 1.0 - x, terms)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, terms):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return front * value
    raise ArithmeticError(f"the incomplete beta function does not converge at a={a}, b={b}, x={x}")


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_critical(df: float, level: float = 0.95) -> float:
    """Two-sided critical value by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, df) > 1.0 - level else (low, mid)
    return (low + high) / 2.0


def binomial_half_tail(successes: int, trials: int) -> float:
    """P(X <= successes) for a fair coin."""
    return 1.0 if successes >= trials else beta_cdf(trials - successes, successes + 1.0, 0.5)


def sign_flip_share(values) -> float:
    """Share of the sign vectors whose sum is at least as large, in absolute value, as that of the values.

    Sums that differ by rounding only count as equal.
    """
    values = np.asarray(values, dtype=float)
    size = float(np.abs(values).sum())
    limit = abs(float(values.sum())) - max(len(values) * 1e-15, size * 1e-12)
    if limit <= 0:
        return 1.0

    def sums(part: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in part:
            out = np.concatenate([out + v, out - v])
        return out

    half = len(values) // 2
    a, b = sums(values[:half]), np.sort(sums(values[half:]))
    above = len(b) * len(a) - int(np.searchsorted(b, limit - a, side="left").sum())
    below = int(np.searchsorted(b, -limit - a, side="right").sum())
    return (above + below) / 2 ** len(values)
