"""Fuzzy ratios between texts (0 to 100), over bit-parallel longest common subsequences.

One Arrow UDF returns all four, so a pair crosses to Python once. The functions of one pair say what is meant; those that end
in `_all` give the same for many pairs at once, a column of the table for each of them in one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; whole columns of the table as one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insert/delete similarity; two empty texts are alike."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    """`ratio` of the words in order."""
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among common words, common words with the rest of one side, and with that of the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = ratio(with_a, with_b)
    if both:
        best = max(best, ratio(both, with_a), ratio(both, with_b))
    return best


def _partial(short: str, long: str) -> float:
    m, n = len(short), len(long)
    best = 0.0
    letters = set(short)
    for i in range(1 - m, n):
        lo, hi = max(0, i), min(n, i + m)
        # a window that ends with a strange letter is no better than the one before
        if hi < n and long[hi - 1] not in letters:
            continue
        r = ratio(short, long[lo:hi])
        if r > best:
            best = r
            if best == 100.0:
                break
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer one up to its own length."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_partial(a, b), _partial(b, a))
    return _partial(a, b) if len(a) < len(b) else _partial(b, a)


def _partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, word-order-free and partial ratios, the latter discounted by length."""
    if not a or not b:
        return 0.0
    best = ratio(a, b)
    by_length = max(len(a), len(b)) / min(len(a), len(b))
    if by_length < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if by_length <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * _partial_token_ratio(a, b))


#: Bits of a column of the table, and pairs (or cells of pairs and windows) that are worked on at once.
_BITS, _PAIRS, _CELLS = 64, 2048, 1 << 16


def _matrix(codes: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
    """One text per column, padded."""
    m = np.full((len(lengths), max(1, lengths.max())), pad, dtype=np.int64)
    m[np.arange(m.shape[1]) < lengths[:, None]] = codes
    return np.ascontiguousarray(m.T)


def _matches(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(where, full): for each letter of `b` (row) and pair (column) the bits of the places of `a` that hold it; all bits of `a`."""
    na, nb = np.fromiter(map(len, a), int, len(a)), np.fromiter(map(len, b), int, len(b))
    codes = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    there = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.int64)
    there[codes] = 1
    codes = np.cumsum(there)[codes]  # from 1 on; 0 pads `a`, the largest pads `b`
    wide = int(there.sum()) + 2
    x, y = _matrix(codes[: na.sum()], na, 0), _matrix(codes[na.sum() :], nb, wide - 1)
    base, table = np.arange(len(a)) * wide, np.zeros(len(a) * wide, dtype=np.uint64)
    for i, row in enumerate(x):
        table[base + row] |= np.uint64(1 << i)
    full = np.where(na >= _BITS, np.uint64(2**_BITS - 1), (np.uint64(1) << np.minimum(na, _BITS - 1).astype(np.uint64)) - np.uint64(1))
    return table[base + y], full


def lcs_all(a: list[str], b: list[str]) -> np.ndarray:
    """`lcs` of each pair, many pairs at once."""
    out = np.zeros(len(a), dtype=np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    order = sorted((i for i, (x, _) in enumerate(pairs) if 0 < len(x) <= _BITS), key=lambda i: len(pairs[i][1]))
    for k in range(0, len(order), _PAIRS):
        part = order[k : k + _PAIRS]
        where, full = _matches([pairs[i][0] for i in part], [pairs[i][1] for i in part])
        s = full.copy()
        for row in where:  # what is carried beyond the last place is cut off at the end
            u = s & row
            s = (s + u) | (s - u)
        out[part] = [len(pairs[i][0]) for i in part] - np.bitwise_count(s & full).astype(np.int64)
    for i, (x, y) in enumerate(pairs):
        if len(x) > _BITS:
            out[i] = lcs(x, y)
    return out


def ratio_all(a: list[str], b: list[str]) -> np.ndarray:
    """`ratio` of each pair."""
    n = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), float, len(a))
    return np.where(n > 0, 200.0 * lcs_all(a, b) / np.maximum(n, 1), 100.0)


def partial_all(a: list[str], b: list[str]) -> np.ndarray:
    """`partial_ratio` of each pair: all windows of many pairs at once."""
    out = np.zeros(len(a))
    todo: dict[int, list[tuple[int, str, str]]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        if not x or not y:
            out[i] = 100.0 if x == y else 0.0
        elif min(len(x), len(y)) > _BITS:
            out[i] = partial_ratio(x, y)
        elif x in y or y in x:
            out[i] = 100.0
        else:
            for short, long in ((x, y), (y, x)):
                if len(short) <= len(long):
                    todo.setdefault(len(short), []).append((i, short, long))
    for m, group in todo.items():
        group.sort(key=lambda g: len(g[2]))
        while group:
            n = max(8, _CELLS // len(group[min(len(group), _PAIRS) - 1][2]))
            part, group = group[: min(n, _PAIRS)], group[min(n, _PAIRS) :]
            where, full = _matches([g[1] for g in part], [g[2] for g in part])
            n, lengths = len(where), np.array([len(g[2]) for g in part])
            where = np.vstack([where, np.zeros((m, len(part)), dtype=np.uint64)])
            s = np.repeat(full[None], n, axis=0)  # a row for each beginning of a window
            best = np.zeros(len(part))
            for t in range(m):
                u = s & where[t : t + n]
                s = (s + u) | (s - u)
                best = np.maximum(best, 200.0 * (m - np.bitwise_count(s[0] & full).astype(float)) / (m + t + 1))  # the first letters alone
            reach = np.clip(lengths - np.arange(n)[:, None], 0, m)
            found = m - np.bitwise_count(s & full).astype(float)
            best = np.maximum(best, (200.0 * found / (m + reach)).max(axis=0))
            at = np.array([g[0] for g in part])
            np.maximum.at(out, at, best)
    return out


def _token_set_all(a: list[str], b: list[str]) -> np.ndarray:
    """`token_set_ratio` of each pair. Both sides begin with the common words, so only what follows is compared."""
    out, rest = np.zeros(len(a)), []
    for i, (p, q) in enumerate(zip(a, b)):
        x, y = set(p.split()), set(q.split())
        if not x or not y:
            continue
        common = x & y
        both, only_a, only_b = " ".join(sorted(common)), " ".join(sorted(x - common)), " ".join(sorted(y - common))
        if both and (not only_a or not only_b):
            out[i] = 100.0
        else:
            rest.append((i, len(both) + 1 if both else 0, only_a, only_b))
    for (i, head, p, q), n in zip(rest, lcs_all([r[2] for r in rest], [r[3] for r in rest])):
        best = 200.0 * (head + int(n)) / (2 * head + len(p) + len(q))
        if head:
            both = head - 1
            best = max(best, 200.0 * both / (both + head + len(p)), 200.0 * both / (both + head + len(q)))
        out[i] = best
    return out


def weighted_all(a: list[str], b: list[str], sorts: np.ndarray | None = None, partials: np.ndarray | None = None) -> np.ndarray:
    """`weighted_ratio` of each pair; `sorts` and `partials` are their token_sort_ratio and partial_ratio, if known."""
    out = np.zeros(len(a))
    near, far = [], []
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y:
            (near if max(len(x), len(y)) / min(len(x), len(y)) < 1.5 else far).append(i)
    of = lambda of_, rows: [of_[i] for i in rows]
    if near:
        x, y = of(a, near), of(b, near)
        sort = sorts[near] if sorts is not None else ratio_all([*map(_sorted, x)], [*map(_sorted, y)])
        out[near] = np.maximum(ratio_all(x, y), 0.95 * np.maximum(sort, _token_set_all(x, y)))
    if far:
        x, y = of(a, far), of(b, far)
        scale = np.array([0.9 if max(len(p), len(q)) / min(len(p), len(q)) <= 8 else 0.6 for p, q in zip(x, y)])
        part = partials[far] if partials is not None else partial_all(x, y)
        words = np.full(len(far), 100.0)
        apart = [i for i, (p, q) in enumerate(zip(x, y)) if not set(p.split()) & set(q.split())]
        distinct = lambda s: " ".join(sorted(set(s.split())))
        p, q = of(x, apart), of(y, apart)
        words[apart] = np.maximum(partial_all([*map(_sorted, p)], [*map(_sorted, q)]), partial_all([*map(distinct, p)], [*map(distinct, q)]))
        out[far] = np.maximum(np.maximum(ratio_all(x, y), scale * part), 0.95 * scale * words)
    return out


FUZZY = ["name_lev_sim", "name_partial_ratio", "name_token_sort_sim", "addr_lev_sim"]


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in FUZZY]))
def fuzzy_features(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """(name1, name2, addr1, addr2) -> the four fuzzy features, from 0 to 1; 0 where both texts are empty."""

    for n1, n2, a1, a2 in batches:
        at: dict[tuple[str, str], int] = {}
        rows = [at.setdefault(p, len(at)) for p in zip(n1, n2)]
        x, y = [p for p, _ in at], [q for _, q in at]
        sort, part = ratio_all([*map(_sorted, x)], [*map(_sorted, y)]), partial_all(x, y)
        names = np.stack([weighted_all(x, y, sort, part), part, sort], axis=1) / 100
        names[[not (p or q) for p, q in at]] = 0.0
        at = {}
        places = [at.setdefault(p, len(at)) for p in zip(a1, a2)]
        address = weighted_all([p for p, _ in at], [q for _, q in at]) / 100
        yield pd.DataFrame(np.column_stack([names[rows], address[places]]), columns=FUZZY)
