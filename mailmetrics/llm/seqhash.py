"""Hashes of runs of symbols, for all positions of a long sequence at once (numpy).

A sequence of 64-bit symbols is hashed as a polynomial mod 2^64 through prefix
sums, so the hash of any run costs one subtraction and one product.  The
sliding minimum over hashed k-runs ("winnowing") picks, for every window of n
symbols, an anchor that depends on the window's content alone: equal windows
have equal anchors at the same place in them.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

#: One random 64-bit symbol a byte value.
BYTE = np.random.default_rng(20240601).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _table(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        got = _powers[int(base)] = np.multiply.accumulate(full)
    return got[:n]


def prefix(sym: np.ndarray) -> np.ndarray:
    got = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * _table(_BASE, len(sym)), out=got[1:])
    return got


def runs(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end)."""
    return mix((pre[end] - pre[start]) * _table(_INV, len(pre))[start] + (end - start).astype(np.uint64) * _ODD)


def all_runs(pre: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position that has k."""
    n = len(pre) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((pre[k:] - pre[:-k]) * _table(_INV, n) + np.uint64(k * int(_ODD) % (1 << 64)))


def anchors(kh: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive hashes (the last of equals)."""
    n = len(kh)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64(max(1, int(n).bit_length()))
    best = (mix(kh ^ _BASE) >> low << low) | np.arange(n - 1, -1, -1).astype(np.uint64)
    size = 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: n - width + 1], best[width - size:])
    return n - 1 - (best & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def domains(pre: np.ndarray, ends: np.ndarray, n: int, k: int) -> dict[str, np.ndarray]:
    """The windows of n symbols, cut into runs that share an anchor.

    ``ends``: for each position, where its document ends.  Returned: ``first``
    and ``last`` window start of each run, ``anchor`` (hash of the anchor's k
    symbols) and ``whole`` (hash of all the symbols of the run's windows).
    Runs never cross documents.
    """
    total = len(pre) - 1
    none = np.zeros(0, np.int64)
    if total < n:
        return {"first": none, "last": none, "anchor": none.astype(np.uint64), "whole": none.astype(np.uint64)}
    kh = all_runs(pre, k)
    at = anchors(kh, n - k + 1)
    start = np.arange(total - n + 1)
    ok = start + n <= ends[: total - n + 1]
    cut = np.ones(len(at) + 1, bool)
    cut[1:-1] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    bounds = np.flatnonzero(cut)
    first, last = bounds[:-1], bounds[1:] - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    whole = runs(pre, first, first + n) ^ mix(runs(pre, last, last + n) + (last - first).astype(np.uint64))
    return {"first": first, "last": last, "anchor": kh[at[first]], "whole": whole}


def i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
