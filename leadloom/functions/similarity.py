"""Jaro and Jaro-Winkler similarity.

Jaro is computed for whole Arrow batches at once: strings become matrices of
code points, and the matching of one character against its window is done for
all pairs of a batch side by side. Prefixes are built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a matrix that is worked on at a time.
_CELLS = 1 << 20


def _bind(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _codes(texts: list[str]) -> np.ndarray:
    """One row of code points for each text, padded with -1."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _order(codes: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The characters that were hit, moved to the left of each row; -1 behind them."""
    out = np.full(codes.shape, -1, np.int32)
    row, col = np.nonzero(hit)
    out[row, (np.cumsum(hit, axis=1) - 1)[row, col]] = codes[row, col]
    return out


def _jaro_part(s: list[str], t: list[str]) -> np.ndarray:
    a, b = _codes(s), _codes(t)
    n, m = (a >= 0).sum(axis=1), (b >= 0).sum(axis=1)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    place = np.arange(b.shape[1])[None, :]
    rows = np.arange(len(s))
    hit_a, hit_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i in range(a.shape[1]):
        # the first free character of the window that is equal
        fits = (b == a[:, i : i + 1]) & ~hit_b & (np.abs(place - i) <= reach) & (a[:, i : i + 1] >= 0)
        at = fits.argmax(axis=1)
        found = fits[rows, at]
        hit_a[:, i] = found
        hit_b[rows[found], at[found]] = True
    hits = hit_a.sum(axis=1)
    x, y = _order(a, hit_a), _order(b, hit_b)
    width = min(x.shape[1], y.shape[1])
    moved = (x[:, :width] != y[:, :width]).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (hits / n + hits / m + (hits - moved / 2.0) / hits) / 3.0
    return np.where(hits == 0, 0.0, ratio)


def _jaro_all(s: list[str], t: list[str]) -> np.ndarray:
    out = np.zeros(len(s))
    equal = np.array([x == y for x, y in zip(s, t)], bool)
    out[equal] = 1.0
    # pairs of like size together, in parts of bounded size
    rest = [k for k in np.flatnonzero(~equal).tolist() if s[k] and t[k]]
    rest.sort(key=lambda k: max(len(s[k]), len(t[k])))
    at = 0
    while at < len(rest):
        end = at + 1
        while end < len(rest) and (end - at + 1) * max(len(s[rest[end]]), len(t[rest[end]])) <= _CELLS and end - at < 8192:
            end += 1
        part = rest[at:end]
        out[part] = _jaro_part([s[k] for k in part], [t[k] for k in part])
        at = end
    return out


@F.arrow_udf(T.DoubleType())
def _jaro(a: pa.Array, b: pa.Array) -> pa.Array:
    s, t = a.to_pylist(), b.to_pylist()
    none = [x is None or y is None for x, y in zip(s, t)]
    return pa.array(_jaro_all([x or "" for x in s], [y or "" for y in t]), mask=np.array(none, bool))


def jaro(a: Column, b: Column) -> Column:
    """Share of matching characters within a window, less half of those out of order."""
    return _jaro(a, b)


def jaro_winkler(a: Column, b: Column, p: float = 0.1, longest: int = 4) -> Column:
    """Jaro similarity, raised for a common prefix where it is 0.7 or more."""
    same = None
    for k in range(longest, 0, -1):
        hit = (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        same = F.when(hit, k) if same is None else same.when(hit, k)
    same = same.otherwise(0)
    return _bind(F.struct(jaro(a, b).alias("j"), same.alias("l")), lambda x: F.when(x["j"] < 0.7, x["j"]).otherwise(x["j"] + x["l"] * p * (1.0 - x["j"])))
