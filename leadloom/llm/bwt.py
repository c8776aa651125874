"""Repeated strings of a collection by a Burrows-Wheeler transform (numpy).

``repeated_starts`` derives where common prefixes of neighbouring suffixes are
shorter than a threshold by breadth-first backward extension: intervals of the
strings of length l + 1 are made from those of length l by all characters that
precede them, and where an interval ends, the common prefix is l if no shorter
one was found there. Levels come by increasing value and stop at the
threshold; what is undefined then is at least that long. No suffix is compared
beyond it.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in the order of their first ``depth`` characters or more; ties in any order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k : n + k]
    size = 8
    while True:
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if size >= depth or new[-1] == n - 1:
            return order
        # ranks of the parts of a prefix side by side: three of them where they fit
        rank = np.zeros(n + 2 * size, np.uint64)
        rank[order] = new + 1
        bits = np.uint64(int(n).bit_length())
        key = (rank[:n] << bits) | rank[size : n + size]
        if 3 * bits <= 64 and 2 * size < depth:
            key = (key << bits) | rank[2 * size : n + 2 * size]
            size *= 3
        else:
            size *= 2


def repeated_starts(blocks: list[bytes], length: int) -> list[np.ndarray]:
    """For each block the starts of strings of ``length`` bytes that start elsewhere in some block, too."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    # byte 0 ends a block; 0xFF, which no UTF-8 text holds, stands for a byte 0 of the text
    joined = b"\0".join(b.replace(b"\0", b"\xff") for b in blocks) + b"\0"
    text = np.frombuffer(joined, np.uint8)
    n = len(text)
    order = suffix_order(text, length + 1)
    bwt = text[order - 1]
    by_char = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # the row of the suffix that starts one character earlier, among equals in order
    step[by_char] = np.arange(n)

    open_ = np.ones(n + 1, bool)  # entries of the common-prefix array that no level has reached
    open_[0] = open_[n] = False
    chars, first = np.unique(np.sort(text), return_index=True)
    lb, rb = first, np.append(first[1:], n) - 1
    level = 0
    while True:
        fresh = open_[rb + 1]
        fresh |= rb + 1 == n if level == 0 else False
        lb, rb = lb[fresh], rb[fresh]
        open_[rb[rb + 1 < n] + 1] = False
        level += 1
        if level >= length or not len(lb):
            break
        one = lb == rb
        single = lb[one]
        single = step[single[bwt[single] != 0]]
        wide_lb, wide_size = lb[~one], (rb - lb + 1)[~one]
        total = int(wide_size.sum())
        owner = np.repeat(np.arange(len(wide_lb)), wide_size)
        rows = np.arange(total) - np.repeat(np.cumsum(wide_size) - wide_size, wide_size) + np.repeat(wide_lb, wide_size)
        key = owner * 256 + bwt[rows]
        _, at, count = np.unique(key, return_index=True, return_counts=True)
        at, count = at[bwt[rows[at]] != 0], count[bwt[rows[at]] != 0]
        low = step[rows[at]]
        lb, rb = np.concatenate([single, low]), np.concatenate([single, low + count - 1])

    begin = np.cumsum(sizes + 1) - (sizes + 1)
    block = np.searchsorted(begin, order, side="right") - 1
    whole = order - begin[block] + length <= sizes[block]
    equal = open_[1:n]  # row i and i + 1 share ``length`` characters
    equal = equal & whole[1:] & whole[:-1]
    hit = np.zeros(n, bool)
    hit[1:] |= equal
    hit[:-1] |= equal
    starts = np.sort(order[hit])
    cut = np.searchsorted(starts, begin[1:])
    return [x - b for x, b in zip(np.split(starts, cut), begin)]
