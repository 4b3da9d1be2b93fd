"""Suffix arrays by the difference-cover algorithm, on arrays of symbols."""

from __future__ import annotations

import numpy as np

#: So many symbols at most: then a key of three names fits 64 bits.
MOST_SYMBOLS = 1_200_000


#: Keys below so many times their number are named through a table of all keys instead of a sort.
TABLE_SHARE = 8


def _names(keys: np.ndarray) -> np.ndarray:
    """For every key its rank among the distinct ones, from 1."""
    most = int(keys.max()) + 1
    if most <= TABLE_SHARE * len(keys):
        held = np.zeros(most, np.int32)
        held[keys] = 1
        return np.cumsum(held, dtype=np.int32)[keys]
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), np.int32)
    new[1:] = ranked[1:] != ranked[:-1]
    names = np.empty(len(keys), np.int32)
    names[order] = np.cumsum(new, dtype=np.int32)
    return names


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order.

    ``symbols`` are positive. Suffixes at places 1 and 2 modulo 3 are the sample: their triples are
    sorted and named, and unless all names differ the string of names is sorted in the same way. The
    suffixes at places 0 modulo 3 follow by their first symbol and the rank of the suffix after it, and
    are merged with the sample.
    """
    n = len(symbols)
    if n > MOST_SYMBOLS:
        raise ValueError(f"{n} symbols are more than one suffix array takes")
    if n < 3:
        padded = np.concatenate([symbols, np.zeros(3, np.int64)])
        return np.array(sorted(range(n), key=lambda i: tuple(padded[i : i + 3])), np.int64)
    t = np.concatenate([symbols.astype(np.int32), np.zeros(4, np.int32)])
    base = np.int64(int(t.max()) + 1)
    # A place beyond the end keeps the two halves of the sample apart if n is 1 modulo 3.
    first, second = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    triples = (t[:-2] * base + t[1:-1]) * base + t[2:]
    names = _names(np.concatenate([triples[first[0] : first[-1] + 1 : 3], triples[2:n:3]]))
    if names.max() < len(names):
        order = suffix_array(names)
    else:
        order = np.empty(len(names), np.int64)
        order[names - 1] = np.arange(len(names))
    sample = np.concatenate([first, second])
    by_rank = sample[order]
    ranks = np.zeros(n + 4, np.int32)
    ranks[by_rank] = np.arange(1, len(sample) + 1, dtype=np.int32)
    if n % 3 == 1:
        order = order[by_rank < n]
        by_rank = by_rank[by_rank < n]

    width = np.int64(len(sample) + 2)
    pairs = t[:-1] * width + ranks[1 : len(t)]
    # No two suffixes are equal, so no two pairs are.
    turn = np.argsort(pairs[0:n:3])
    rest = turn * 3
    is_one = order < len(first)
    ones, twos = by_rank[is_one], by_rank[~is_one]
    triple = lambda i: t[i] * (base * width) + pairs[i + 1]
    before_ones = np.searchsorted(pairs[ones], pairs[rest])
    before_twos = np.searchsorted(triple(twos), triple(rest))
    # Of two lists in order, the places of the one among the other tell those of the other among the one.
    passed = lambda before, size: np.cumsum(np.bincount(before, minlength=size + 1))[:size]
    among_sample = np.arange(len(by_rank))
    among_sample[is_one] += passed(before_ones, len(ones))
    among_sample[~is_one] += passed(before_twos, len(twos))
    result = np.empty(n, np.int64)
    result[np.arange(len(rest)) + before_ones + before_twos] = rest
    result[among_sample] = by_rank
    return result


def equal_windows(content: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class number of every window ``content[start : start + length]``; equal windows share it.

    The windows are put in the order of the suffix array and each is compared with the one before.
    """
    # Only the symbols that occur are numbered, so that few keys are possible.
    symbols = np.cumsum(np.bincount(content, minlength=256) > 0)
    order = suffix_array(symbols[content])
    wanted = np.zeros(len(content), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    view = np.lib.stride_tricks.sliding_window_view(content, length)
    new = np.ones(len(order), np.int64)
    for at in range(1, len(order), 1 << 16):
        part = order[at - 1 : at + (1 << 16)]
        windows = view[part]
        new[at : at + len(part) - 1] = (windows[1:] != windows[:-1]).any(axis=1)
    classes = np.empty(len(content), np.int64)
    classes[order] = np.cumsum(new) - 1
    return classes[starts]
