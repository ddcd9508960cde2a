"""Suffix arrays of a shard by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one; the
leftmost smaller ones (LMS) are sorted, first as substrings by one round of
inducing and then, where substrings repeat, by the suffix array of the string of
their names, which is made in the same way; all others are induced from them. With
few symbols this goes bucket by bucket: a bucket's entries are placed together,
each wave holds the predecessors of the wave before, and is dealt to the buckets
by a radix sort of 16-bit symbols. The shorter strings of many names are gone
through entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Most symbols of a string that is induced bucket by bucket.
ALPHABET = 512


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S. t ends with a unique smallest sentinel."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # last place of a run
    smaller = np.empty(n, bool)
    run_end = change[np.searchsorted(change, np.arange(n - 1))]
    smaller[:-1] = t[run_end] < t[run_end + 1]
    smaller[-1] = True
    return smaller


def _place(sa, slots, keys, values, step):
    """Puts values in order into the buckets of keys, from slots on in the direction of step."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # numpy sorts 16-bit numbers by radix
    k = keys[order]
    counts = np.bincount(k, minlength=len(slots))
    first = np.cumsum(counts) - counts
    sa[slots[k] + step * (np.arange(len(k)) - first[k])] = values[order]
    slots += step * counts


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that an order of the LMS places induces."""
    if len(sizes) > ALPHABET:
        return _induce_in_turn(t.tolist(), smaller.tolist(), lms.tolist(), sizes)
    sa = np.full(len(t), -1, np.int64)
    ends = np.cumsum(sizes)
    heads, tails = ends - sizes, ends - 1
    low = heads.copy()
    slots = tails.copy()
    _place(sa, slots, t[lms][::-1], lms[::-1], -1)
    first_s = slots + 1  # where the LMS part of a bucket begins
    present = np.flatnonzero(sizes)
    for c in present:
        done = low[c]
        while done < heads[c]:  # larger ones of this bucket, wave by wave
            wave = sa[done : heads[c]]
            done = heads[c]
            prev = wave[wave > 0] - 1
            prev = prev[~smaller[prev]]
            _place(sa, heads, t[prev], prev, 1)
        part = sa[first_s[c] : ends[c]]
        prev = part[part > 0] - 1
        prev = prev[~smaller[prev]]
        _place(sa, heads, t[prev], prev, 1)
    slots = tails.copy()
    for c in present[::-1]:
        done = tails[c]
        while done > slots[c]:
            wave = sa[slots[c] + 1 : done + 1][::-1]
            done = slots[c]
            prev = wave[wave > 0] - 1
            prev = prev[smaller[prev]]
            _place(sa, slots, t[prev], prev, -1)
        part = sa[low[c] : heads[c]][::-1]
        prev = part[part > 0] - 1
        prev = prev[smaller[prev]]
        _place(sa, slots, t[prev], prev, -1)
    sa[0] = len(t) - 1  # the sentinel
    return sa


def _induce_in_turn(t: list, smaller: list, lms: list, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).tolist(), (ends - 1).tolist()
    sa = [-1] * len(t)
    for i in reversed(lms):
        c = t[i]
        sa[tails[c]] = i
        tails[c] -= 1
    for i in sa:  # sees what it puts further on
        if i > 0 and not smaller[i - 1]:
            c = t[i - 1]
            sa[heads[c]] = i - 1
            heads[c] += 1
    tails = (ends - 1).tolist()
    for k in range(len(sa) - 1, -1, -1):
        i = sa[k]
        if i > 0 and smaller[i - 1]:
            c = t[i - 1]
            sa[tails[c]] = i - 1
            tails[c] -= 1
    sa[0] = len(t) - 1
    return np.array(sa, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers from 1."""
    t = np.concatenate([text.astype(np.int64), [0]])
    smaller = classify(t)
    is_lms = np.zeros(len(t), bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(t)
    if len(lms) > 1:
        first = induce(t, smaller, lms, sizes)
        by_substring = first[is_lms[first]]
        # equal neighbours: same length and same symbols, told by a polynomial hash
        power = np.cumprod(np.full(len(t), 0x9E3779B97F4A7C15, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((t + 1).astype(np.uint64) * power)])
        number = np.empty(len(t), np.int64)
        number[lms] = np.arange(len(lms))
        stop = np.append(lms[1:], len(t) - 1)
        place = number[by_substring]
        length = stop[place] - by_substring
        h = total[stop[place] + 1] - total[by_substring]
        # compare a / power[i] with b / power[j] by bringing both to the later place
        x, y = by_substring[:-1], by_substring[1:]
        gap = np.abs(y - x)
        scale = np.where(gap > 0, power[np.maximum(gap - 1, 0)], np.uint64(1))
        left = np.where(x < y, h[:-1] * scale, h[:-1])
        right = np.where(x < y, h[1:], h[1:] * scale)
        new = (length[1:] != length[:-1]) | (left != right)
        names = np.empty(len(lms), np.int64)
        names[place] = np.concatenate([[0], np.cumsum(new)])
        lms = by_substring if names.max() == len(lms) - 1 else lms[suffix_array(names + 1)]
    return induce(t, smaller, lms, sizes)[1:]


def common_with_previous(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the text the common prefix with the suffix before it in the array, up to depth (permuted order).

    The symbols are from 1 to 257: seven of them are a word; twice and four times as many and so on, up to depth, are told by a hash.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    widths = [7]
    while widths[-1] < depth:
        widths.append(2 * widths[-1])
    wide = np.concatenate([text, np.zeros(2 * widths[-1], text.dtype)]).astype(np.uint64)
    word = np.zeros(n + widths[-1], np.uint64)
    for k in range(7):  # symbols of nine bits
        word = (word << np.uint64(9)) | wide[k : k + len(word)]
    runs = [word]
    for w in widths[:-1]:
        x = runs[-1]
        x = x[:-w] * np.uint64(0x9E3779B97F4A7C15) + x[w:]
        runs.append(x ^ (x >> np.uint64(29)))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(phi >= 0)
    at, other = live.copy(), phi[live]
    for w, run in zip(widths[-2::-1], runs[-2::-1], strict=True):
        same = (run[np.minimum(at, len(run) - 1)] == run[np.minimum(other, len(run) - 1)]) & (np.maximum(at, other) < len(run))
        at += w * same
        other += w * same
    inside = np.maximum(at, other) < len(word)
    x = word[np.minimum(at, len(word) - 1)] ^ word[np.minimum(other, len(word) - 1)]
    extra = np.zeros(len(live), np.int64)
    for k in range(7):
        extra += (x >> np.uint64(9 * (6 - k))) == 0
    out[live] = at - live + np.where(inside, extra, 0)
    return np.minimum(out, depth)
