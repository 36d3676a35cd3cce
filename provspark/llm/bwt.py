"""Common prefixes of suffixes by backward extension on a Burrows-Wheeler transform.

Works on one block of byte strings. Intervals of suffixes that start with a
string w are extended by the symbol before each suffix: the suffixes that
start with c + w are again an interval, and the first suffix behind it shares
len(w) symbols with the last in it. Taken breadth first, this gives the common
prefixes of neighbours by increasing value; after `limit` rounds every boundary
not yet found has a common prefix of at least `limit`, and nothing beyond is
ever worked out (Beller et al., 2013, stopped at a threshold).
"""

from __future__ import annotations

import numpy as np


def sorted_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of keys below 2**bits; plain sorting of key and place in one word is far faster than argsort."""
    place = max(len(key) - 1, 1).bit_length()
    if bits + place > 64:
        order = np.argsort(key)
        return order, key[order]
    both = (key << np.uint64(place)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << place) - 1)).astype(np.int64), both >> np.uint64(place)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in order of at least their first `depth` symbols, by doubling what is compared.

    Also the first symbols of each in that order, as one number, and how many
    of them a number holds. Suffixes that differ from all others have their
    place and are not sorted again.
    """
    n = len(text)
    found = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint64)
    code[found] = np.arange(1, len(found) + 1)
    width = len(found).bit_length()
    reach = start = max((64 - max(n - 1, 1).bit_length()) // width, 1)
    wide = np.concatenate([code[text], np.zeros(reach, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(reach):
        key = (key << np.uint64(width)) | wide[j : j + n]
    order, heads = sorted_places(key, width * reach)
    new = np.ones(n, bool)  # the first of each run of suffixes that are equal so far
    new[1:] = heads[1:] != heads[:-1]
    rank_bits = max(n, 1).bit_length()
    while reach < depth:
        rank = np.zeros(n + reach, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        open_ = order[at]
        place, run = sorted_places((rank[open_] << np.uint64(rank_bits)) | rank[open_ + reach], 2 * rank_bits)
        order[at] = open_[place]
        new[at[1:]] |= run[1:] != run[:-1]
        reach *= 2
    return order, heads, start


def boundaries(text: np.ndarray, order: np.ndarray, limit: int, heads: np.ndarray | None = None, known: int = 0) -> np.ndarray:
    """True at i if suffixes i - 1 and i of the order share fewer than `limit` symbols.

    Symbol 0 separates strings; what lies behind one is not looked at, so the
    answer counts only for suffixes with `limit` symbols before the next 0.
    The first `known` symbols of each suffix, if given as numbers, stand for
    the rounds that would find them.
    """
    n = len(text)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # of each row: where its suffix goes when the symbol before it is put in front, and that symbol
    before = order - 1
    goes = np.where(before >= 0, place[before], 0).astype(np.int32)
    put = np.where(before >= 0, text[before], 0).astype(np.uint8)
    first = text[order]
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    depth = 1
    if heads is not None and 1 < known < limit:
        low, high = _grown(order, heads, known, np.flatnonzero(text == 0), found)
        depth = known + 1
    held = np.full(n, -1, np.int32)
    for depth in range(depth, limit + 1):
        size = high - low + 1
        total = int(size.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(low), dtype=np.int32), size)
        rows = np.arange(total, dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        stay = put[rows] != 0 if depth > 1 else before[rows] >= 0
        to, owner = goes[rows[stay]], owner[stay]
        if not len(to):
            break
        if len(to) > n // 16:  # most rows are there: put them in their places rather than sort them
            held[to] = owner
            to = np.flatnonzero(held >= 0).astype(np.int32)
            owner = held[to]
            held[to] = -1
        else:
            both = (to.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64)
            both.sort()
            to, owner = (both >> np.uint64(32)).astype(np.int32), (both & np.uint64(0xFFFFFFFF)).astype(np.int32)
        symbol = first[to]
        last = np.concatenate([(owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]), [True]])
        high = to[last]
        low = to[np.concatenate([[True], last[:-1]])]
        new = ~found[high + 1]
        low, high = low[new], high[new]
        found[high + 1] = True
    return found[:n]


def _grown(order: np.ndarray, heads: np.ndarray, known: int, zeros: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `known` rounds leave: boundaries of suffixes that differ in their first `known` symbols are set
    in found, and the intervals of strings of `known` symbols that the last of those rounds has bounded are returned."""
    n = len(order)
    differ = heads[1:] != heads[:-1]
    found[1:n] = differ
    edge = np.flatnonzero(np.concatenate([[True], differ]))
    low, high = edge.astype(np.int32), np.append(edge[1:] - 1, n - 1).astype(np.int32)
    width = int(heads.max()).bit_length() // known  # of a symbol; the highest fills its bits
    # bounded in the last round: the next suffix has all but the last symbol in common
    short = heads >> np.uint64(width)
    in_last = np.append(short[high[:-1]] == short[high[:-1] + 1], False) if len(high) else np.zeros(0, bool)
    # no separator before the last of the symbols
    next_zero = np.searchsorted(zeros, order[low])
    gap = np.where(next_zero < len(zeros), zeros[np.minimum(next_zero, len(zeros) - 1)] - order[low], n) if len(zeros) else np.full(len(low), n)
    whole = in_last & (gap >= known - 1) & (order[low] + known <= n)
    return low[whole], high[whole]


def least_owner(strings: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For the first starts[i] positions of strings[i]: the least owner of a string with the same next `length` bytes.

    Every string is starts[i] + length - 1 bytes long, without byte 255.
    """
    text = np.frombuffer(b"\xff" + b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # 255 wraps to 0
    sizes = np.array([len(s) for s in strings], np.int64)
    first = np.cumsum(sizes + 1) - sizes
    at = np.repeat(first - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    none = np.iinfo(np.int64).max
    owner = np.full(len(text), none, np.int64)
    owner[at] = np.repeat(owners, starts)
    order, heads, known = suffix_order(text, length)
    edge = boundaries(text, order, length, heads, known)
    group = np.cumsum(edge) - 1
    least = np.minimum.reduceat(owner[order], np.flatnonzero(edge))
    out = np.empty(len(text), np.int64)
    out[order] = least[group]
    return out[at]
