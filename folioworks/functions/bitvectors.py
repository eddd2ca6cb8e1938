"""Edit distances, edit scripts and common subsequences of two sequences by bit vectors.

A Python integer is the vector: one bit per place of the longer sequence, one step per element of the shorter one, so a step
takes the time of a few additions of long integers. Memory is that of some such vectors, whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: An element that occurs more often than this has its places kept as a vector, others have theirs put together when met.
OFTEN = 16


def places(items: Sequence) -> dict:
    """Element to the vector of its places, or to the list of them if they are few."""
    found: dict = {}
    for i, x in enumerate(items):
        found.setdefault(x, []).append(i)
    for x, at in found.items():
        if len(at) > OFTEN:
            bits = np.zeros(len(items), dtype=np.uint8)
            bits[at] = 1
            found[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return found


def _vector(at) -> int:
    return at if isinstance(at, int) else sum(1 << i for i in at)


def _ends(a: Sequence, b: Sequence) -> tuple[int, int]:
    """(length of the common beginning, length of the common end after it)."""
    least, low, high = min(len(a), len(b)), 0, min(len(a), len(b))
    while low < high:  # slices are compared at once
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    first, low, high = low, 0, least - low
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low] else (low, middle - 1)
    return first, low


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence of two texts or lists."""
    first, last = _ends(a, b)
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return first + last
    at, ones = places(b), (1 << len(b)) - 1
    v = ones
    for x in a:
        if (met := at.get(x)) is not None:
            u = v & _vector(met)
            v = (v + u | v - u) & ones
    return first + last + len(b) - v.bit_count()


def distance(a: Sequence, b: Sequence) -> int:
    """Edits between two sequences: an insertion, deletion or replacement is one."""
    first, last = _ends(a, b)
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    at, ones, top = places(b), (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, out = ones, 0, len(b)
    for x in a:  # as _column, written out for speed
        match = at.get(x, 0)
        if match.__class__ is list:
            match = _vector(match)
        same = (((match & up) + up) ^ up) | match | down
        across = (down | ones ^ ((same | up) & ones)) << 1 | 1
        back = up & same
        if back & top:
            out -= 1
        elif across >> 1 & top:
            out += 1
        up = (back << 1 | ones ^ ((same | across) & ones)) & ones
        down = across & same & ones
    return out


def _column(match: int, up: int, down: int, ones: int) -> tuple[int, int, int, int, int]:
    """The next column of the table of distances, as differences. Bit i of ``up`` and ``down``: row i + 1 is one more or one less
    than row i. Gives the rows that equal their upper left neighbour, those one more and one less than their left one, and the next column."""
    same = (((match & up) + up ^ up) | match | down) & ones
    across = down | (ones & ~(same | up))
    back = up & same
    shifted = across << 1 | 1
    return same, across, back, back << 1 & ones | (ones & ~(same | shifted)), shifted & same & ones


def source_errors(ref: str, hyp: str) -> list[str]:
    """Characters of ``ref`` that a shortest edit script replaces or deletes. Going back from the ends, the script keeps or replaces where
    that is shortest, else deletes, else inserts.

    Columns of the table are worked out twice: a first pass keeps every k-th, and the way back takes them from those again, k at a
    time, so 2 sqrt(n) columns are held at once.
    """
    cut = _ends(ref[::-1], hyp[::-1])[0]
    ref, hyp = ref[: len(ref) - cut], hyp[: len(hyp) - cut]
    if not ref or not hyp:
        return list(ref)
    at, ones = {c: _vector(m) for c, m in places(ref).items()}, (1 << len(ref)) - 1
    step = max(1, int(len(hyp) ** 0.5))
    up, down, kept = ones, 0, []
    for j, c in enumerate(hyp):
        if j % step == 0:
            kept.append((up, down))
        _, _, _, up, down = _column(at.get(c, 0), up, down, ones)
    out, i, j = [], len(ref), len(hyp)
    for block in range(len(kept) - 1, -1, -1):
        start, (up, down) = block * step, kept[block]
        columns = []
        for c in hyp[start:j]:
            same, _, _, up, down = _column(at.get(c, 0), up, down, ones)
            columns.append((_bits(same, len(ref)), _bits(up, len(ref))))
        while i > 0 and j > start:
            same, more = columns[j - start - 1]
            bit = i - 1
            if ref[bit] == hyp[j - 1]:
                i, j = i - 1, j - 1
            elif not same[bit >> 3] >> (bit & 7) & 1:
                out.append(ref[bit])
                i, j = i - 1, j - 1
            elif more[bit >> 3] >> (bit & 7) & 1:
                out.append(ref[bit])
                i -= 1
            else:
                j -= 1
        if i == 0:
            break
        j = start
    out += ref[:i][::-1]
    return out[::-1]


def _bits(vector: int, size: int) -> bytes:
    return vector.to_bytes((size + 7) // 8, "little")
