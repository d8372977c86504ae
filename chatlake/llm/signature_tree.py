"""Signature trees: which sets of one group are linked, by dual traversal.

A leaf holds a few sets; every node holds the OR of its sets' token bitmaps and the
range of their sizes. A pair of nodes is dropped when even the largest overlap that
sizes and bitmaps allow is too small, or when all sets below both are connected
already; a pair of sets that is left is settled by its exact intersection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 8


@dataclass
class Node:
    """``bits`` is the OR at the node's own width, ``half`` the same folded once; with the least counts of a set below."""

    members: range
    width: int
    bits: int
    half: int
    least_bits: int
    least_half: int
    smallest: int
    largest: int
    parts: tuple[Node, Node] | None = None


class UnionFind:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def width_for(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, at least twice n, so it can be folded to half of it."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """The token bitmap of a set, little-endian."""
    width = width_for(len(tokens))
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def chains(sizes: list[int], percent: int) -> list[list[int]]:
    """Positions in order of size, cut where a set is too small to be linked to the next larger one."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if not out or 100 * sizes[out[-1][-1]] < percent * sizes[i]:
            out.append([])
        out[-1].append(i)
    return out


class SignatureTree:
    """Sets by size and bitmap, in order of size; ``sets`` (two lanes of distinct tokens, lane one sorted) make links exact.

    Without ``sets`` a pair is linked if sizes and bitmaps allow it: no true link is missing then.
    There is one tree for each width of bitmap. Sets that can be linked have equal widths, or
    widths a factor of two apart, and then the wider bitmap is folded once.
    """

    def __init__(self, sizes: list[int], bitmaps: list[bytes], percent: int, sets: list[np.ndarray] | None = None) -> None:
        if percent < 50:
            raise ValueError("bitmaps are compared for similarities of one half and more")
        self.percent = percent
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], bitmaps[i]))
        self.order, self.sizes = order, [sizes[i] for i in order]
        self.widths = [8 * len(bitmaps[i]) for i in order]
        self.bits = [int.from_bytes(bitmaps[i], "little") for i in order]
        self.half = [(b >> (w // 2)) | (b & ((1 << (w // 2)) - 1)) for b, w in zip(self.bits, self.widths, strict=True)]
        self.n_bits, self.n_half = [b.bit_count() for b in self.bits], [b.bit_count() for b in self.half]
        self.sets = sets and [sets[i] for i in order]
        cuts = [i for i in range(len(order)) if not i or self.widths[i] != self.widths[i - 1]] + [len(order)]
        self.roots = [self._build(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def _build(self, lo: int, hi: int) -> Node:
        if hi - lo <= LEAF:
            bits = half = 0
            for i in range(lo, hi):
                bits |= self.bits[i]
                half |= self.half[i]
            return Node(range(lo, hi), self.widths[lo], bits, half, min(self.n_bits[lo:hi]), min(self.n_half[lo:hi]), self.sizes[lo], self.sizes[hi - 1])
        a, b = self._build(lo, (lo + hi) // 2), self._build((lo + hi) // 2, hi)
        least, least_half = min(a.least_bits, b.least_bits), min(a.least_half, b.least_half)
        return Node(range(lo, hi), a.width, a.bits | b.bits, a.half | b.half, least, least_half, a.smallest, b.largest, (a, b))

    def _possible(self, a: Node, b: Node) -> bool:
        """Whether a set below a and one below b can overlap enough: overlap >= percent of the union."""
        if 100 * a.largest < self.percent * b.smallest or 100 * b.largest < self.percent * a.smallest:
            return False
        if a.width == b.width:
            shared, least_a, least_b = (a.bits & b.bits).bit_count(), a.least_bits, b.least_bits
        elif a.width < b.width:
            shared, least_a, least_b = (a.bits & b.half).bit_count(), a.least_bits, b.least_half
        else:
            shared, least_a, least_b = (a.half & b.bits).bit_count(), a.least_half, b.least_bits
        most = min(a.largest - max(0, least_a - shared), b.largest - max(0, least_b - shared))
        return (100 + self.percent) * most >= self.percent * (a.smallest + b.smallest)

    def linked(self, i: int, j: int) -> bool:
        n, m = self.sizes[i], self.sizes[j]
        if 100 * min(n, m) < self.percent * max(n, m):
            return False
        if self.widths[i] == self.widths[j]:
            shared, own_i, own_j = (self.bits[i] & self.bits[j]).bit_count(), self.n_bits[i], self.n_bits[j]
        elif self.widths[i] < self.widths[j]:
            shared, own_i, own_j = (self.bits[i] & self.half[j]).bit_count(), self.n_bits[i], self.n_half[j]
        else:
            shared, own_i, own_j = (self.half[i] & self.bits[j]).bit_count(), self.n_half[i], self.n_bits[j]
        if (100 + self.percent) * (min(n - own_i, m - own_j) + shared) < self.percent * (n + m):
            return False
        if self.sets is None:
            return True
        (one, two), (other, check) = self.sets[i], self.sets[j]
        at = np.minimum(np.searchsorted(other, one), m - 1)
        common = int(((other[at] == one) & (check[at] == two)).sum())
        return 100 * common >= self.percent * (n + m - common)

    def connect(self, side: list[int] | None = None) -> list[int]:
        """A root for each set, equal for connected ones, in the order given to the tree.

        With ``side``, only pairs of sets on different sides are compared.
        """
        uf = UnionFind(len(self.sizes))
        sides = [0] * len(self.sizes) if side is None else [side[i] for i in self.order]

        def whole(n: Node) -> int | None:
            root = uf.find(n.members[0])
            return root if all(uf.find(i) == root for i in n.members) else None

        def pair(i: int, j: int) -> None:
            if (side is None or sides[i] != sides[j]) and uf.find(i) != uf.find(j) and self.linked(i, j):
                uf.union(i, j)

        todo = [(a, b) for a, b in zip(self.roots[:-1], self.roots[1:], strict=True) if b.width == 2 * a.width]
        todo += [(r, r) for r in self.roots]
        while todo:
            a, b = todo.pop()
            if a is b:
                if a.parts:
                    left, right = a.parts
                    todo += [(left, right), (right, right), (left, left)]
                else:
                    for i in a.members:
                        for j in range(i + 1, a.members.stop):
                            pair(i, j)
                continue
            if not self._possible(a, b):
                continue
            root = whole(a)
            if root is not None and root == whole(b):
                continue
            if a.parts and (not b.parts or len(a.members) >= len(b.members)):
                todo += [(a.parts[1], b), (a.parts[0], b)]
            elif b.parts:
                todo += [(a, b.parts[1]), (a, b.parts[0])]
            else:
                for i in a.members:
                    for j in b.members:
                        pair(i, j)
        roots = [uf.find(i) for i in range(len(self.sizes))]
        out = [0] * len(self.sizes)
        for place, i in enumerate(self.order):
            out[i] = self.order[roots[place]]
        return out
