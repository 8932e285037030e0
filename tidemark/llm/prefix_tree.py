"""A prefix tree of ordered code sequences with compressed paths, and the search that shares partial overlaps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHARE = (80, 100)


@dataclass
class Sequence:
    """The first codes of an ordered set, ascending: ``at`` are their places in the whole set of ``n`` codes. Codes
    that no other set has may be left out; codes at place ``end`` and later aren't listed. A whole set has all
    places and ``end == n``."""

    codes: np.ndarray
    at: np.ndarray
    n: int
    end: int

    @staticmethod
    def whole(codes: np.ndarray) -> Sequence:
        return Sequence(codes, np.arange(len(codes)), len(codes), len(codes))

    def rest(self, i: int) -> int:
        """How many codes the set has from its ``i``-th listed one on."""
        return self.n - (int(self.at[i]) if i < len(self.codes) else self.end)


class _Node:
    """A run of codes that all sequences ``lo:hi`` share; those up to ``own`` end with it. ``before`` and ``after``:
    the most codes that any of their sets has from the run's start on, and behind the run."""

    __slots__ = ("run", "lo", "hi", "own", "least", "most", "before", "after", "group", "children")


class PrefixTree:
    """Stores sequences under their index; ``groups`` (a number each) lets a search leave out one's own group."""

    def __init__(self, sequences: list[Sequence], groups: np.ndarray | None = None):
        self.order = np.array(sorted(range(len(sequences)), key=lambda i: sequences[i].codes.astype(">u8").tobytes()), np.int64)
        self.stored = [sequences[i] for i in self.order]
        self.n = np.array([s.n for s in self.stored], np.int64)
        self.tail = np.array([s.n - s.end for s in self.stored], np.int64)
        self.groups = None if groups is None else np.asarray(groups)[self.order]
        self.root = self._grow()

    def _grow(self) -> _Node:
        root = _Node()
        todo = [(root, 0, len(self.stored), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            a, z = self.stored[lo].codes, self.stored[hi - 1].codes
            n = min(len(a), len(z))
            differ = np.flatnonzero(a[depth:n] != z[depth:n])
            end = depth + int(differ[0]) if len(differ) else n
            node.run, node.lo, node.hi, node.children = a[depth:end], lo, hi, []
            node.least, node.most = int(self.n[lo:hi].min()), int(self.n[lo:hi].max())
            node.before = max(s.rest(depth) for s in self.stored[lo:hi])
            node.after = max(s.rest(end) for s in self.stored[lo:hi])
            node.group = None
            if self.groups is not None and (self.groups[lo:hi] == self.groups[lo]).all():
                node.group = self.groups[lo]
            while lo < hi and len(self.stored[lo].codes) == end:
                lo += 1
            node.own = lo
            while lo < hi:
                head, at = self.stored[lo].codes[end], lo + 1
                while at < hi and self.stored[at].codes[end] == head:
                    at += 1
                child = _Node()
                node.children.append(child)
                todo.append((child, lo, at, end))
                lo = at
        return root

    def search(self, probe: Sequence, share: tuple[int, int] = SHARE, group=None) -> np.ndarray:
        """Indexes of the stored sets whose intersection with the probe's may be ``share`` of their union: exactly
        those where it is if all sequences are whole sets. Sets of ``group`` are left out.

        A subtree is left as soon as the overlap so far and what remains of the probe and of its longest set
        can't reach what its smallest set needs.
        """
        p, q = share
        n, codes, found, todo = probe.n, probe.codes, [], [(self.root, 0)]
        low, high = -(-p * n // q), q * n // p

        def take(lo, hi, overlap, rest):
            size = self.n[lo:hi]
            ok = (size >= low) & (size <= high) & ((p + q) * (overlap + rest) >= p * (n + size))
            if self.groups is not None and group is not None:
                ok &= self.groups[lo:hi] != group
            if ok.any():
                found.append(self.order[lo:hi][ok])

        while todo:
            node, overlap = todo.pop()
            if node.most < low or node.least > high or (group is not None and node.group == group):
                continue
            run, used = node.run, 0
            if len(run):
                cut = int(np.searchsorted(run, codes[-1], "right"))
                part = run[:cut]
                overlap += int((codes[np.searchsorted(codes, part)] == part).sum())
                if cut < len(run):  # what the probe has beyond its listed codes isn't known
                    take(node.lo, node.hi, overlap, min(probe.n - probe.end, node.before - cut))
                    continue
                used = int(np.searchsorted(codes, run[-1], "right"))
            rest = probe.rest(used)
            if node.own > node.lo:
                take(node.lo, node.own, overlap, np.minimum(rest, self.tail[node.lo : node.own]))
            if (p + q) * (overlap + min(rest, node.after)) >= p * (n + max(node.least, low)):
                todo += [(c, overlap) for c in node.children]
        return np.concatenate(found) if found else np.zeros(0, np.int64)
