"""Prefix tree over globally ordered token sets, for similarity joins inside one cell of sets."""

from __future__ import annotations

import numpy as np


class SetTrie:
    """Path-compressed prefix tree; each set is a sorted array of token ranks.

    Sets with equal tokens share a leaf.  A node keeps the range of leaves
    below it, their least and largest size and how many tokens a path below it
    can still add, which bound the overlap that any leaf below can reach.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: (sets[i].tolist(), int(sizes[i])))
        self.order = np.array(order, dtype=np.int64)          # leaf position -> set
        self.sizes = sizes[self.order]
        rows = [sets[i] for i in order]
        # node: (segment, lo, hi, least size, largest size, tokens still below, leaf end, children)
        self.root = self._build(rows, 0, len(rows), 0)

    def _build(self, rows, lo, hi, depth):
        root_holder: list = []
        stack = [(lo, hi, depth, root_holder)]
        while stack:
            lo, hi, depth, out = stack.pop()
            a, b = rows[lo], rows[hi - 1]
            m = min(len(a), len(b))
            diff = np.flatnonzero(a[depth:m] != b[depth:m])
            stop = depth + int(diff[0]) if len(diff) else m    # common prefix of the sorted range
            end = lo
            while end < hi and len(rows[end]) == stop:
                end += 1
            children: list = []
            span = self.sizes[lo:hi]
            deepest = max(len(r) for r in rows[lo:hi]) - stop
            out.append((a[depth:stop], lo, hi, int(span.min()), int(span.max()), deepest, end, children))
            i = end
            while i < hi:
                t, j = rows[i][stop], i + 1
                while j < hi and rows[j][stop] == t:
                    j += 1
                stack.append((i, j, stop, children))
                i = j
        return root_holder[0]

    def links(self, x: np.ndarray, n: int, mark: np.ndarray, skip, num: int, den: int):
        """Yield leaf ranges (lo, hi) whose sets all overlap ``x`` enough.

        ``x``: token ranks of a set of ``n`` elements (``x`` holds those that
        other sets have too); ``mark`` is true at them; ``skip(lo, hi)`` tells
        that no link to these leaves is wanted.  Sets link when
        overlap * (num + den) >= num * (n + size).
        """
        stack = [(self.root, 0)]
        while stack:
            (seg, lo, hi, least, largest, below, end, children), over = stack.pop()
            if largest * den < num * n or least * num > den * n or skip(lo, hi):
                continue
            left = len(x)
            if len(seg):
                over += int(np.count_nonzero(mark[seg]))
                left -= int(np.searchsorted(x, seg[-1], "right"))
            if (over + min(below, left)) * (num + den) < num * (n + least):
                continue
            if end > lo:
                # leaves at this node share their tokens and are sorted by size
                k = lo + int(np.searchsorted(self.sizes[lo:end], over * (num + den) / num - n, "right"))
                if k > lo:
                    yield lo, k
            stack.extend((c, over) for c in children)


def link_cell(sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, probe: np.ndarray, build: np.ndarray,
              num: int, den: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Join the ``probe`` sets with the ``build`` sets (index arrays); (labels after merging, links used).

    Pairs whose labels are already equal are not compared again, so a group of
    near copies costs one traversal and not all its pairs.
    """
    labels = labels.copy()
    links: list[tuple[int, int]] = []
    if not len(build) or not len(probe):
        return labels, links
    trie = SetTrie([sets[i] for i in build], sizes[build])
    of_leaf = build[trie.order]
    universe = 1 + max((int(s[-1]) for s in sets if len(s)), default=0)
    mark = np.zeros(universe, bool)
    for i in probe:
        if (labels == labels[i]).all():
            continue
        x = sets[i]
        mark[x] = True
        for lo, hi in trie.links(x, int(sizes[i]), mark, lambda lo, hi: bool((labels[of_leaf[lo:hi]] == labels[i]).all()),
                                 num, den):
            for leaf in range(lo, hi):
                j = of_leaf[leaf]
                if labels[j] != labels[i]:
                    links.append((int(i), int(j)))
                    a, b = min(labels[i], labels[j]), max(labels[i], labels[j])
                    labels[labels == b] = a
        mark[x] = False
    return labels, links
