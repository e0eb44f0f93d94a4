"""A finger B-tree of partial aggregates keyed by event time.

Leaves hold (key, partial) in key order, inner nodes the merged partial of each subtree. The finger is the rightmost
leaf, where events in order arrive: nodes on the right spine keep no merged partial, so an insert there touches the leaf
only. An insert further left updates the partials of its ancestors up to the spine, which is logarithmic in the number of
keys. Eviction cuts whole subtrees off the left side.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

WIDTH = 16


class _Node:
    __slots__ = ("agg", "keys", "kids", "parent", "vals")

    def __init__(self, leaf: bool):
        self.keys: list = []  # leaf: its keys; inner: the smallest key under each kid
        self.vals: list | None = [] if leaf else None
        self.kids: list | None = None if leaf else []
        self.agg = None
        self.parent: _Node | None = None


class FingerTree:
    """`merge(a, b)` returns the partial of a and b, with a earlier than b; it must not change its arguments."""

    def __init__(self, merge: Callable, width: int = WIDTH):
        self.merge, self.width = merge, width
        self.root = self.finger = _Node(True)
        self.size = 0

    def _fold(self, node: _Node):
        parts = node.vals if node.kids is None else [k.agg if k.agg is not None else self._fold(k) for k in node.kids]
        out = None
        for p in parts:
            if p is not None:
                out = p if out is None else self.merge(out, p)
        return out

    def _on_spine(self, node: _Node) -> bool:
        while node.parent is not None:
            if node.parent.kids[-1] is not node:
                return False
            node = node.parent
        return True

    def _leaf(self, key) -> _Node:
        node = self.finger
        if node.keys and key >= node.keys[0]:
            return node
        while node.parent is not None and (not node.keys or key < node.keys[0]):
            node = node.parent
        while node.kids is not None:
            node = node.kids[max(0, bisect_right(node.keys, key) - 1)]
        return node

    def insert(self, key, partial):
        """Merge `partial` into `key`; returns the key's partial afterwards."""
        leaf = self._leaf(key)
        i = bisect_left(leaf.keys, key)
        if i < len(leaf.keys) and leaf.keys[i] == key:
            leaf.vals[i] = out = self.merge(leaf.vals[i], partial)
        else:
            leaf.keys.insert(i, key)
            leaf.vals.insert(i, partial)
            self.size += 1
            out = partial
            if i == 0:
                self._lower(leaf)
            if len(leaf.keys) > self.width:
                self._split(leaf)
                return out
        self._refresh(leaf)
        return out

    def _lower(self, node: _Node) -> None:
        while (up := node.parent) is not None:
            at = up.kids.index(node)
            up.keys[at] = node.keys[0]
            if at:
                break
            node = up

    def _refresh(self, node: _Node | None) -> None:
        while node is not None and node.agg is not None:  # spine nodes have none
            node.agg = self._fold(node)
            node = node.parent

    def _split(self, node: _Node) -> None:
        while len(node.keys) > self.width:
            half = len(node.keys) // 2
            right = _Node(node.kids is None)
            right.keys, node.keys = node.keys[half:], node.keys[:half]
            if node.kids is None:
                right.vals, node.vals = node.vals[half:], node.vals[:half]
            else:
                right.kids, node.kids = node.kids[half:], node.kids[:half]
                for k in right.kids:
                    k.parent = right
            up = node.parent
            if up is None:
                self.root = up = _Node(False)
                up.keys, up.kids, node.parent = [node.keys[0]], [node], up
            at = up.kids.index(node) + 1
            up.kids.insert(at, right)
            up.keys.insert(at, right.keys[0])
            right.parent = up
            if self._on_spine(right):
                node.agg = self._fold(node)
            else:
                node.agg, right.agg = self._fold(node), self._fold(right)
            node = up
        self._refresh(node)
        f = self.root
        while f.kids is not None:
            f = f.kids[-1]
        self.finger = f

    def total(self):
        """The partial of all keys, None if there are none."""
        return self._fold(self.root)

    def range(self, lo, hi):
        """The partial of the keys in [lo, hi): whole subtrees inside it count by their partial."""

        def walk(node: _Node, end):
            if node.kids is None:
                return [v for k, v in zip(node.keys, node.vals) if lo <= k < hi]
            out = []
            for i, k in enumerate(node.kids):
                start, stop = node.keys[i], node.keys[i + 1] if i + 1 < len(node.keys) else end
                if start >= hi or (stop is not None and stop <= lo):
                    continue
                if lo <= start and stop is not None and stop <= hi and k.agg is not None:
                    out.append(k.agg)
                else:
                    out += walk(k, stop)
            return out

        out = None
        for p in walk(self.root, None):
            out = p if out is None else self.merge(out, p)
        return out

    def items(self) -> Iterator[tuple]:
        stack = [self.root]
        while stack:
            n = stack.pop()
            if n.kids is None:
                yield from zip(n.keys, n.vals)
            else:
                stack += reversed(n.kids)

    def first(self):
        """The smallest key, None if there is none."""
        n = self.root
        while n.kids is not None:
            n = n.kids[0]
        return n.keys[0] if n.keys else None

    def evict(self, before) -> list[tuple]:
        """Cut off all keys under `before`, whole subtrees at once; returns their (key, partial) in order."""
        out: list[tuple] = []
        if (f := self.first()) is None or f >= before:
            return out
        node = self.root
        while True:
            if node.kids is None:
                i = bisect_left(node.keys, before)
                out += zip(node.keys[:i], node.vals[:i])
                del node.keys[:i], node.vals[:i]
                break
            i = max(0, bisect_left(node.keys, before) - 1)  # the kid the cut runs through
            for k in node.kids[:i]:
                gone = FingerTree(self.merge)
                gone.root = k
                out += gone.items()
            del node.kids[:i], node.keys[:i]
            node = node.kids[0]
        self.size -= len(out)
        while not node.keys and node.parent is not None:
            up = node.parent
            del up.kids[0], up.keys[0]
            if node is self.finger and up.kids:
                self.finger = None
            node = up
        if node.keys and node.parent is not None:
            self._lower(node)
        while node is not None:
            if node.agg is not None:
                node.agg = self._fold(node)
            node = node.parent
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.root.agg = None
        if self.root.kids is not None and not self.root.kids:
            self.root = _Node(True)
        f = self.root
        while f.kids is not None:
            f = f.kids[-1]
        self.finger = f
        return out
