"""Adaptive radix tree over byte strings: nodes grow with their children, and runs of single children are one node."""

from __future__ import annotations

from bisect import bisect_left


class Few:
    """Up to `room` children: their bytes sorted, beside them the children."""

    __slots__ = ("room", "marks", "nodes")

    def __init__(self, room: int):
        self.room, self.marks, self.nodes = room, bytearray(), []

    def get(self, mark: int):
        i = self.marks.find(mark)
        return None if i < 0 else self.nodes[i]

    def full(self) -> bool:
        return len(self.nodes) == self.room

    def put(self, mark: int, node):
        i = bisect_left(self.marks, mark)
        self.marks.insert(i, mark)
        self.nodes.insert(i, node)

    def items(self):
        return zip(self.marks, self.nodes)

    def larger(self):
        return Few(16) if self.room == 4 else Indexed()


class Indexed:
    """Up to 48 children behind 256 bytes that say where each stands."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, mark: int):
        return self.nodes[self.places[mark] - 1] if self.places[mark] else None

    def full(self) -> bool:
        return len(self.nodes) == 48

    def put(self, mark: int, node):
        self.nodes.append(node)
        self.places[mark] = len(self.nodes)

    def items(self):
        return ((mark, self.nodes[place - 1]) for mark, place in enumerate(self.places) if place)

    def larger(self):
        return Direct()


class Direct:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, mark: int):
        return self.nodes[mark]

    def full(self) -> bool:
        return False

    def put(self, mark: int, node):
        self.nodes[mark] = node

    def items(self):
        return ((mark, node) for mark, node in enumerate(self.nodes) if node is not None)


class Node:
    """The bytes after the one that leads here, the children, and the entry of the key that ends here."""

    __slots__ = ("path", "children", "entry")

    def __init__(self, path: bytes, entry=None, children=None):
        self.path, self.entry, self.children = path, entry, children

    def add(self, mark: int, node: Node):
        if self.children is None:
            self.children = Few(4)
        if self.children.full():
            larger = self.children.larger()
            for m, n in self.children.items():
                larger.put(m, n)
            self.children = larger
        self.children.put(mark, node)

    def items(self):
        return self.children.items() if self.children is not None else ()


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes of a stand in b from `at` on, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if b.startswith(a[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: Node, key: bytes, entry) -> None:
    """Puts the entry at the key; keys are put once."""
    node, at = root, 0
    while True:
        path = node.path
        if not key.startswith(path, at):
            n = common(path, key, at)
            below = Node(path[n + 1 :], node.entry, node.children)
            node.path, node.entry, node.children = path[:n], None, None
            node.add(path[n], below)
            at += n
            break
        at += len(path)
        child = node.children.get(key[at]) if at < len(key) and node.children is not None else None
        if child is None:
            break
        node, at = child, at + 1
    if at == len(key):
        node.entry = entry
    else:
        node.add(key[at], Node(key[at + 1 :], entry))


def tree(entries) -> Node:
    """The tree of (key, entry) pairs; one at least."""
    root = None
    for key, entry in entries:
        if root is None:
            root = Node(key, entry)
        else:
            insert(root, key, entry)
    return root
