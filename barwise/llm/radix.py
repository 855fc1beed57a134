"""An adaptive radix tree over byte keys, in memory.

Nodes carry a compressed path and grow with their children: 4 and 16 (parallel bytes and children), 48 (an index of 256
bytes into the children), 256 (a slot for every byte). A key may end inside another one, so any node can hold values.
"""


class Node:
    """``path``: the bytes between the parent's branching byte and this node's own branching or end."""

    __slots__ = ("path", "size", "bytes", "children", "values")

    def __init__(self, path=b""):
        self.path, self.size = path, 4
        self.bytes, self.children, self.values = bytearray(), [], []

    def child(self, byte):
        if self.size == 256:
            return self.children[byte]
        if self.size == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        at = self.bytes.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte, node):
        """Add a child, or replace the one under ``byte``."""
        if self.size == 256:
            self.children[byte] = node
            return
        if self.size == 48:
            at = self.bytes[byte]
            if at:
                self.children[at - 1] = node
                return
            if len(self.children) < 48:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
                return
            slots = [self.children[at - 1] if at else None for at in self.bytes]
            self.size, self.bytes, self.children = 256, bytearray(), slots
            self.children[byte] = node
            return
        at = self.bytes.find(byte)
        if at >= 0:
            self.children[at] = node
            return
        if len(self.children) == self.size:
            self._grow()
            self.put(byte, node)
            return
        self.bytes.append(byte)
        self.children.append(node)

    def _grow(self):
        if self.size == 4:
            self.size = 16
            return
        index = bytearray(256)
        for at, byte in enumerate(self.bytes, 1):
            index[byte] = at
        self.size, self.bytes = 48, index

    def items(self):
        """(byte, child) of every child, in no order."""
        if self.size == 256:
            return [(b, c) for b, c in enumerate(self.children) if c is not None]
        if self.size == 48:
            return [(b, self.children[at - 1]) for b, at in enumerate(self.bytes) if at]
        return list(zip(self.bytes, self.children))


def _agree(a, b, at):
    """How many bytes of ``a`` equal those of ``b`` from ``at`` on."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    def __init__(self):
        self.root = None

    def insert(self, key, value):
        if self.root is None:
            self.root = Node(key)
            self.root.values.append(value)
            return
        above, byte, node, at = None, 0, self.root, 0
        while True:
            same = _agree(node.path, key, at)
            if same < len(node.path):
                upper = Node(node.path[:same])
                upper.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node = upper
            at += same
            if at == len(key):
                node.values.append(value)
                return
            lower = node.child(key[at])
            if lower is None:
                leaf = Node(key[at + 1 :])
                leaf.values.append(value)
                node.put(key[at], leaf)
                return
            above, byte, node, at = node, key[at], lower, at + 1

    def walk(self):
        """(node, place of its parent in this list or -1, bytes from the parent to this node's end), parents first."""
        if self.root is None:
            return []
        out, open_ = [], [(self.root, -1, self.root.path)]
        while open_:
            node, parent, path = open_.pop()
            place = len(out)
            out.append((node, parent, path))
            open_ += [(c, place, bytes([b]) + c.path) for b, c in node.items()]
        return out
