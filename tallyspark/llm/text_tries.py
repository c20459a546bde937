"""A compressed trie of byte strings that holds the smallest id of each whole text."""

from __future__ import annotations

from collections.abc import Iterator


class Trie:
    """Edges hold runs of bytes; a node is a number, and stays the same when an edge above it is split."""

    def __init__(self) -> None:
        self._below: list[dict[int, tuple[bytes, int]]] = [{}]
        self.least: list[int | None] = [None]
        self.size = 0  # bytes on the edges

    def insert(self, text: bytes, id: int) -> int:
        """The node at which the text ends."""
        node, at = 0, 0
        while at < len(text):
            step = self._below[node].get(text[at])
            if step is None:
                node = self._hang(node, text[at:])
                break
            edge, child = step
            if not text.startswith(edge, at):
                child = self._split(node, edge, child, _common(edge, text, at))
                edge = self._below[node][text[at]][0]
            node, at = child, at + len(edge)
        least = self.least[node]
        if least is None or id < least:
            self.least[node] = id
        return node

    def _node(self) -> int:
        self._below.append({})
        self.least.append(None)
        return len(self.least) - 1

    def _hang(self, node: int, edge: bytes) -> int:
        child = self._node()
        self._below[node][edge[0]] = edge, child
        self.size += len(edge)
        return child

    def _split(self, node: int, edge: bytes, child: int, size: int) -> int:
        """A node between ``node`` and ``child``, after ``size`` bytes of the edge."""
        middle = self._node()
        self._below[node][edge[0]] = edge[:size], middle
        self._below[middle][edge[size]] = edge[size:], child
        return middle

    def texts(self) -> Iterator[tuple[int, bytes]]:
        """Node and text of every text that was inserted, depth first."""
        left: list[tuple[int, bytes]] = [(0, b"")]
        while left:
            node, text = left.pop()
            if self.least[node] is not None:
                yield node, text
            left += [(child, text + edge) for edge, child in self._below[node].values()]


def _common(edge: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``edge`` and ``text[at:]``, which begin alike."""
    low, high = 1, len(edge)  # low bytes agree, high don't
    while high - low > 1:
        middle = (low + high) // 2
        if text.startswith(edge[low:middle], at + low):
            low = middle
        else:
            high = middle
    return low
