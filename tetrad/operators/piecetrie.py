"""Longest-match-first tokenization of a word in one pass.

A trie of the vocabulary with a failure link and failure pops per node: when the
next character does not continue a node's string, the pops are the pieces that
greedy matching takes of that string, and the link is the node of what is left.
Each character is read once, so a word costs time in proportion to its length,
however long it is.
"""

from __future__ import annotations

from collections import deque

#: mark of pieces that continue a word (fixed value)
INNER = "##"


class PieceTrie:
    """Pieces at the beginning of a word hang under node 0, pieces that
    continue one, less their mark, under node 1. ``ids``: piece -> id."""

    def __init__(self, ids: dict[str, int], unknown: int | None = None):
        self.unknown = unknown
        self.child: dict[tuple[int, str], int] = {}
        self.piece: list = [None, None]                   # id of the piece that a node spells
        self.longest = max((len(p) for p in ids), default=0)
        for piece, i in ids.items():
            if piece:
                self._insert(0, piece, i)
            if piece.startswith(INNER) and len(piece) > len(INNER):
                self._insert(1, piece[len(INNER):], i)
        self._link()

    def _insert(self, node: int, text: str, i: int) -> None:
        for c in text:
            nxt = self.child.get((node, c))
            if nxt is None:
                nxt = self.child[node, c] = len(self.piece)
                self.piece.append(None)
            node = nxt
        self.piece[node] = i

    def _link(self) -> None:
        n = len(self.piece)
        below: list = [[] for _ in range(n)]
        for (node, c), nxt in self.child.items():
            below[node].append((c, nxt))
        self.link: list = [None] * n                      # None: greedy matching fails here
        self.pops: list = [()] * n
        todo = deque((0, 1))
        while todo:
            u = todo.popleft()
            for c, v in below[u]:
                todo.append(v)
                if self.piece[v] is not None:
                    self.link[v], self.pops[v] = 1, (self.piece[v],)
                    continue
                z, pops = self.link[u], self.pops[u]
                while z is not None and (z, c) not in self.child:
                    pops, z = pops + self.pops[z], self.link[z]
                if z is not None:
                    self.link[v], self.pops[v] = self.child[z, c], pops

    def greedy(self, word: str) -> list[int]:
        """Ids of the word's pieces; the unknown id if some place has none."""
        child, link, pops = self.child.get, self.link, self.pops
        node, out = 0, []
        for c in word:
            nxt = child((node, c))
            while nxt is None:
                out += pops[node]
                node = link[node]
                if node is None:
                    return [self.unknown]
                nxt = child((node, c))
            node = nxt
        while node > 1:                                   # the end of the word: pop down to what nothing is left of
            out += pops[node]
            node = link[node]
            if node is None:
                return [self.unknown]
        return out

    def matches(self, word: str, start: int, end: int, node: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that begin at ``start``, shortest first."""
        out = []
        for at in range(start, min(end, start + self.longest)):
            node = self.child.get((node, word[at]))
            if node is None:
                break
            if self.piece[node] is not None:
                out.append((at + 1, self.piece[node]))
        return out

    def device(self, word: str) -> list[int]:
        """What the phone's tokenizer gives: the word as a piece; else, for each
        of its beginnings in the vocabulary (longest first), that piece and the
        longest pieces that continue it - of the whole remainder at first, after
        a hit of the remainder less its last character."""
        first = self.matches(word, 0, len(word), 0)
        if first and first[-1][0] == len(word):
            return [first[-1][1]]
        out = []
        for at, i in reversed(first):
            out.append(i)
            end = len(word)
            while at < end:
                more = self.matches(word, at, end, 1)
                if not more:
                    break
                at = more[-1][0]
                out.append(more[-1][1])
                end = len(word) - 1
        return out
