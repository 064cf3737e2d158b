"""Byte-pair merge lists as deterministic transducers.

BPE gives every prefix of a word one encoding, and the last token of that
encoding is the only token t ending there such that t may follow the last token
of the prefix before t. So reading a word left to right needs only the last
tokens at the positions where a longer token could still have begun: a finite
amount, as tokens are of bounded length. Nodes and states are made when first met.
"""

from __future__ import annotations

import json
from functools import cached_property

END = "</w>"
#: Pairs of tokens that are remembered; at the bound they are dropped, which changes no result.
MOST_PAIRS = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, by rule: printable Latin-1 stands for itself, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A merge list over symbols: bytes as chr(0..255), a word's last byte as chr(256..511) where the list has word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ends = model.get("end_of_word_suffix") == END
        letters = byte_letters()

        def symbols(token: str) -> str:
            final = self.ends and token.endswith(END)
            body = [chr(letters[c]) for c in (token[: -len(END)] if final else token)]
            if final:
                body[-1] = chr(256 + ord(body[-1]))
            return "".join(body)

        self.written: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.written |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[str, int] = {}
        self.text: dict[int, str] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.ids[symbols(token)] = i
                self.text[i] = symbols(token)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.ids[symbols(a)], self.ids[symbols(b)]
            whole = self.ids[self.text[left] + self.text[right]]
            if whole in self.made:
                raise ValueError("the merge list makes a token twice")
            self.rank[left, right], self.made[whole] = r, (r, left, right)
        if any(p in self.made and self.made[p][0] > r for r, left, right in self.made.values() for p in (left, right)):
            raise ValueError("the merge list makes a token before its parts")
        self.prefixes = {t[:n] for t in self.ids for n in range(len(t) + 1)}
        self.known: dict[int, bool] = {}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def lookahead(self) -> int:
        """Symbols after a boundary that can still change whether the list merges across it.

        Whether (x, y) merges depends on y being formed, and on no part of y's
        right edge being taken first by a merge of lower rank with what follows;
        that depends in turn on yet lower ranks further right. Ranks fall at each
        step, so one pass in rank order adds up the longest such chain.
        """
        reach: dict[int, int] = {}  # by left part, the farthest of the merges so far
        edge: dict[int, int] = {}  # by token, the farthest that its right edge depended on when it was formed
        most = 0
        for whole, (_, left, right) in self.made.items():
            beyond = max(reach.get(right, 0), edge.get(right, 0))
            here = len(self.text[right]) + beyond
            edge[whole] = beyond
            reach[left] = max(reach.get(left, 0), here)
            most = max(most, here)
        return most

    def follows(self, pair: int) -> bool:
        """Whether the encoding of a's text and b's text together is a, b, for the pair a << 32 | b."""
        if len(self.known) >= MOST_PAIRS:
            self.known.clear()
        got = self.known[pair] = self._boundary_holds(pair >> 32, pair & 0xFFFFFFFF)
        return got

    def _edge(self, token: int, side: int) -> list[tuple[float, int]]:
        """The pieces at one edge of a token, smallest first, with the rank at which each gives way to the next."""
        out: list[tuple[float, int]] = []
        gone: float = float("inf")
        while True:
            out.append((gone, token))
            if token not in self.made:
                return out[::-1]
            gone, token = self.made[token][0], self.made[token][side]

    def _boundary_holds(self, a: int, b: int) -> bool:
        left, right = self._edge(a, 2), self._edge(b, 1)
        i = j = 0
        while True:
            (until_a, x), (until_b, y) = left[i], right[j]
            across = self.rank.get((x, y), float("inf"))
            if across < until_a and across <= until_b:  # of equal ranks the leftmost merges first
                return False
            if until_a == until_b == float("inf"):
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def word(self, data: bytes) -> str:
        """The symbols of a word."""
        text = data.decode("latin-1")
        return text[:-1] + chr(256 + ord(text[-1])) if self.ends and text else text


class Node:
    """A prefix of some token: where each symbol leads, and (length, token) of the tokens that end there, longest first."""

    __slots__ = ("tail", "next", "outs")

    def __init__(self, tail: str, outs: tuple):
        self.tail, self.next, self.outs = tail, {}, outs


class Matcher:
    """Reads symbols and knows the longest end that begins some token: at most a node a prefix of a token, made when first met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.nodes: dict[str, Node] = {}
        self.root = self._node("")

    def _node(self, tail: str) -> Node:
        got = self.nodes.get(tail)
        if got is None:
            ids = self.merges.ids
            outs = tuple([(len(tail) - i, t) for i in range(len(tail)) if (t := ids.get(tail[i:])) is not None])
            got = self.nodes[tail] = Node(tail, outs)
        return got

    def step(self, node: Node, symbol: str) -> Node:
        text, prefixes = node.tail + symbol, self.merges.prefixes
        got = node.next[symbol] = self._node(next(text[i:] for i in range(len(text) + 1) if text[i:] in prefixes))
        return got
