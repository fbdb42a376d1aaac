"""Byte-pair merges as a deterministic transducer over the bytes of a pretoken.

For every prefix of a pretoken the merges give a list of tokens; that list is known by its last token, as what stands
before it is the list of a shorter prefix. A token t that ends prefix i is its last one exactly if no merge joins t to
the last token of the prefix before it, which is decided by undoing merges at their border, latest first. So the count
of prefix i is that of the prefix before t, plus one.

A state holds what later steps can ask for: the longest end of the prefix that begins some token, and for each place in
it the last token and the count against the prefix's own. It follows from the state before and the next byte alone, and
each transition carries the change of the count. States and transitions are made when first taken, at most MAX_STATES
of them at a time; then the table is begun anew, from the state at hand.
"""

from __future__ import annotations

import json

MAX_STATES = 300_000
NEVER = 1 << 60


def alphabet() -> dict[str, str]:
    """Characters of byte-level files -> characters of the same number as the byte: visible ones of Latin-1 stand for themselves, the other bytes in order from 256."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class MergeTransducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = str.maketrans(alphabet())
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, merge in enumerate(model["merges"]):
            a, b = (x.translate(letters) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[a, b] = i
            self.made.setdefault(a + b, (i, a, b))
            if any(len(x) > 1 and self.made.get(x, (NEVER,))[0] >= i for x in (a, b)):
                raise ValueError(f"{path}: merge {i} joins a token that no earlier merge makes")
        vocabulary = {t.translate(letters) for t in model["vocab"]}
        # a token that the merges never leave (its own bytes give other tokens) can't be the last one of anything
        self.tokens = {t for t in vocabulary if len(t) == 1 or t in self.made and self.apart(*self.made[t][1:], self.made[t][0])}
        if missing := [b for b in range(256) if chr(b) not in self.tokens]:
            raise ValueError(f"{path}: no token for the bytes {missing}")
        self.heads = {t[:n] for t in self.tokens for n in range(len(t) + 1)}
        # what is known of neighbours and of ends outlives a table of states
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ends: dict[str, tuple] = {}
        self.begin()

    def apart(self, a: str, b: str, until: int = NEVER) -> bool:
        """Whether neighbours a and b, each whole by itself, are still two tokens when all merges of a rank below `until` are done."""
        right_first = False  # the merge at rank `until` takes b, so one of the same rank to its left comes before it
        while True:
            rank = self.rank.get((a, b), NEVER)
            if rank < until or right_first and rank == until:
                return False
            of_a, of_b = self.made.get(a, (-1,)), self.made.get(b, (-1,))
            if len(a) == 1 and len(b) == 1:
                return True
            if len(b) == 1 or len(a) > 1 and of_a[0] > of_b[0]:
                until, a, right_first = of_a[0], of_a[2], False
            else:
                until, b, right_first = of_b[0], of_b[1], True

    def begin(self) -> None:
        self.moves: dict[int, int] = {}  # state * 256 + byte -> next state * 512 + change of the count + 256
        self.states: list[tuple[str, tuple, tuple]] = []
        self.number: dict[tuple, int] = {}
        if len(self.pairs) > 2 * MAX_STATES:
            self.pairs = {}
        if len(self.ends) > 2 * MAX_STATES:
            self.ends = {}
        self.state(("", ("",), (0,)))

    def state(self, key: tuple) -> int:
        n = self.number.setdefault(key, len(self.states))
        if n == len(self.states):
            self.states.append(key)
        return n

    def endings(self, seen: str) -> tuple[list[tuple[int, str]], int]:
        """Tokens at the end of a text with their places, longest first, and where its longest end that begins a token starts."""
        places = [(i, seen[i:]) for i in range(len(seen)) if seen[i:] in self.tokens]
        return places, next(i for i in range(len(seen) + 1) if seen[i:] in self.heads)

    def compile(self, state: int, byte: int) -> int:
        """The transition from a state over a byte."""
        head, lasts, counts = self.states[state]
        seen = head + chr(byte)
        ends = self.ends.get(seen)
        if ends is None:
            ends = self.ends[seen] = self.endings(seen)
        places, keep = ends
        pairs = self.pairs
        for at, token in places:
            last = lasts[at]
            if not last:  # a pretoken begins
                break
            apart = pairs.get((last, token))
            if apart is None:
                apart = pairs[last, token] = self.apart(last, token)
            if apart:
                break
        change = counts[at] + 1
        key = (seen[keep:], (*lasts[keep:], token), (*[c - change for c in counts[keep:]], 0))
        move = self.state(key) << 9 | change + 256
        self.moves[state << 8 | byte] = move
        return move

    def count(self, word: str) -> int:
        """Tokens of a pretoken."""
        if len(self.states) > MAX_STATES:
            self.begin()
        moves, state, n = self.moves.get, 0, 0
        for byte in word.encode("utf-8", "surrogatepass"):
            move = moves(state << 8 | byte)
            if move is None:
                if len(self.states) > 2 * MAX_STATES:  # one very long pretoken
                    here = self.states[state]
                    self.begin()
                    moves, state = self.moves.get, self.state(here)
                move = self.compile(state, byte)
            n += (move & 511) - 256
            state = move >> 9
        return n
