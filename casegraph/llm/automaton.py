"""Regular expressions over bytes as one minimal deterministic automaton.

Patterns are plain regular expressions: literals, ``\\xHH`` and ``\\`` escapes, classes with ranges, groups, ``|``, ``?``, ``*`` and ``+``. Each is
turned into a nondeterministic automaton; all of them, with a loop before the first byte, become one deterministic automaton by subset
construction over classes of bytes that no pattern tells apart; states that no continuation tells apart are merged by partition refinement.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np


class _Parser:
    """Builds the moves of a nondeterministic automaton: ``empty`` without a byte, ``on`` with one of a set of bytes."""

    def __init__(self, pattern: str, fold: bool, empty: list[list[int]], on: list[list[tuple[frozenset, int]]]) -> None:
        self.pattern, self.at, self.fold, self.empty, self.on = pattern, 0, fold, empty, on

    def state(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.empty) - 1

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def choice(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            lo, hi = self.sequence()
            self.empty[first].append(lo)
            self.empty[hi].append(last)
            if self.peek() != "|":
                return first, last
            self.take()

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.peek() not in ("", "|", ")"):
            lo, hi = self.repeated()
            self.empty[last].append(lo)
            last = hi
        return first, last

    def repeated(self) -> tuple[int, int]:
        lo, hi = self.atom()
        while self.peek() and self.peek() in "?*+":
            how, first, last = self.take(), self.state(), self.state()
            self.empty[first].append(lo)
            self.empty[hi].append(last)
            if how != "+":
                self.empty[first].append(last)
            if how != "?":
                self.empty[hi].append(lo)
            lo, hi = first, last
        return lo, hi

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.take()
            if self.pattern.startswith("?:", self.at):
                self.at += 2
            found = self.choice()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.pattern}")
            return found
        chars = self.members() if self.peek() == "[" else {self.char()}
        if self.fold:
            chars |= {ord(x) for c in chars if chr(c).isascii() and chr(c).isalpha() for x in (chr(c).lower(), chr(c).upper())}
        first, last = self.state(), self.state()
        self.on[first].append((frozenset(chars), last))
        return first, last

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.pattern[self.at - 2 : self.at], 16)
            if c.isalnum():
                raise ValueError(f"escape not supported in {self.pattern}")
        elif c in "{}^$." or not c.isascii():
            raise ValueError(f"{c} not supported in {self.pattern}")
        return ord(c)

    def members(self) -> set[int]:
        self.take()
        chars: set[int] = set()
        while self.peek() != "]":
            lo = hi = ord(self.take()) if self.peek() in "{}$." else self.char()
            if self.peek() == "-" and self.pattern[self.at + 1] != "]":
                self.take()
                hi = self.char()
            chars |= set(range(lo, hi + 1))
        self.take()
        return chars


@dataclass
class Automaton:
    """``move[state, kind[byte]]``; ``accepts[state]`` and ``alive[state]`` are bit sets of patterns: matched here, and begun (or matched) here."""

    kind: np.ndarray
    move: np.ndarray
    accepts: np.ndarray
    alive: np.ndarray

    def start(self) -> list:
        """State 0 as a list of the states that follow by kind of byte, each such a list itself and with its number as last entry: what :func:`run` follows."""
        rows: list[list] = [[] for _ in range(len(self.move))]
        for state, row in enumerate(rows):
            row += [rows[to] for to in self.move[state].tolist()]
            row.append(state)
        return rows[0]


def run(start: list, kinds: bytes) -> np.ndarray:
    """The state's number after each byte of a text given as kinds of bytes."""
    states = accumulate(kinds, operator.getitem, initial=start)
    return np.fromiter(map(operator.itemgetter(-1), states), np.uint16, len(kinds) + 1)[1:]


def _minimal(move: np.ndarray, told: list) -> tuple[np.ndarray, np.ndarray]:
    """Groups of states that nothing tells apart, by refining ``told`` until it is stable. Returns group by state and one state of each group; state 0's group is 0."""
    _, group = np.unique(np.array(told), axis=0, return_inverse=True)
    group = group.ravel()
    while True:
        _, one, finer = np.unique(np.column_stack([group, group[move]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    swap = np.arange(len(one))
    swap[[0, finer[0]]] = swap[[finer[0], 0]]
    return swap[finer], one[swap]


def compile_rules(patterns: list[tuple[str, bool]], *, anchored: bool = False, limit: int = 1 << 15) -> Automaton:
    """(pattern, fold ASCII case) -> one automaton over all bytes. Anchored, a match can begin at the first byte only. Raises above ``limit`` states."""
    empty: list[list[int]] = []
    on: list[list[tuple[frozenset, int]]] = []
    begins, owner, final = [], {}, {}
    for k, (pattern, fold) in enumerate(patterns):
        parser, low = _Parser(pattern, fold, empty, on), len(empty)
        first, last = parser.choice()
        if parser.at != len(pattern):
            raise ValueError(f"unbalanced group in {pattern}")
        begins.append(first)
        final[last] = k
        owner |= dict.fromkeys(range(low, len(empty)), k)

    def closure(states: set[int]) -> int:
        todo, seen = list(states), set(states)
        while todo:
            for to in empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return sum(1 << s for s in seen)

    # Bytes of one class are in the same sets of the patterns.
    sets = sorted({chars for moves in on for chars, _ in moves}, key=sorted)
    member = np.array([[b in chars for chars in sets] for b in range(256)])
    _, sample, kind = np.unique(member, axis=0, return_index=True, return_inverse=True)
    kind = kind.ravel()
    # A subset of states is the bits of a number; only states with moves on bytes count for what follows.
    after = {s: [sum({closure({t}) for chars, t in moves if b in chars}) for b in sample.tolist()] for s, moves in enumerate(on) if moves}
    movers = sum(1 << s for s in after)
    root = closure(set(begins))
    number, order, moves = {root: 0}, [root], []
    for subset in order:
        row = [0 if anchored else root] * len(sample)
        left = subset & movers
        while left:
            low = left & -left
            left ^= low
            for c, to in enumerate(after[low.bit_length() - 1]):
                if to:
                    row[c] |= to
        for then in row:
            if then not in number:
                number[then] = len(order)
                order.append(then)
                if len(order) > limit:
                    raise ValueError(f"over {limit} states")
        moves.append([number[then] for then in row])
    ends = {1 << s: 1 << k for s, k in final.items()}
    of = [sum(1 << s for s, k in owner.items() if k == rule) for rule in range(len(patterns))]
    accepts = [sum(bit for end, bit in ends.items() if subset & end) for subset in order]
    begun = [sum(1 << k for k, mine in enumerate(of) if (subset if anchored and subset != root else subset & ~root) & mine) for subset in order]
    move = np.array(moves)
    group, one = _minimal(move, list(zip(accepts, begun, strict=True)))
    return Automaton(kind.astype(np.uint8), group[move[one]].astype(np.uint16), np.array(accepts, np.int64)[one], np.array(begun, np.int64)[one])
