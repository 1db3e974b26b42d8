"""A generalised suffix automaton: of several sequences of numbers, built one after another."""

from __future__ import annotations


class SuffixAutomaton:
    """States are numbered, 0 is the start; next has a state's moves, link its suffix link, length its longest word's."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest word followed by c; it is split off its state if others are in it."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        """The state after c, where last is the state of all that was read of this sequence."""
        moves, link = self.next, self.link
        if c in moves[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            link[new] = self._split(p, c)
        return new

    def by_length(self, longest_first: bool = False) -> list[int]:
        """All states but the start, in order of their longest words."""
        return sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=longest_first)
