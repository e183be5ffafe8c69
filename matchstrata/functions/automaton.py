"""An automaton over many patterns that finds those contained in a text in one walk."""

from __future__ import annotations

from collections import deque


class Patterns:
    """A trie of patterns whose states also know where to go on when no arc fits, and the longest pattern that ends in them."""

    def __init__(self, patterns: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.longest: list[tuple[int, str, int]] = [(0, "", -1)]
        for number, pattern in enumerate(patterns):
            state = 0
            for sign in pattern:
                following = self.arcs[state].get(sign)
                if following is None:
                    following = self.arcs[state][sign] = len(self.arcs)
                    self.arcs.append({})
                    self.longest.append((0, "", -1))
                state = following
            self.longest[state] = max(self.longest[state], (len(pattern), pattern, number))
        self.back = [0] * len(self.arcs)
        waiting = deque(self.arcs[0].values())
        while waiting:
            state = waiting.popleft()
            # Nearer states are complete: the longest pattern that ends here may begin further right.
            self.longest[state] = max(self.longest[state], self.longest[self.back[state]])
            for sign, following in self.arcs[state].items():
                self.back[following] = self._next(self.back[state], sign)
                waiting.append(following)

    def _next(self, state: int, sign: str) -> int:
        while state and sign not in self.arcs[state]:
            state = self.back[state]
        return self.arcs[state].get(sign, 0)

    def find(self, text: str) -> int:
        """Number of the longest pattern contained in ``text``, of equally long ones the last in order; -1 without one."""
        state, best = 0, (0, "", -1)
        for sign in text:
            state = self._next(state, sign)
            if self.longest[state][0] >= best[0] and self.longest[state] > best:
                best = self.longest[state]
        return best[2]
