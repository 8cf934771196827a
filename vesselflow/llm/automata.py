"""Probabilistic automata inferred from examples by merging states of their prefix tree."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

#: Confidence parameter of the Hoeffding bound: a smaller one merges more.
ALPHA = 0.01
END = ""


def _group(symbol: str) -> str:
    """Characters that stand for each other where a state has not seen one of them."""
    if symbol.isdigit():
        return "0"
    return "a" if symbol.islower() else "A" if symbol.isupper() else symbol


class ProbabilisticAutomaton:
    """States with symbol counts, next states, and how often words end there."""

    def __init__(self, examples: Iterable[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for word in examples:
            self._add(word)
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._likely = [self._by_group(k) for k in range(len(self.next))]
        self._total = [self._arrivals(k) for k in range(len(self.next))]
        self.symbols = len({s for row in self.seen for s in row}) + 1

    def _add(self, word: str) -> None:
        state = 0
        for symbol in word:
            self.seen[state][symbol] = self.seen[state].get(symbol, 0) + 1
            if symbol not in self.next[state]:
                self.next[state][symbol] = len(self.next)
                self.next.append({})
                self.seen.append({})
                self.ends.append(0)
            state = self.next[state][symbol]
        self.ends[state] += 1

    def _arrivals(self, state: int) -> int:
        return self.ends[state] + sum(self.seen[state].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > (1 / math.sqrt(n) + 1 / math.sqrt(m)) * self._bound

    def _compatible(self, red: int, blue: int) -> bool:
        """Equal rates of ending and of each symbol, here and in all that follows in the tree."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            n, m = self._arrivals(a), self._arrivals(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for symbol in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(symbol, 0), n, self.seen[b].get(symbol, 0), m):
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[b] if s in self.next[a]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to the automaton at ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for symbol, child in self.next[b].items():
                self.seen[a][symbol] = self.seen[a].get(symbol, 0) + self.seen[b][symbol]
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], child))
                else:
                    self.next[a][symbol] = child

    def _merge_states(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = next(
                ((r, s, self.next[r][s]) for r in red for s in sorted(self.next[r]) if self.next[r][s] not in known),
                None,
            )
            if blue is None:
                break
            parent, symbol, state = blue
            like = next((r for r in red if self._compatible(r, state)), None)
            if like is None:
                red.append(state)
            else:
                self.next[parent][symbol] = like
                self._fold(like, state)
        place = {state: k for k, state in enumerate(red)}
        self.next = [{s: place[t] for s, t in self.next[r].items()} for r in red]
        self.seen = [self.seen[r] for r in red]
        self.ends = [self.ends[r] for r in red]

    def _by_group(self, state: int) -> dict[str, int]:
        best: dict[str, tuple[int, str]] = {}
        for symbol, n in sorted(self.seen[state].items()):
            if n > best.get(_group(symbol), (0, ""))[0]:
                best[_group(symbol)] = (n, symbol)
        return {g: self.next[state][symbol] for g, (_, symbol) in best.items()}

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm of the word's probability; minus infinity if no path has it."""
        state, total = 0, 0.0
        for symbol in word:
            target = self.next[state].get(symbol)
            if target is None:
                target = self._likely[state].get(_group(symbol))
                if target is None:
                    return -math.inf
            total += math.log((self.seen[state].get(symbol, 0) + 0.5) / (self._total[state] + 0.5 * self.symbols))
            state = target
        if not self.ends[state]:
            return -math.inf
        return total + math.log((self.ends[state] + 0.5) / (self._total[state] + 0.5 * self.symbols))

    def states(self) -> Iterator[tuple[int, int, int]]:
        """(state, arrivals, endings), for reports."""
        return ((k, self._total[k], self.ends[k]) for k in range(len(self.next)))
