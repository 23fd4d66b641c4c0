"""Generalised suffix automaton over sequences of integers."""

from __future__ import annotations

NONE = 1 << 63


class SuffixAutomaton:
    """Accepts every run of every added sequence; each state holds the smallest owner of its runs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [NONE]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(NONE)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for the runs of q that are one longer than those of p."""
        nxt, link, length = self.next, self.link, self.length
        if length[p] + 1 == length[q]:
            return q
        clone = self._state(length[p] + 1, link[q], dict(nxt[q]))
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, sequence, owner: int) -> None:
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        last = 0
        for w in sequence:
            q = nxt[last].get(w)
            if q is not None:
                last = self._split(last, q, w)
            else:
                cur = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    link[cur] = self._split(p, nxt[p][w], w)
                last = cur
            if owner < own[last]:
                own[last] = owner

    def finish(self) -> SuffixAutomaton:
        """Hand owners down the suffix links; call once after the last add."""
        link, own = self.link, self.owner
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if own[s] < own[link[s]]:
                own[link[s]] = own[s]
        return self

    def matching(self, sequence):
        """For each end position: the state and the length of the longest run that ends there."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for w in sequence:
            while w not in nxt[s] and s:
                s = link[s]
                n = length[s]
            t = nxt[s].get(w)
            if t is None:
                n = 0
            else:
                s, n = t, n + 1
            yield s, n

    def holder(self, state: int, at_least: int) -> int:
        """Smallest owner of the run of ``at_least`` symbols that ends in ``state``."""
        link, length = self.link, self.length
        while length[link[state]] >= at_least:
            state = link[state]
        return self.owner[state]
