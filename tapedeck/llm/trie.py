"""Double-array tries over rows of word codes, built and walked with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nodes with more children than this are placed one by one, the others many at a time at random.
FEW = 6


@dataclass
class Trie:
    """The child of state s by digit d is base[s] + d where check[base[s] + d] == s. A word is two digits, high and low.

    accept holds a row's number at the state that its last word leads to, else -1.
    """

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    radix: int
    n_rows: int

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states go on by their word (codes from 0; -1: unknown), and the states that those reach."""
        alive = np.flatnonzero(words >= 0)
        states, words = states[alive], words[alive]
        for high in (True, False):
            child = self.base[states] + (words // self.radix if high else words % self.radix)
            found = np.flatnonzero(self.check[child] == states)
            alive, states, words = alive[found], child[found], words[found]
        return alive, states


def build(rows: np.ndarray, n_words: int) -> Trie:
    """The trie of the distinct rows of word codes (-1 after a row's end)."""
    radix = max(2, int(np.ceil(np.sqrt(n_words))))
    n, depth = rows.shape
    node = np.zeros(n, np.int64)
    parents, digits, last, made = [], [], np.zeros(n, np.int64), 1
    for j in range(depth):
        live = np.flatnonzero(rows[:, j] >= 0)
        for part in (rows[live, j] // radix, rows[live, j] % radix):
            pairs, which = np.unique(node[live] * radix + part, return_inverse=True)
            parents.append(pairs // radix)
            digits.append(pairs % radix)
            node[live] = made + which
            made += len(pairs)
        last[live] = node[live]
    parents = np.concatenate(parents) if parents else np.zeros(0, np.int64)
    digits = np.concatenate(digits) if digits else np.zeros(0, np.int64)
    bases, size = _placed(parents, digits, made, radix)
    at = np.zeros(made, np.int64)
    at[1:] = bases[parents] + digits
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[at] = bases
    check[at[1:]] = at[parents]
    accept[at[last]] = np.arange(n)
    return Trie(base, check, accept, radix, n)


def _placed(parents: np.ndarray, digits: np.ndarray, made: int, radix: int) -> tuple[np.ndarray, int]:
    """A base for each node, so that no two children share a place, and the number of places (place 0 is the root's)."""
    order = np.argsort(parents, kind="stable")
    digits = digits[order]
    counts = np.bincount(parents, minlength=made)
    starts = np.concatenate([[0], np.cumsum(counts)])
    size = 3 * made + 4 * radix
    taken = np.zeros(size, bool)
    taken[0] = True
    bases, low = np.zeros(made, np.int64), 1
    for v in sorted(np.flatnonzero(counts > FEW), key=lambda v: -counts[v]):
        own = digits[starts[v] : starts[v + 1]]
        b = max(1, low - int(own[0]))
        while True:
            if b + 64 + radix > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken) // 2 + 128, bool)])
            free = np.flatnonzero(~taken[np.arange(b, b + 64)[:, None] + own].any(axis=1))
            if len(free):
                b += int(free[0])
                break
            b += 64
        bases[v] = b
        taken[b + own] = True
        while taken[low : low + 1024].mean() > 0.9:
            low += 1024
    rest, random = np.flatnonzero((counts > 0) & (counts <= FEW)), np.random.default_rng(0)
    while len(rest):
        size = len(taken)
        tried = random.integers(1, size - radix, len(rest))
        owner = np.repeat(np.arange(len(rest)), counts[rest])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts[rest]) - counts[rest], counts[rest])
        places = tried[owner] + digits[np.repeat(starts[rest], counts[rest]) + within]
        # the first to ask for a free place gets it; who doesn't get all its places asks again elsewhere
        first = np.zeros(len(places), bool)
        first[np.unique(places, return_index=True)[1]] = True
        lost = np.zeros(len(rest), bool)
        lost[owner[taken[places] | ~first]] = True
        bases[rest[~lost]] = tried[~lost]
        taken[places[~lost[owner]]] = True
        rest = rest[lost]
    return bases, len(taken) + radix
