"""Double-array tries over phrases of words, built and walked by array operations.

A word's symbol is its rank among the trie's words, in two digits of 10 bits; a phrase is a path of digits. A state is a slot; the child of state s
by digit d is slot base[s] + d if check there is s. Leaves hold -1 - (number of the phrase) as base.
"""

from __future__ import annotations

import numpy as np

DIGIT = 10
#: Words a trie can number.
WORDS = 1 << 2 * DIGIT
_MASK = (1 << DIGIT) - 1


def _place(parents: np.ndarray, digits: np.ndarray, states: int) -> tuple[np.ndarray, int]:
    """(base of each state, slots): edges are sorted by parent; children of no two states get the same slot, and slot 0 is the root's."""
    size = 2 * len(parents) + 4 * (1 << DIGIT)
    taken = np.zeros(size, bool)
    taken[0] = True
    base = np.zeros(states, np.int64)
    owners, first, count = np.unique(parents, return_index=True, return_counts=True)
    rng = np.random.Generator(np.random.PCG64(7))
    large, low = np.flatnonzero(count >= 16), 1 << DIGIT
    for i in large[np.argsort(-count[large], kind="stable")]:  # states with many children: the first fit behind a mark that moves on
        d = digits[first[i] : first[i] + count[i]]
        slot, at = low, -1
        while at < 0:
            if slot + (2 << DIGIT) > size:
                taken, size = np.append(taken, np.zeros(size, bool)), 2 * size
            free = np.flatnonzero(~taken[slot : slot + 512]) + slot
            fits = ~taken[free[:, None] + (d - d[0])].any(axis=1)
            if fits.any():
                at = int(free[fits.argmax()]) - int(d[0])
            slot += 512
        base[owners[i]] = at
        taken[at + d] = True
        low = max(low, slot - (8 << DIGIT))
    wait = np.flatnonzero((count > 1) & (count < 16))
    rounds = 0
    while len(wait):  # states with a few children: all try a random place at once, those without a conflict keep it
        rounds += 1
        if rounds % 64 == 0:
            taken, size = np.append(taken, np.zeros(size, bool)), 2 * size
        try_at = rng.integers(1, size - (1 << DIGIT), len(wait))
        n = count[wait]
        edge = np.repeat(first[wait] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of = np.repeat(np.arange(len(wait)), n)
        slot = try_at[of] + digits[edge]
        bad = taken[slot]
        _, once = np.unique(slot, return_index=True)
        again = np.ones(len(slot), bool)
        again[once] = False
        failed = np.zeros(len(wait), bool)
        failed[of[bad | again]] = True
        taken[slot[~failed[of]]] = True
        base[owners[wait[~failed]]] = try_at[~failed]
        wait = wait[failed]
    alone = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken)
    free = free[free >= 1 << DIGIT]
    if len(free) < len(alone):
        free = np.append(free, np.arange(size, size + len(alone)))
    base[owners[alone]] = free[: len(alone)] - digits[first[alone]]
    return base, int(max(size, free[: len(alone)].max(initial=0) + 1)) + (1 << DIGIT)


class Trie:
    """words: sorted hashes of the words; base, check: the double array."""

    def __init__(self, words: np.ndarray, base: np.ndarray, check: np.ndarray):
        self.words, self.base, self.check = words, base, check

    @classmethod
    def build(cls, phrases: np.ndarray) -> Trie:
        """phrases: a row of word hashes for each phrase, all different; the number of a phrase is its row."""
        words = np.unique(phrases)
        if len(words) > WORDS:
            raise ValueError("too many words for one trie")
        codes = np.searchsorted(words, phrases)
        path = np.stack([codes >> DIGIT, codes & _MASK], axis=2).reshape(len(phrases), -1)
        state, states, edges = np.zeros(len(phrases), np.int64), 1, []
        for level in range(path.shape[1]):
            key, state = np.unique(state << DIGIT | path[:, level], return_inverse=True)
            edges.append((key >> DIGIT, key & _MASK, np.arange(states, states + len(key))))
            state, states = state + states, states + len(key)
        parents, digits, children = (np.concatenate(x) for x in zip(*edges))
        base, slots = _place(parents, digits, states)
        slot = np.zeros(states, np.int64)
        slot[children] = base[parents] + digits
        out, check = np.zeros(slots, np.int32), np.full(slots, -1, np.int32)
        out[slot] = base
        check[slot[children]] = slot[parents]
        out[slot[state]] = -1 - np.arange(len(phrases))
        return cls(words, out, check)

    def match(self, phrases: np.ndarray) -> np.ndarray:
        """The number of each row's phrase, or -1; the states of all rows advance together, level by level."""
        state, at = np.zeros(len(phrases), np.int64), np.arange(len(phrases))
        for k in range(phrases.shape[1]):
            w = phrases[at, k]
            code = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            known = self.words[code] == w
            at, state, code = at[known], state[known], code[known]
            for shift in (DIGIT, 0):
                child = self.base[state] + ((code >> shift) & _MASK)
                on = self.check[child] == state
                at, state, code = at[on], child[on], code[on]
        out = np.full(len(phrases), -1, np.int64)
        out[at] = -1 - self.base[state].astype(np.int64)
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.words), len(self.base)], "<i8")
        return head.tobytes() + self.words.astype("<u8").tobytes() + self.base.astype("<i4").tobytes() + self.check.astype("<i4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Trie:
        n, m = np.frombuffer(raw, "<i8", 2)
        return cls(np.frombuffer(raw, "<u8", n, 16), np.frombuffer(raw, "<i4", m, 16 + 8 * n), np.frombuffer(raw, "<i4", m, 16 + 8 * n + 4 * m))
