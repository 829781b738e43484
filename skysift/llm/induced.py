"""Suffix sorting by external induction, with common-prefix values.

The scheme of Bingmann, Fischer and Osipov ("Inducing Suffix and LCP Arrays in External Memory"): suffixes that start a rise
(S*) are sorted first, through names of the stretches between them and a recursive call on the string of names; then all
falling suffixes (L) are induced in ascending and all rising ones (S) in descending order.  The queue that carries tuples of
place and common prefix is a priority queue by first letter: as tuples arrive in the order in which they must leave, each
letter is a first-in first-out list, and lists beyond ``memory`` tuples go to files in the shared folder.  A letter's list
is taken in waves: what a wave inserts under its own letter is the next wave.  Every step is a numpy operation on a wave.

The common prefix of two tuples that follow each other under a letter is one more than the smallest value between the tuples
that induced them.  Values are exact up to ``CAP``.

Only the string itself stays in memory (one item a letter); tuples, ten times as large, need not.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from skysift.llm import files

CAP = 120


class LetterQueue:
    """Tuples ``place, prefix`` by letter; letters leave in ascending (or descending) order, tuples as they came."""

    def __init__(self, memory: int, folder: str | None, descending: bool = False):
        self.memory, self.folder, self.sign = memory, folder, -1 if descending else 1
        self.lists: dict[int, list] = {}
        self.heap: list[int] = []
        self.held = 0
        self.spilled = 0

    def push(self, letter: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        if letter not in self.lists:
            self.lists[letter] = []
            heapq.heappush(self.heap, self.sign * letter)
        self.lists[letter].append((places, prefixes))
        self.held += len(places)
        if self.held > self.memory and self.folder:
            self._spill()

    def _spill(self) -> None:
        """Write all that is held, one segment for each letter."""
        name = files.new_name(self.folder, 0, ".queue")
        at = 0
        with files.create(name) as out:
            for parts in self.lists.values():
                own = [p for p in parts if p[0] is not None and not isinstance(p[0], str)]
                if own:
                    places, prefixes = (np.concatenate(x) for x in zip(*own, strict=True))
                    data = places.astype("<i8").tobytes() + prefixes.astype("u1").tobytes()
                    out.write(data)
                    parts[:] = [p for p in parts if isinstance(p[0], str)] + [(name, (at, len(places)))]
                    at += len(data)
        self.spilled += self.held
        self.held = 0

    def letters(self) -> Iterator[int]:
        while self.heap:
            yield self.sign * self.heap[0]
            heapq.heappop(self.heap)

    def pop(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a letter that are there now."""
        parts, self.lists[letter] = self.lists.get(letter, []), []
        out = []
        for first, second in parts:
            if isinstance(first, str):
                at, n = second
                data = files.read(first, at, 9 * n)
                out.append((np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n)))
            else:
                self.held -= len(first)
                out.append((first, second))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return (np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])) if len(out) > 1 else out[0]

    def reserve(self, letter: int) -> None:
        """Make a letter leave in its turn even if nothing is pushed."""
        if letter not in self.lists:
            self.lists[letter] = []
            heapq.heappush(self.heap, self.sign * letter)


class _Inserter:
    """Turns tuples that leave the queue, in order, into those that they induce."""

    def __init__(self, text: np.ndarray, queue: LetterQueue):
        self.text, self.queue = text, queue
        self.low: dict[int, int] = {}  # smallest value since the last insertion under a letter

    def take(self, places: np.ndarray, prefixes: np.ndarray, keep) -> None:
        """``keep(letters before)`` tells which predecessors are induced."""
        if not len(places):
            return
        before = places - 1
        letters = self.text[before]  # place 0 wraps round and is dropped below
        inserts = np.flatnonzero(keep(letters) & (before >= 0))
        seen = set()
        if len(inserts):
            own = letters[inserts]
            order = np.argsort(own, kind="stable")
            ranked = own[order]
            edges = [0, *(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1).tolist(), len(ranked)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                letter = int(ranked[a])
                at = inserts[order[a:b]]
                starts = np.concatenate([[0], at + 1])
                tail = starts[-1] < len(prefixes)
                lows = np.minimum.reduceat(prefixes, starts if tail else starts[:-1])
                values = np.minimum(lows[: b - a].astype(np.int16) + 1, CAP).astype(np.uint8)
                values[0] = min(int(lows[0]), self.low[letter]) + 1 if letter in self.low else 0
                values[0] = min(int(values[0]), CAP)
                self.low[letter] = int(lows[-1]) if tail else CAP
                self.queue.push(letter, before[at], values)
                seen.add(letter)
        least = int(prefixes.min())
        for letter, low in self.low.items():
            if letter not in seen and least < low:
                self.low[letter] = least


def _runs(text: np.ndarray) -> np.ndarray:
    """For each place, how many equal letters stand from there on."""
    n = len(text)
    ends = np.full(n, n, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends[change] = change + 1
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)


def _rises(text: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """True for S: the suffix is smaller than the next one.  The end counts as smaller than every letter."""
    after = np.arange(len(text)) + runs
    inside = after < len(text)
    out = np.zeros(len(text), bool)
    out[inside] = text[after[inside]] > text[inside]
    return out


def _names(text: np.ndarray, rising: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Rank of the stretch from each S* place to the next, both ends included; equal stretches have equal ranks.

    Letters count with their kind, so no stretch is the start of another one.
    """
    top = int(text.max()) if len(text) else 0
    bits = (2 * (top + 1) + 1).bit_length()
    each = max(1, 62 // bits)
    lengths = np.diff(np.append(stars, len(text))) + 1
    rank = np.zeros(len(stars), np.int64)
    open_ = np.arange(len(stars))
    at = 0
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        for j in range(at, at + each):
            place = stars[open_] + j
            there = (j < lengths[open_]) & (place < len(text))
            place = np.where(there, place, 0)
            key = key << bits | np.where(there, 2 * (text[place].astype(np.int64) + 1) + rising[place], 0)
        at += each
        order = np.lexsort((key, rank[open_])) if at > each else np.argsort(key, kind="stable")
        r, k = rank[open_][order], key[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
        # ranks count what is smaller, so a group can be split later without moving others
        group = np.concatenate([[True], r[1:] != r[:-1]])
        here = np.arange(len(r))
        first = np.maximum.accumulate(np.where(group, here, 0))
        fresh = r + np.maximum.accumulate(np.where(new, here, 0)) - first
        rank[open_[order]] = fresh
        edges = np.flatnonzero(new)
        sizes = np.diff(np.append(edges, len(r)))
        tied = np.repeat(sizes > 1, sizes)
        again = order[tied]
        open_ = np.sort(open_[again])
        open_ = open_[lengths[open_] > at]
    return rank


def _double(names: np.ndarray, rounds: int | None) -> np.ndarray:
    """Order of the suffixes of a short string of names, by doubling; only ties are sorted again.

    After ``rounds`` rounds ties are left in any order (their common part is longer than anyone asks for).
    """
    n = len(names)
    rank = names.astype(np.int64)
    tied = np.arange(n)
    step, done = 1, 0
    while len(tied) and step < 2 * n and (rounds is None or done < rounds):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * np.int64(n + 2) + second
        order = np.argsort(key)
        k = key[order]
        r = rank[tied][order]
        here = np.arange(len(k))
        new = np.concatenate([[True], k[1:] != k[:-1]])
        group = np.concatenate([[True], r[1:] != r[:-1]])
        first = np.maximum.accumulate(np.where(group, here, 0))
        rank[tied[order]] = r + np.maximum.accumulate(np.where(new, here, 0)) - first
        sizes = np.diff(np.append(np.flatnonzero(new), len(k)))
        tied = tied[order[np.repeat(sizes > 1, sizes)]]
        step, done = 2 * step, done + 1
    return np.argsort(rank, kind="stable")


def _prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each place in ``order`` with the one before, up to ``CAP``: whole words first, then letters."""
    size = text.itemsize
    each = 8 // size
    padded = np.concatenate([text, np.zeros(CAP + each, text.dtype)])
    words = np.lib.stride_tricks.as_strided(padded, (len(text) + CAP, 8), (size, 1)) if size == 1 else None
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for j in range(0, CAP, each):
        a, b = order[open_ - 1] + j, order[open_] + j
        if words is not None:
            differ = words[a].view(np.uint64)[:, 0] ^ words[b].view(np.uint64)[:, 0]
            low = differ & (~differ + np.uint64(1))  # lowest differing bit: the first letter that differs, as bytes are little-endian
            same = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) >> 3)
        else:
            same = np.zeros(len(open_), np.int64)
            for k in range(each):
                same += (same == k) & (padded[np.minimum(a + k, len(padded) - 1)] == padded[np.minimum(b + k, len(padded) - 1)])
        out[open_] = j + same
        open_ = open_[same == each]
    room = len(text) - np.maximum(order, np.concatenate([order[:1], order[:-1]]))
    return np.minimum(np.minimum(out, room), CAP).astype(np.uint8)


def suffixes(text: np.ndarray, memory: int = 1 << 24, folder: str | None = None, rounds: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffix array in pieces: places in order, and common prefixes with the place before (up to ``CAP``).

    ``text`` holds unsigned integers.  ``rounds`` limits the depth to which ties are told apart (``None``: wholly).
    """
    n = len(text)
    if not n:
        return
    runs = _runs(text)
    rising = _rises(text, runs)
    stars = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    names = _names(text, rising, stars)
    if len(stars) <= memory:
        order = stars[_double(names, rounds)]
    else:
        dense = np.unique(names, return_inverse=True)[1].astype(np.uint32)
        order = stars[np.concatenate([p for p, _ in suffixes(dense, memory, folder, rounds)])]
    del names
    first = text[order]
    seeds_low = _prefixes(text, order)
    edges = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]]) if len(first) else np.zeros(1, np.int64)
    seeds = {int(first[a]): (order[a:b], seeds_low[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}

    queue = LetterQueue(memory, folder)
    falling = LetterQueue(memory, folder)  # what was taken, kept for the way down
    for letter in seeds:
        queue.reserve(letter)
    queue.push(int(text[-1]), np.array([n - 1]), np.zeros(1, np.uint8))
    into = _Inserter(text, queue)
    into.low[int(text[-1])] = CAP  # the last letter was induced by the empty suffix
    last: dict[int, int] = {}
    for letter in queue.letters():
        started = False
        while True:
            places, low = queue.pop(letter)
            if not len(places):
                break
            if not started:
                low = low.copy()
                low[0] = 0
            started = True
            falling.push(letter, places, low)
            last[letter] = int(places[-1])
            into.take(places, low, lambda before, letter=letter: before >= letter)
        if letter in seeds:
            places, low = seeds[letter]
            low = low.copy()
            low[0] = min(int(runs[last[letter]]), int(runs[places[0]]), CAP) if started else 0
            into.take(places, low, lambda before, letter=letter: before > letter)
    del seeds, order, queue

    down = LetterQueue(memory, folder, descending=True)
    out = LetterQueue(memory, folder)
    for letter in falling.lists:
        down.reserve(letter)
    into = _Inserter(text, down)
    for letter in down.letters():
        waves = []
        while True:
            places, low = down.pop(letter)
            if not len(places):
                break
            if not waves:
                low = low.copy()
                low[0] = 0
            waves.append((places, low))
            into.take(places, low, lambda before, letter=letter: before <= letter)
        places, low = falling.pop(letter)
        up, up_low = (np.concatenate(x) for x in zip(*waves, strict=True)) if waves else (places[:0], low[:0])
        border = 0
        if len(places):
            if len(up):
                border = min(int(runs[places[-1]]), int(runs[up[-1]]), CAP)
            back = np.concatenate([[border], low[:0:-1]]).astype(np.uint8)
            into.take(places[::-1], back, lambda before, letter=letter: before < letter)
        ascending = np.concatenate([[border], up_low[:0:-1]]).astype(np.uint8) if len(up) else up_low
        out.push(letter, np.concatenate([places, up[::-1]]), np.concatenate([low, ascending]))
    for letter in out.letters():
        yield out.pop(letter)
