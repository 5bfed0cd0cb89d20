"""External induced suffix sorting with common-prefix values.

Suffixes of a sequence are sorted by induction (after Bingmann, Fischer, Osipov 2013).  A
scan from the end finds the suffixes at local minima, their substrings up to the next
minimum are sorted and named, and the sequence of names is sorted by recursion where names
repeat.  A forward pass induces the descending suffixes from the minima, a backward pass
the ascending ones from the descending.  Common prefixes are carried along, up to ``CAP``
characters.

Everything that grows with the sequence lies on disk: the sequence, which is only read
from its end to its beginning; the substrings and ranks, in external sorts; the queues of
both passes, in heaps whose excess is in sorted runs; the passes' results, in files read in
one direction.  A queue's tuple carries the characters before its suffix back to the minimum
before, so that no pass looks anything up in the sequence, and the length of the run of its
first character, which is all that a common prefix of a descending and an ascending suffix
of one bucket depends on; a minimum carries ``CAP`` characters to compare with the next.
Memory holds ``HELD`` entries for each heap or sort that is open (a few at each of at most
log2(n) levels), one segment between minima, and a common-prefix stack of ``CAP`` entries.

The files are spill files of one task in its temporary folder, as Spark's own; if the task
is lost they are made again.  ``repeats.py`` says why the sorter isn't on the main path.
"""

from __future__ import annotations

import bisect
import heapq
import pickle
import tempfile
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np

#: Common prefixes are exact up to this length.
CAP = 100
#: Entries that a queue or a sort holds in memory.
HELD = 200_000
#: Entries in a block of a file; runs that may be open before they are merged into one.
BLOCK, FAN = 4096, 200


class DiskQueue:
    """A priority queue of tuples; what exceeds ``held`` entries lies on disk as sorted runs."""

    def __init__(self, held: int = HELD) -> None:
        self.held, self.heap, self.runs, self.spilled = held, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self.heap.sort()
            half = len(self.heap) // 2
            run = tempfile.TemporaryFile()
            for i in range(half, len(self.heap), BLOCK):
                pickle.dump(self.heap[i : i + BLOCK], run, pickle.HIGHEST_PROTOCOL)
            run.seek(0)
            self.spilled += len(self.heap) - half
            del self.heap[half:]
            if len(self.runs) >= FAN:
                self._merge()
            self._advance(run, [], 0)

    @staticmethod
    def _rest(run, block: list, at: int) -> Iterator[tuple]:
        """What is left of a run."""
        while True:
            yield from block[at:]
            try:
                block, at = pickle.load(run), 0
            except EOFError:
                run.close()
                return

    def _merge(self) -> None:
        """All runs into one."""
        merged, block = tempfile.TemporaryFile(), []
        for item in heapq.merge(*(self._rest(run, b, at) for _, _, run, b, at in self.runs)):
            block.append(item)
            if len(block) == BLOCK:
                pickle.dump(block, merged, pickle.HIGHEST_PROTOCOL)
                block = []
        if block:
            pickle.dump(block, merged, pickle.HIGHEST_PROTOCOL)
        merged.seek(0)
        self.runs = []
        self._advance(merged, [], 0)

    def _advance(self, run, block: list, at: int) -> None:
        if at == len(block):
            try:
                block, at = pickle.load(run), 0
            except EOFError:
                run.close()
                return
        heapq.heappush(self.runs, (block[at], id(run), run, block, at))

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, run, block, at = heapq.heappop(self.runs)
            self._advance(run, block, at + 1)
            return item
        return heapq.heappop(self.heap)


class Store:
    """Records in a file, appended, then read in either direction; a block is in memory."""

    def __init__(self) -> None:
        self.file, self.block, self.places, self.n = tempfile.TemporaryFile(), [], [], 0

    def append(self, item) -> None:
        self.block.append(item)
        self.n += 1
        if len(self.block) == BLOCK:
            self._write()

    def _write(self) -> None:
        self.places.append(self.file.tell())
        pickle.dump(self.block, self.file, pickle.HIGHEST_PROTOCOL)
        self.block = []

    def read(self, backward: bool = False) -> Iterator:
        """All records; nothing may be appended afterwards."""
        if self.block:
            self._write()
        for place in self.places[::-1] if backward else self.places:
            self.file.seek(place)
            block = pickle.load(self.file)
            yield from block[::-1] if backward else block


class Sorter:
    """An external sort: sorted runs of ``held`` items, merged."""

    def __init__(self, held: int = HELD) -> None:
        self.held, self.items, self.runs = held, [], []

    def push(self, item: tuple) -> None:
        self.items.append(item)
        if len(self.items) >= self.held:
            self.items.sort()
            run = Store()
            for x in self.items:
                run.append(x)
            self.runs.append(run)
            self.items = []
            if len(self.runs) >= FAN:
                merged = Store()
                for x in heapq.merge(*(run.read() for run in self.runs)):
                    merged.append(x)
                self.runs = [merged]

    def __iter__(self) -> Iterator[tuple]:
        self.items.sort()
        return heapq.merge(*(run.read() for run in self.runs), self.items)


class Numbers:
    """A file of numbers that is read from the last to the first."""

    def __init__(self, parts: Iterable[np.ndarray] = (), dtype: str = "<i4") -> None:
        self.file, self.dtype, self.n = tempfile.TemporaryFile(), np.dtype(dtype), 0
        for part in parts:
            self.add(part)

    def add(self, part) -> None:
        part = np.asarray(part, self.dtype)
        self.file.write(part.tobytes())
        self.n += len(part)

    def backward(self) -> Iterator[int]:
        end, size = self.n, 1 << 16
        while end:
            start = max(0, end - size)
            self.file.seek(start * self.dtype.itemsize)
            yield from np.frombuffer(self.file.read((end - start) * self.dtype.itemsize), self.dtype)[::-1].tolist()
            end = start


class _Reversed:
    """Numbers that are already in order from the last to the first, in a :class:`Store`."""

    def __init__(self, store: Store) -> None:
        self.store, self.n = store, store.n

    def backward(self) -> Iterator[int]:
        return self.store.read()


class _Minima:
    """Least common prefix among the extractions since one of them; at most ``CAP + 1`` entries."""

    def __init__(self) -> None:
        self.at, self.low, self.n = [], [], 0

    def add(self, lcp: int) -> int:
        while self.low and self.low[-1] >= lcp:
            self.at.pop()
            self.low.pop()
        self.at.append(self.n)
        self.low.append(lcp)
        self.n += 1
        return self.n - 1

    def since(self, i: int) -> int:
        k = bisect.bisect_right(self.at, i)
        return self.low[k] if k < len(self.low) else CAP


def _shared(a: tuple, b: tuple) -> int:
    """The common prefix of two carried contexts."""
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


def _scan(t, cap: int) -> Iterator[tuple[int, tuple, tuple, tuple]]:
    """(position, substring, characters back to the minimum before, context) of the minima, the last first.

    A minimum is an ascending suffix behind a descending one; the last character is one.
    """
    found, segment, ahead = None, [], deque(maxlen=cap)
    char = up = None
    i = t.n
    for c in t.backward():
        i -= 1
        ascends = char is None or c < char or c == char and up
        if char is not None and up and not ascends:  # i + 1 is a minimum
            left = tuple(x for x, _ in reversed(segment))
            if found is None:
                key = (2 * char + 1,)
            else:
                key = (*(2 * x + u for x, u in reversed(segment)), found[1][0])
                yield found[0], found[1], left, found[2]
            found, segment = (i + 1, key, tuple(ahead)), []
        segment.append((c, ascends))
        ahead.appendleft(c)
        char, up = c, ascends
    if found is not None:
        yield found[0], found[1], tuple(x for x, _ in reversed(segment)), found[2]


def _stars(t, held: int, cap: int) -> Iterator[tuple[int, tuple, tuple]]:
    """(position, characters before, context) of the minima in order of their suffixes."""
    told, pieces = Store(), Sorter(held)
    for j, (pos, key, left, ahead) in enumerate(_scan(t, cap)):
        told.append((pos, left, ahead))
        pieces.push((key, j))
    by_number, last, name, unique = Sorter(held), None, -1, True
    for key, j in pieces:
        if key != last:
            name, last = name + 1, key
        else:
            unique = False
        by_number.push((j, name))
    if not unique:
        names = Store()
        for _, name in by_number:
            names.append(name)
        by_number = Sorter(held)
        for rank, (k, _) in enumerate(sort_suffixes(_Reversed(names), held, prefixes=False)):
            by_number.push((told.n - 1 - k, rank))
    by_rank = Sorter(held)
    for (pos, left, ahead), (_, rank) in zip(told.read(), by_number):
        by_rank.push((rank, pos, left, ahead))
    for _, pos, left, ahead in by_rank:
        yield pos, left, ahead


def sort_suffixes(t, held: int = HELD, prefixes: bool = True) -> Iterator[tuple[int, int]]:
    """(position, common prefix with the one before) of all suffixes in order.

    ``t`` is a list or has ``n`` and ``backward()``; its last character must be smaller than
    all others.  Without ``prefixes`` all of them are 0, and nothing depends on the alphabet.
    """
    if not hasattr(t, "backward"):
        t = Numbers([t], "<i8")
    if t.n <= 1:
        yield from ((i, 0) for i in range(t.n))
        return

    # Forward: descending suffixes.  Tuples: (character, rank, position, characters before, how many, lcp, run).
    queue, rank, low, last_of = DiskQueue(held), 0, _Minima(), {}
    down, seeds = Store(), Store()  # (character, position, lcp, run); seeds: those with an ascending one before
    stars = _stars(t, held, CAP if prefixes else 1)
    star, seed_low, prev = next(stars, None), CAP, (-1, 0, None)  # prev: character, run, context of a minimum

    def reached(c: int, here: int) -> int:
        """The common prefix of a suffix induced from extraction ``here`` with the one induced before it."""
        lcp = min(CAP, 1 + low.since(last_of[c])) if c in last_of else 0
        last_of[c] = here
        return lcp

    while star is not None or queue.peek() is not None:
        top = queue.peek()
        if top is not None and (star is None or top[0] <= star[2][0]):
            c, _, pos, left, m, lcp, run = queue.pop()
            lcp = lcp if c == prev[0] else 0
            ahead = None
            descends = m > 0 and left[m - 1] >= c
        else:
            pos, left, ahead = star
            c, m, star = ahead[0], len(left), next(stars, None)
            run = next((k for k, x in enumerate(ahead) if x != c), len(ahead))
            lcp = 0 if c != prev[0] else min(run, prev[1]) if prev[2] is None else _shared(ahead, prev[2])
            descends = m > 0
        here = low.add(lcp) if prefixes else 0
        seed_low = min(seed_low, lcp)
        if ahead is None:
            down.append((c, pos, lcp, run))
            if m > 0 and not descends:
                seeds.append((c, pos, left, m, seed_low if seeds.n else 0, run))
                seed_low = CAP
        if descends:
            d = left[m - 1]
            queue.push((d, rank, pos - 1, left, m - 1, reached(d, here) if prefixes else 0, min(CAP, run + 1) if d == c else 1))
            rank += 1
        prev = (c, run, ahead)

    # Backward: ascending suffixes, from the last seed; characters are negated.
    queue, rank, low, last_of = DiskQueue(held), 0, _Minima(), {}
    up = Store()  # (character, position, lcp to the one after, run) from the last
    back = seeds.read(backward=True)
    seed, after, prev = next(back, None), 0, (-1, 0, False)  # after: the last seed's lcp; prev: character, run, whether a seed
    while seed is not None or queue.peek() is not None:
        top = queue.peek()
        if top is not None and (seed is None or -top[0] >= seed[0]):
            c, _, pos, left, m, lcp, run = queue.pop()
            c = -c
            lcp = lcp if c == prev[0] else 0
            from_seed = False
            up.append((c, pos, lcp, run))
        else:
            c, pos, left, m, before, run = seed
            lcp = 0 if c != prev[0] else after if prev[2] else min(run, prev[1])
            from_seed, after, seed = True, before, next(back, None)
        here = low.add(lcp) if prefixes else 0
        if m > 0:  # all characters before are of ascending suffixes
            d = left[m - 1]
            queue.push((-d, rank, pos - 1, left, m - 1, reached(d, here) if prefixes else 0, min(CAP, run + 1) if d == c else 1))
            rank += 1
        prev = (c, run, from_seed)

    # The last suffix, then bucket by bucket descending ones before ascending ones.
    yield t.n - 1, 0
    falls, rises = down.read(), up.read(backward=True)
    fall, rise, last_fall, last_rise = next(falls, None), next(rises, None), None, None
    while fall is not None or rise is not None:
        if fall is not None and (rise is None or fall[0] <= rise[0]):
            yield fall[1], fall[2]
            last_fall, fall = fall, next(falls, None)
        else:
            c, pos, _, run = rise
            if last_rise is not None and last_rise[0] == c:
                lcp = last_rise[2]
            elif last_fall is not None and last_fall[0] == c:
                lcp = min(run, last_fall[3])
            else:
                lcp = 0
            yield pos, lcp
            last_rise, rise = rise, next(rises, None)
