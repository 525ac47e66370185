"""External induced suffix sorting of one shard, with common-prefix values.

The byte string lies in a file and is mapped, never read whole. Suffixes are
sorted as far as their first ``depth`` bytes:

* Suffixes are classed as S (smaller than the next suffix) or L; the leftmost S
  of each run is a sample. Samples go to disk by first byte, and each of these
  buckets is sorted by eight bytes at a time, only ties going on; the round in
  which two neighbours part gives their common prefix.
* Scanning upwards, each suffix (first the samples' predecessors, then theirs)
  induces the L suffix before it; scanning downwards, each induces the S suffix
  before it. The priority queue of an induction holds (position, common prefix)
  tuples by first byte in disk-backed first-in-first-out parts, since tuples of
  one byte arrive in order. The common prefix of two neighbours in a part is one
  more than the least common prefix passed between their successors.

Memory is a few blocks per queue part plus the largest sample bucket.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
_BUFFER = 1 << 13


class DiskQueue:
    """First-in-first-out (position, common prefix) tuples; only the newest and oldest are in memory."""

    def __init__(self):
        self._file = None
        self._marks: list[tuple[int, int]] = []  # byte offset and count of blocks on disk
        self._read = 0
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._buffered = 0

    def put(self, position: np.ndarray, prefix: np.ndarray) -> None:
        self._new.append((position, prefix))
        self._buffered += len(position)
        if self._buffered >= _BUFFER:
            self._spill()

    def _take_new(self) -> tuple[np.ndarray, np.ndarray]:
        position, prefix = (np.concatenate(x) for x in zip(*self._new))
        self._new, self._buffered = [], 0
        return position, prefix

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()  # private to this task, gone when closed
        position, prefix = self._take_new()
        self._file.seek(0, 2)
        self._marks.append((self._file.tell(), len(position)))
        self._file.write(position.astype(np.int64).tobytes())
        self._file.write(prefix.astype(np.uint8).tobytes())

    def _block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = self._marks[i]
        self._file.seek(at)
        return np.frombuffer(self._file.read(8 * n), np.int64), np.frombuffer(self._file.read(n), np.uint8)

    def get(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest block, or nothing if the queue is empty just now."""
        if self._read < len(self._marks):
            self._read += 1
            return self._block(self._read - 1)
        return self._take_new() if self._new else None

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Everything ever put, the newest block first; for queues that are not read with get."""
        if self._new:
            yield self._new_copy()
        for i in reversed(range(len(self._marks))):
            yield self._block(i)

    def _new_copy(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*self._new))

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._file, self._marks, self._new = None, [], []


def least_between(prefix: np.ndarray, chosen: np.ndarray, pending: int) -> tuple[np.ndarray, int]:
    """Least value from after each chosen index up to the next; and what is left behind the last.

    ``pending`` is the least value since the last choice in earlier blocks.
    """
    starts = np.concatenate(([0], chosen[:-1] + 1))
    least = np.minimum.reduceat(prefix[: chosen[-1] + 1], starts)
    least[0] = min(int(least[0]), pending)
    rest = prefix[chosen[-1] + 1 :]
    return least, int(rest.min()) if len(rest) else 255


class InducedSorter:
    def __init__(self, text: np.ndarray, depth: int):
        """``text`` must have at least ``depth + 8`` zero bytes of padding behind its last suffix."""
        if depth > 200:
            raise ValueError("common prefixes are kept in a byte; depth must be 200 at most")
        self.depth = depth
        self.n = len(text) - depth - 8
        self.text = text
        self._words = np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))
        self._file = tempfile.TemporaryFile()
        self._file.truncate(max(self.n, 1))
        self.is_s = np.memmap(self._file, bool, "r+", shape=(max(self.n, 1),))

    def _classify(self, samples: list[DiskQueue]) -> None:
        """Class every suffix, from the end, and put the samples into buckets by first byte."""
        after = False  # the last suffix is L: only the end follows it
        for a in range((self.n - 1) // BLOCK * BLOCK, -1, -BLOCK):
            b = min(a + BLOCK, self.n)
            here, following = self.text[a:b], self.text[a + 1 : b + 1]
            up, same = here < following, here == following
            if b == self.n:
                up[-1], same[-1] = False, False
            place = np.where(same, b - a, np.arange(b - a))
            place = np.minimum.accumulate(place[::-1])[::-1]
            up = np.where(place < b - a, up[np.minimum(place, b - a - 1)], after)
            self.is_s[a:b] = up
            after = bool(up[0])
        for a in range(0, self.n, BLOCK):
            b = min(a + BLOCK, self.n)
            before = np.concatenate(([True if a == 0 else self.is_s[a - 1]], self.is_s[a : b - 1]))
            found = np.flatnonzero(self.is_s[a:b] & ~before) + a
            first = self.text[found]
            for c in np.unique(first):
                chosen = found[first == c]
                samples[c].put(chosen, np.zeros(len(chosen), np.uint8))

    def _sort_bucket(self, queue: DiskQueue) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a sample bucket in order, with common prefixes of neighbours."""
        parts = []
        while (block := queue.get()) is not None:
            parts.append(block[0])
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        position = np.concatenate(parts)
        prefix = np.zeros(len(position), np.uint8)
        active, group = np.arange(len(position)), np.zeros(len(position), np.int64)
        for skip in range(0, self.depth, 8):
            words = self._words[np.minimum(position[active] + skip, len(self._words) - 1)].astype(np.uint64)
            order = np.lexsort((words, group))
            position[active] = position[active][order]
            words = words[order]
            tied = (words[1:] == words[:-1]) & (group[1:] == group[:-1])
            parted = np.flatnonzero((words[1:] != words[:-1]) & (group[1:] == group[:-1])) + 1
            differing = words[parted] ^ words[parted - 1]
            same_bytes = sum((differing < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
            prefix[active[parted]] = np.minimum(skip + same_bytes, self.depth)
            new_group = np.concatenate(([0], np.cumsum(~tied)))
            go_on = np.concatenate((tied, [False])) | np.concatenate(([False], tied))
            active, group = active[go_on], new_group[go_on]
            if not len(active):
                return position, prefix
        inside = np.flatnonzero(group[1:] == group[:-1]) + 1
        prefix[active[inside]] = self.depth
        return position, prefix

    def _induce(self, queues, pending, started, position, prefix, keep) -> None:
        """Queue the predecessors of a block of suffixes for which ``keep`` holds."""
        has = position > 0
        before = np.maximum(position - 1, 0)
        byte = self.text[before]
        wanted = keep(byte) & has
        least_here = int(prefix.min()) if len(prefix) else 255
        present = np.unique(byte[wanted])
        absent = np.ones(256, dtype=bool)
        absent[present] = False
        pending[absent] = np.minimum(pending[absent], least_here)
        for d in present:
            chosen = np.flatnonzero(wanted & (byte == d))
            least, pending[d] = least_between(prefix, chosen, int(pending[d]))
            common = np.minimum(least.astype(np.int64) + 1, self.depth).astype(np.uint8)
            if not started[d]:
                common[0], started[d] = 0, True
            queues[d].put(before[chosen], common)

    def _run_length(self, position: int) -> int:
        window = np.asarray(self.text[position : min(position + self.depth, self.n)])
        other = np.flatnonzero(window != window[0])
        return int(other[0]) if len(other) else len(window)

    def _seam(self, a: int | None, b: int | None) -> int:
        """Common prefix of an L and an S suffix of the same first byte."""
        return 0 if a is None or b is None else min(self._run_length(a), self._run_length(b))

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in descending order, each with the common prefix it shares with the one before."""
        if self.n <= 0:
            return
        samples = [DiskQueue() for _ in range(256)]
        self._classify(samples)
        found_l = [DiskQueue() for _ in range(256)]
        queues, started = [DiskQueue() for _ in range(256)], np.zeros(256, bool)
        pending = np.full(256, 255)
        last = self.n - 1
        queues[self.text[last]].put(np.array([last]), np.zeros(1, np.uint8))
        started[self.text[last]] = True
        for c in range(256):
            end = None
            while (block := queues[c].get()) is not None:
                found_l[c].put(*block)
                self._induce(queues, pending, started, *block, lambda byte: byte >= c)
                end = int(block[0][-1])
            position, prefix = self._sort_bucket(samples[c])
            if len(position):
                prefix[0] = self._seam(end, int(position[0]))
                for a in range(0, len(position), BLOCK):
                    self._induce(queues, pending, started, position[a : a + BLOCK], prefix[a : a + BLOCK], lambda byte: byte > c)
            queues[c].close()
            samples[c].close()
        queues, started = [DiskQueue() for _ in range(256)], np.zeros(256, bool)
        pending = np.full(256, 255)
        for c in range(255, -1, -1):
            end, first_of_byte = None, True
            while (block := queues[c].get()) is not None:
                yield block
                self._induce(queues, pending, started, *block, lambda byte: byte <= c)
                end, first_of_byte = int(block[0][-1]), False
            carried = None  # common prefix of the last suffix given out with the next smaller one
            for position, prefix in found_l[c].backwards():
                position, rising = position[::-1], prefix[::-1]
                if carried is None:
                    carried = 0 if first_of_byte else self._seam(int(position[0]), end)
                falling = np.concatenate(([carried], rising[:-1])).astype(np.uint8)
                carried = int(rising[-1])
                yield position, falling
                self._induce(queues, pending, started, position, falling, lambda byte: byte < c)
            found_l[c].close()
            queues[c].close()
        self._file.close()


def equal_windows(text: np.ndarray, depth: int, is_window: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of flagged suffixes that share their first ``depth`` bytes: (positions, group numbers) by block.

    All members of a group come in one block.
    """
    open_members, pending, opened = np.zeros(0, np.int64), 255, False
    for position, prefix in InducedSorter(text, depth).descending():
        chosen = np.flatnonzero(is_window[position])
        if not len(chosen):
            pending = min(pending, int(prefix.min()))
            continue
        least, pending = least_between(prefix, chosen, pending)
        new = least < depth
        if not opened:
            new[0], opened = True, True
        members = np.concatenate((open_members, position[chosen]))
        starts = np.concatenate((np.zeros(len(open_members), bool), new))
        if len(open_members):
            starts[0] = True
        groups = np.cumsum(starts)
        closed = groups < groups[-1]
        if closed.any():
            yield members[closed], groups[closed]
        open_members = members[~closed]
    if len(open_members):
        yield open_members, np.ones(len(open_members), np.int64)
