"""Numpy views of an Arrow text column, for operators that work on words or bytes.

A batch is cut into slices of about ``SLICE_BYTES`` so that working memory does
not depend on how many or how long the documents of a batch are; one very long
document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

# Fixed seed: hashes must agree between tasks and between runs.
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(n, 1 << 16).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one-to-one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any byte span of ``data`` in constant time per span."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data) + 1)
        self._prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=self._prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[start]) * self._down[start])


def runs_of(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values, by the index of the first."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * _STEP + values[k : k + count]
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row begins; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes of text, at least a row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def word_bytes(is_word: str) -> np.ndarray:
    """Table of 256 flags for a class of word bytes."""
    table = np.zeros(256, dtype=bool)
    if is_word == "not_space":  # [^\x20\x09-\x0D]+
        table[:] = True
        table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    elif is_word == "alphanumeric":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
        table[ord("0") : ord("9") + 1] = True
        table[ord("a") : ord("z") + 1] = True
        table[0x80:] = True
    else:
        raise ValueError(f"unknown class of word bytes: {is_word}")
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Words of several texts: byte ranges, and where the words of each text begin."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray):
        inside = table[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True  # a word never reaches into the next text
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        inside_now = np.append(inside, False)
        self.start = np.flatnonzero(inside_now & (~before | edge))
        self.end = np.flatnonzero(before & (~inside_now | edge))
        self.first = np.searchsorted(self.start, at)  # of each text, and the total at the end

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30, _LOW32 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64((1 << 32) - 1)
# Fixed bases below the prime, drawn once.
WORD_BASE, RUN_BASES = 1_337_006_139_375_617_731, (1_028_917_546_013_259_041, 2_147_823_401_889_173_207)
_PART = 1 << 15  # values worked on at a time, so that intermediate arrays stay in the cache
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _below_prime(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below 2**61 - 1, modulo it."""
    a_high, a_low = a >> np.uint64(31), a & _LOW31
    b_high, b_low = b >> np.uint64(31), b & _LOW31
    middle = a_low * b_high + a_high * b_low
    whole = ((a_high * b_high) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a_low * b_low
    return _below_prime(whole)


def _powers_below_prime(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo the prime, at least ``n`` of each; kept up to some slices' length."""
    known = _prime_powers.get(base)
    if known is not None and len(known[0]) >= n:
        return known
    size, found = max(n, SLICE_BYTES + 4096), []
    for b in (base, pow(base, -1, int(PRIME))):
        table = np.ones(1, dtype=np.uint64)
        while len(table) < size:
            more = min(len(table), size - len(table))
            table = np.concatenate((table, times(table[:more], np.uint64(pow(b, len(table), int(PRIME))))))
        found.append(table)
    if size <= 2 * SLICE_BYTES:
        _prime_powers[base] = (found[0], found[1])
    return found[0], found[1]


class RunHasher:
    """Hashes modulo 2**61 - 1 of any run of values in constant time per run.

    The values are below the prime and not 0, so runs of other lengths or values
    agree by chance only: a polynomial modulo a prime has no more zeros than its degree.
    """

    def __init__(self, values: np.ndarray, base: int):
        up, self._down = _powers_below_prime(base, len(values) + 1)
        self._prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        total = np.uint64(0)
        for first in range(0, len(values), _PART):
            part = values[first : first + _PART].astype(np.uint64)
            terms = times(part, up[first : first + len(part)])
            low, high = np.cumsum(terms & _LOW32), np.cumsum(terms >> np.uint64(32))
            sums = ((high << np.uint64(32)) & PRIME) + (high >> np.uint64(29)) + low + total
            self._prefix[first + 1 : first + 1 + len(part)] = _below_prime(sums)
            total = self._prefix[first + len(part)]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(_below_prime(self._prefix[end] + PRIME - self._prefix[start]), self._down[start])
