"""Benchmark decontamination: find benchmark passages in training documents.

The windows (ten consecutive words) of the benchmark are broadcast as a sorted
array of hashes with a bitmap before it, next to the benchmark's words; each
task slides over the words of its documents with numpy and checks every hash hit
against the words themselves. Documents are read once and not shuffled.

A benchmark of more than ``broadcast_bytes`` of text is taken in parts of about
that size, one pass over the documents each, so what is broadcast (arrays of
about nine times the text) stays bounded whatever its size.

Defined cases: null or wordless texts have no words and no hits; an item of
fewer than ten words is one window, one of none is never found; repeated item
rows count once per id; items without id are ignored; an empty benchmark hits
nothing; further columns of the documents are kept, and a column with the name
of a result is replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.naming import set_aside
from terrafold.llm.text_arrays import Hasher, Words, lower_ascii, runs_of, slices, text_bytes, word_bytes
from terrafold.session import materialize, release

WINDOW = 10
BROADCAST_BYTES = 16 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
                                   T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULT_COLUMNS = ("n_words", "n_hit", "hit_spans", "hit_items")


class _WindowGroups:
    """Windows of one length, grouped by hash; arrays only, so their size is a few times that of the text."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, item: np.ndarray):
        order = np.lexsort((first, hashes))
        self.first, self.item = first[order], item[order]
        self.hashes, self.begin = np.unique(hashes[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.shift = np.uint64(64 - min(24, max(20, len(self.hashes).bit_length() + 3)))
        self.filter = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.filter[(self.hashes >> self.shift).astype(np.int64)] = True

    def candidates(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose hash is known, and the group of each."""
        maybe = np.flatnonzero(self.filter[(runs >> self.shift).astype(np.int64)])
        group = np.minimum(np.searchsorted(self.hashes, runs[maybe]), len(self.hashes) - 1)
        known = self.hashes[group] == runs[maybe]
        return maybe[known], group[known]


class _Windows:
    """Benchmark windows by their number of words, and the words to check them against."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, at = text_bytes(pa.array([text for _, text in items], pa.string()))
        self.data = lower_ascii(data)
        words = Words(self.data, at, word_bytes("alphanumeric"))
        self.start, self.end = words.start, words.end
        self.groups: dict[int, _WindowGroups] = {}
        if not len(words):
            return
        codes, counts = Hasher(self.data).spans(words.start, words.end), words.counts()
        owner, names = words.texts(), np.array([item for item, _ in items], dtype=np.int64)
        for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            runs = runs_of(codes, length)
            first = np.arange(len(runs))
            inside = owner[first] == owner[first + length - 1]
            # Items shorter than a window are one window, so theirs has all their words.
            whole = counts[owner[first]] >= window if length == window else counts[owner[first]] == length
            first = first[inside & whole]
            self.groups[length] = _WindowGroups(runs[first], first, names[owner[first]])

    def spelled(self, first: int, length: int) -> bytes:
        return b" ".join(self.data[self.start[j] : self.end[j]].tobytes() for j in range(first, first + length))

    def items_of(self, length: int, group: int, spelled: bytes) -> frozenset[int]:
        """Items with exactly these words in a window of this hash."""
        g = self.groups[length]
        members = range(g.begin[group], g.begin[group + 1])
        return frozenset(int(g.item[m]) for m in members if self.spelled(int(g.first[m]), length) == spelled)


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true flags as (first, last)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]


def _scan_slice(batch: pa.RecordBatch, text: str, windows: _Windows, earlier: bool) -> dict[str, list]:
    data, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    data = lower_ascii(data)
    words = Words(data, at, word_bytes("alphanumeric"))
    owner = words.texts()
    hit = np.zeros(len(words), dtype=bool)
    items: dict[int, set[int]] = defaultdict(set)
    if len(words):
        word_hashes = Hasher(data).spans(words.start, words.end)
        seen: dict[bytes, frozenset[int]] = {}  # windows hit in this slice
        for length, groups in windows.groups.items():
            for i, group in zip(*groups.candidates(runs_of(word_hashes, length))):
                if owner[i] != owner[i + length - 1]:
                    continue
                spelled = b" ".join(data[words.start[j] : words.end[j]].tobytes() for j in range(i, i + length))
                if spelled not in seen:
                    seen[spelled] = windows.items_of(length, int(group), spelled)
                if seen[spelled]:
                    hit[i : i + length] = True
                    items[int(owner[i])].update(seen[spelled])
    counts = words.counts()
    hits_before = np.concatenate(([0], np.cumsum(hit)))
    out = {"n_words": counts.tolist(), "n_hit": [], "hit_spans": [], "hit_items": []}
    before = batch.to_pylist() if earlier else None
    for d in range(batch.num_rows):
        a, b = words.first[d], words.first[d + 1]
        found = sorted(items.get(d, ()))
        flags = hit[a:b]
        if earlier and before[d]["hit_spans"]:
            flags = flags.copy()
            for s in before[d]["hit_spans"]:
                flags[s["first"] : s["last"] + 1] = True
            found = sorted({*found, *before[d]["hit_items"]})
            n = int(flags.sum())
        else:
            n = int(hits_before[b] - hits_before[a])
        out["n_hit"].append(n)
        out["hit_spans"].append(
            [{"first": f, "last": l, "start": int(words.start[a + f] - at[d]), "end": int(words.end[a + l] - at[d])} for f, l in _spans(flags)] if n else []
        )
        out["hit_items"].append(found)
    return out


def _pass(docs: DataFrame, text: str, windows: _Windows, earlier: bool) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name not in RESULT_COLUMNS]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.LongType()))])
    names = [f.name for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    span = pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")])
    kinds = [pa.int64(), pa.int64(), pa.list_(span), pa.list_(pa.int64())]

    def scan(batches):
        for part in slices(batches, text):
            found = _scan_slice(part, text, shared.value, earlier)
            kept = part.select(names)
            arrays = [*kept.columns, *(pa.array(found[c], k) for c, k in zip(RESULT_COLUMNS, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *RESULT_COLUMNS])

    return docs.mapInArrow(scan, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``hit_spans`` and ``hit_items``.

    A span holds its first and last word and its byte range in the UTF-8 text.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where(
        F.col("item").isNotNull() & F.col("text").isNotNull()
    ).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // broadcast_bytes))
    out, earlier = docs.drop(*RESULT_COLUMNS), None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()  # bounded by broadcast_bytes
        out = _pass(out, text, _Windows([(r["item"], r["text"]) for r in rows], window), earlier=part > 0)
        if part + 1 < parts:
            out = materialize(out, "contamination")
            if earlier is not None:
                release(earlier)
            earlier = out
    return out


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit spans out of the texts; clean documents stay as they are."""
    raw = F.col(text).cast("binary")
    whole = F.octet_length(F.col(text))
    kept = F.transform(
        F.sequence(F.lit(0), F.size("hit_spans")),
        lambda i: F.substring(
            raw,
            F.coalesce(F.get("hit_spans", i - 1)["end"], F.lit(0)) + 1,
            F.coalesce(F.get("hit_spans", i)["start"], whole) - F.coalesce(F.get("hit_spans", i - 1)["end"], F.lit(0)),
        ).cast("string"),
    )
    return found.withColumn(text, F.when(F.size("hit_spans") > 0, F.array_join(kept, "")).otherwise(F.col(text)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """The documents without contaminated ones, or without the contaminated spans.

    Keeps the columns of ``docs``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    apart, back = set_aside(docs, RESULT_COLUMNS)
    found = find_contamination(apart, benchmark, **options)
    kept = remove_spans(found, options.get("text", "text")) if remove == "spans" else found.where("n_hit = 0")
    return kept.drop(*RESULT_COLUMNS).withColumnsRenamed(back).select(*docs.columns)
