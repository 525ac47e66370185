"""Exact substring dedup: bytes covered by a string that also starts earlier.

Every ``width``-byte window is owned by its anchor, the place of the smallest
hash of its ``gram``-byte substrings (the leftmost on ties). Equal windows have
equal anchors, so they can be compared anchor by anchor:

1. Anchor hashes are counted over the corpus. Those that occur again set bits in
   a bitmap of fixed size, which is broadcast; a false bit costs time only.
2. Consecutive windows of one anchor form a run. Runs of recurring anchors whose
   bytes are equal form a class; all but its first run are covered, whole, and
   no bytes need to move. This settles copies, however many.
3. Anchors with several classes have windows that may recur in part. The bytes
   of each class's first run (another bitmap tells which) go to the shard of the anchor. A task writes its
   shard to disk and sorts its suffixes by external induction (suffix_sort);
   neighbours with a common prefix of ``width`` bytes or more are equal windows,
   of which all but the first are covered.
4. Anchors with more than ``anchor_runs`` different runs would make one large
   shard. Their windows are hashed (128 bits) and counted one by one instead.

Defined cases: null and empty texts have no bytes; documents shorter than
``width`` lose nothing; repeated rows (same id and text) are one document and cut
alike; rows that share an id are ordered by text hash; rows without id come
last. Removal works on bytes and may cut a character, so the remaining bytes are
binary; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.bitmap import BITS, broadcast_bitmap, in_bitmap
from terrafold.llm.suffix_sort import equal_windows
from terrafold.llm.text_arrays import Hasher, mix, slices, text_bytes
from terrafold.session import materialize, release

WIDTH = 100
GRAM = 32
SHARD_BYTES = 8 << 20
ANCHOR_RUNS = 50_000
_LAST = (1 << 63) - 1
_RUN = "anchor long, bytes_hash long, doc long, start long, n_windows long"
_SPAN = "doc long, first long, last long"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones, from minima within blocks."""
    padded = np.concatenate((values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)))
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, at: np.ndarray, width: int, gram: int):
    """Runs of windows with one anchor: anchor hash, hash of the run's bytes, text, start and number of windows."""
    if len(data) < width:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    hasher = Hasher(data)
    place = np.arange(len(data) - gram + 1)
    codes = hasher.spans(place, place + gram)
    bits = np.uint64(int(len(data)).bit_length())
    least = sliding_minimum((codes >> bits << bits) | place.astype(np.uint64), width - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, dtype=np.int32)
    size = np.diff(at)
    has = size >= width
    np.add.at(inside, at[:-1][has], 1)
    np.add.at(inside, np.minimum(at[1:][has] - width + 1, len(anchor)), -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(window):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    anchor = anchor[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    heads = np.flatnonzero(new)
    start, count = window[heads], np.diff(np.append(heads, len(window)))
    owner = np.searchsorted(at, start, side="right") - 1
    return codes[anchor[heads]], hasher.spans(start, start + count + width - 1), owner, start - at[owner], count


def _anchor_counts(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text"):
            anchors = window_runs(*text_bytes(part.column(1)), width, gram)[0]
            values, counts = np.unique(anchors, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["anchor", "n"])

    return rows.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _representative(anchor, code, doc, start):
    """A number that tells the runs of a class apart; as arrays or as columns."""
    if isinstance(anchor, np.ndarray):
        return anchor ^ code ^ doc.view(np.uint64) ^ (start.view(np.uint64) << np.uint64(13))
    return anchor.bitwiseXOR(code).bitwiseXOR(doc).bitwiseXOR(F.shiftleft(start, 13))


def _recurring_runs(rows: DataFrame, recurring, bits: int, width: int, gram: int) -> DataFrame:
    """Runs of the anchors in the bitmap."""

    def run(batches):
        for part in slices(batches, "text"):
            anchor, code, owner, start, count = window_runs(*text_bytes(part.column(1)), width, gram)
            kept = np.flatnonzero(in_bitmap(anchor, recurring.value, bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[kept].view(np.int64)), pa.array(code[kept].view(np.int64)),
                 part.column(0).take(pa.array(owner[kept])), pa.array(start[kept]), pa.array(count[kept])],
                names=["anchor", "bytes_hash", "doc", "start", "n_windows"],
            )

    return rows.mapInArrow(run, _RUN)


def _first_runs(rows: DataFrame, firsts, large, bits: int, width: int, gram: int) -> DataFrame:
    """The bytes of the first runs of classes, by the bitmap of representatives; ``large`` marks runs of large anchors."""

    def run(batches):
        for part in slices(batches, "text"):
            data, at = text_bytes(part.column(1))
            anchor, code, owner, start, count = window_runs(data, at, width, gram)
            doc = part.column(0).to_numpy()[owner]
            kept = np.flatnonzero(in_bitmap(_representative(anchor, code, doc, start), firsts.value, bits))
            begin = at[owner[kept]] + start[kept]
            content = [data[a : a + n + width - 1].tobytes() for a, n in zip(begin, count[kept])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[kept].view(np.int64)), pa.array(doc[kept]), pa.array(start[kept]), pa.array(count[kept]),
                 pa.array(content, pa.binary()), pa.array(in_bitmap(anchor[kept], large.value, bits))],
                names=["anchor", "doc", "start", "n_windows", "content", "large"],
            )

    return rows.mapInArrow(run, "anchor long, doc long, start long, n_windows long, content binary, large boolean")


class _Shard:
    """Runs of one partition, their bytes in a file of the task."""

    def __init__(self, batches, width: int):
        self.file, self.width, size = tempfile.TemporaryFile(), width, 0
        columns: dict[str, list[np.ndarray]] = {"doc": [], "start": [], "n_windows": [], "at": []}
        for batch in batches:
            contents = batch.column(batch.schema.get_field_index("content")).to_pylist()
            places = []
            for content in contents:
                places.append(size)
                self.file.write(content)
                self.file.write(b"\0")
                size += len(content) + 1
            for name in columns:
                values = np.array(places, np.int64) if name == "at" else batch.column(batch.schema.get_field_index(name)).to_numpy()
                columns[name].append(values)
        self.size = size
        self.columns = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in columns.items()}

    def covered(self) -> pa.RecordBatch:
        """Byte ranges covered by windows that also start earlier in the shard's runs."""
        c, width = self.columns, self.width
        self.file.write(bytes(width + 8))
        self.file.flush()
        text = np.memmap(self.file, np.uint8, "r")
        with tempfile.TemporaryFile() as marks:
            marks.truncate(2 * len(text))
            flags = np.memmap(marks, bool, "r+", shape=(2, len(text)))
            is_window, again = flags
            for at, n in zip(c["at"], c["n_windows"]):
                is_window[at : at + n] = True
            doc_rank = np.unique(c["doc"], return_inverse=True)[1].astype(np.int64)
            for position, group in equal_windows(text, width, is_window):
                row = np.searchsorted(c["at"], position, side="right") - 1
                key = (doc_rank[row] << 40) + c["start"][row] + position - c["at"][row]
                heads = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
                first = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(group))))
                again[position[key > first]] = True
            found = []
            for a in range(0, len(text), 1 << 20):
                found.append(np.flatnonzero(again[a : a + (1 << 20)]) + a)
        found = np.concatenate(found)
        ends = np.flatnonzero(np.diff(found) != 1)  # runs never touch: a separator lies between
        begin = found[np.concatenate(([0], ends + 1))] if len(found) else found
        end = found[np.append(ends, len(found) - 1)] if len(found) else found
        row = np.searchsorted(c["at"], begin, side="right") - 1
        first = c["start"][row] + begin - c["at"][row]
        last = c["start"][row] + end - c["at"][row] + width
        return pa.RecordBatch.from_arrays(
            [pa.array(c["doc"][row]), pa.array(first), pa.array(last)], names=["doc", "first", "last"]
        )


def _sorted_shards(runs: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    size = runs.agg(F.sum(F.octet_length("content"))).first()[0] or 0

    def run(batches):
        shard = _Shard(batches, width)
        if shard.size:
            yield shard.covered()

    return runs.repartition(max(1, -(-size // shard_bytes)), "anchor").mapInArrow(run, _SPAN)


def _counted_windows(runs: DataFrame, width: int) -> DataFrame:
    """Covered windows of large anchors, counted by hash."""

    def run(batches):
        for part in slices(batches, "content"):
            data, at = text_bytes(part.column(2))
            count = np.diff(at) - width + 1
            owner = np.repeat(np.arange(len(count)), count)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            place = at[owner] + offset
            code = Hasher(data).spans(place, place + width)
            turned = Hasher(data * np.uint8(151) + np.uint8(43)).spans(place, place + width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.view(np.int64)), pa.array(mix(turned).view(np.int64)), part.column(0).take(pa.array(owner)),
                 pa.array(part.column(1).to_numpy()[owner] + offset)],
                names=["code_a", "code_b", "doc", "first"],
            )

    runs = runs.select("doc", "start", "content")
    windows = materialize(runs.mapInArrow(run, "code_a long, code_b long, doc long, first long"), "windows")
    place = F.struct("doc", "first")
    firsts = windows.groupBy("code_a", "code_b").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(materialize(firsts, "first-windows"), ["code_a", "code_b"]).where(place > F.col("earliest"))
    return later.select("doc", "first", (F.col("first") + width).alias("last"))


def covered_spans(
    rows: DataFrame, width: int = WIDTH, gram: int = GRAM, bitmap_bits: int = BITS, shard_bytes: int = SHARD_BYTES, anchor_runs: int = ANCHOR_RUNS,
) -> DataFrame:
    """Stored byte ranges (doc, first, last) covered by earlier windows; they may overlap.

    ``rows`` holds ``doc``, a number that orders the documents, and ``text``.
    """
    recurring = broadcast_bitmap(_anchor_counts(rows, width, gram).where("n > 1"), "anchor", bitmap_bits)
    runs = materialize(_recurring_runs(rows, recurring, bitmap_bits, width, gram), "runs")
    place = F.struct("doc", "start")
    classes = runs.groupBy("anchor", "bytes_hash", "n_windows").agg(F.min(place).alias("earliest"), F.count("*").alias("n"))
    classes = materialize(classes, "run-classes")
    again = runs.join(classes.where("n > 1").drop("n"), ["anchor", "bytes_hash", "n_windows"]).where(place > F.col("earliest"))
    again = again.select("doc", F.col("start").alias("first"), (F.col("start") + F.col("n_windows") + (width - 1)).alias("last"))
    again = materialize(again, "covered")
    release(runs)
    several = materialize(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "varied-anchors")
    heads = classes.join(several, "anchor").select(
        _representative(F.col("anchor"), F.col("bytes_hash"), F.col("earliest.doc"), F.col("earliest.start")).alias("mark")
    )
    firsts = broadcast_bitmap(heads, "mark", bitmap_bits)
    large = broadcast_bitmap(several.where(F.col("classes") > anchor_runs), "anchor", bitmap_bits)
    contents = materialize(_first_runs(rows, firsts, large, bitmap_bits, width, gram), "varied-runs")
    release(classes, several)
    found = materialize(
        _sorted_shards(contents.where("not large").drop("large"), width, shard_bytes).unionByName(
            _counted_windows(contents.where("large"), width)
        ),
        "covered",
    )
    release(contents)
    return again.unionByName(found)


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The documents with ``doc``, a number in the order of ids and, for one id, of text hashes.

    The id itself, unless some id has several texts; then ids and hashes are
    ranked: range-partitioned, and counted within partitions.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(text).alias("version"), F.col(text).alias("text"),
    )
    shared = rows.groupBy("doc").agg(F.min("version").alias("a"), F.max("version").alias("b")).where("a <> b")
    if shared.isEmpty():
        return rows.drop("version")
    ranged = rows.select("doc", "version").distinct().repartitionByRange("doc", "version")
    stored = materialize(ranged.withColumn("part", F.spark_partition_id()), "id-ranges")
    sizes = stored.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("doc", "version"))
    numbers = stored.withColumn("i", inside).join(sizes.select("part", before.alias("before")), "part")
    numbers = materialize(numbers.select("doc", "version", (F.col("i") + F.col("before")).alias("number")), "numbers")
    return rows.join(numbers, ["doc", "version"]).select("doc_id", F.col("number").alias("doc"), "text")


def _merge(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching ranges."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1]))
    return first[new], last[np.append(new[1:], True)]


def remove_covered(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document its id, ``kept`` bytes (binary), ``n_bytes``, ``n_removed`` and ``n_spans``."""
    numbered = _numbered(docs, key, text)
    spans = covered_spans(numbered.select("doc", "text").where("text is not null"), **options)
    cuts = spans.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
    joined = numbered.join(cuts, "doc", "left").select("doc_id", "text", "cuts")

    def run(batches):
        for part in slices(batches, "text"):
            data, at = text_bytes(part.column(1))
            cuts = part.column(2)
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(cuts).fill_null(0).to_numpy())))
            flat = cuts.flatten()
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            kept, removed, spans_of = [], [], []
            for i in range(part.num_rows):
                raw = data[at[i] : at[i + 1]]
                a, b = offsets[i], offsets[i + 1]
                if a == b:
                    kept.append(raw.tobytes())
                    removed.append(0)
                    spans_of.append(0)
                    continue
                begin, end = _merge(first[a:b], last[a:b])
                edges = np.zeros(len(raw) + 1, np.int8)
                edges[begin] += 1
                edges[end] -= 1
                gone = np.cumsum(edges[:-1]).astype(bool)
                kept.append(raw[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans_of.append(len(begin))
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(at)), pa.array(removed, pa.int64()),
                 pa.array(spans_of, pa.int64()), pa.array(digests)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
