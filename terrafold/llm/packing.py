"""Best-fit packing with conflicts: documents into training sequences of fixed length.

Documents are spread over shards of about ``shard_docs`` by a hash of their id
and text, so sources and duplicate clusters of any size are spread too. Rows with
the same id and text go over as many shards as keep ``shard_docs / 16`` of them
each, so every shard is one bounded group. Inside a shard, pieces go by decreasing length into the open
bin with the least room that still fits and has no document of the same source
or duplicate cluster. Bins are kept ordered by room; the search starts at the
first bin with enough room and goes on to its successors until a bin is
compatible. A bin carries its sources and clusters as bitmaps. A cluster holds
equal texts; with a table of near copies, all texts of a component too. For a source that
makes up much of a shard, the bins without it are kept in a list of their own, so the
search does not walk over bins it cannot use.

Defined cases: a document longer than a bin is cut into full pieces, each a bin
of its own, and a rest; a document without words gets one row without bin;
documents without source or cluster conflict with none; repeated rows are
documents of their own (same cluster, so never in one bin); no rows give no
rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.jaccard_join import counted_near_copies
from terrafold.session import materialize

CAPACITY = 2048
SHARD_DOCS = 4096
_OFTEN = 1 / 32
_REPEATS = 16
WORD = r"[^\x20\x09-\x0D]+"
PLACED = "shard long, bin long, slot int, doc_id long, piece int, first_word long, n_words long"


class _Bins:
    """Open bins ordered by room, with their source and cluster bitmaps."""

    def __init__(self, often: set[int]):
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []
        self._all: list[tuple[int, int]] = []
        self._without: dict[int, list[tuple[int, int]]] = {s: [] for s in often}

    def find(self, size: int, source: int, cluster: int) -> int:
        """The compatible bin with the least room of at least ``size``, or -1."""
        order = self._without.get(source, self._all)
        source_bit, cluster_bit = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        for k in range(bisect_left(order, (size, -1)), len(order)):
            b = order[k][1]
            if not (self.sources[b] & source_bit or self.clusters[b] & cluster_bit):
                return b
        return -1

    def _lists(self, b: int):
        yield self._all
        for s, order in self._without.items():
            if not self.sources[b] >> s & 1:
                yield order

    def add(self, b: int, size: int, source: int, cluster: int) -> None:
        entry = (self.room[b], b)
        for order in self._lists(b):
            if (k := bisect_left(order, entry)) < len(order) and order[k] == entry:
                del order[k]
        self.room[b] -= size
        self.filled[b] += 1
        if source >= 0:
            self.sources[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        if self.room[b]:
            for order in self._lists(b):
                insort(order, (self.room[b], b))

    def open(self, capacity: int) -> int:
        self.room.append(capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self.filled.append(0)
        return len(self.room) - 1


def _codes(values: pd.Series) -> list[int]:
    """Small numbers for values that occur more than once; -1 for values that cannot conflict."""
    often = values.map(values.value_counts()).gt(1) & values.notna()
    codes, _ = pd.factorize(values.where(often))
    return codes.tolist()


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of one shard's documents with the bins they go to."""
    rows = rows.sort_values(["doc_id", "cluster"], na_position="last", kind="stable").reset_index(drop=True)
    sources, clusters = _codes(rows["source"]), _codes(rows["cluster"])
    share = pd.Series(sources).value_counts()
    bins = _Bins({int(s) for s in share.index[share > _OFTEN * len(rows)] if s >= 0})
    shard, out = int(rows["shard"].iloc[0]), []
    lengths, ids = rows["n_words"].tolist(), rows["doc_id"].tolist()
    for i, n in enumerate(lengths):
        for piece in range(n // capacity):
            out.append((shard, bins.open(0), 0, ids[i], piece, piece * capacity, capacity))
        if not n:
            out.append((shard, None, None, ids[i], 0, 0, 0))
    rests = sorted((i for i, n in enumerate(lengths) if n % capacity), key=lambda i: (-(lengths[i] % capacity), i))
    for i in rests:
        size = lengths[i] % capacity
        b = bins.find(size, sources[i], clusters[i])
        if b < 0:
            b = bins.open(capacity)
        out.append((shard, b, bins.filled[b], ids[i], lengths[i] // capacity, lengths[i] - size, size))
        bins.add(b, size, sources[i], clusters[i])
    frame = pd.DataFrame(out, columns=["shard", "bin", "slot", "doc_id", "piece", "first_word", "n_words"])
    return frame.astype({"bin": "Int64", "slot": "Int32", "doc_id": "Int64"})


def same_text(text: str) -> Column:
    """Cluster of documents with the same text but for case."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.lower(text)))


def _row_columns(key: str, text: str, source: str) -> dict[str, Column]:
    return {
        "doc_id": F.col(key).cast("long"), "row": F.xxhash64(F.col(key), F.xxhash64(text)),
        "salt": F.xxhash64(F.monotonically_increasing_id()), "source": F.col(source).cast("string"),
    }


def pack_apart(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n: int = 5, percent: int = 80,
    capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """:func:`pack` with near copies, by shared runs of ``n`` words, in one cluster.

    Words are counted in the pass over the texts that finds the copies.
    """
    lower = docs.select(*[c.alias(name) for name, c in _row_columns(key, text, source).items()], same_text(text).alias("cluster"), F.lower(text).alias("text"))
    counted, copies = counted_near_copies(lower, n=n, percent=percent)
    return _pack(counted, capacity, shard_docs, copies)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None,
    capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, copies: DataFrame | None = None,
) -> DataFrame:
    """Where every piece of every document goes: shard, bin, slot, and its words.

    ``copies`` names the clusters of some texts: ``version``, as :func:`same_text` gives it, and ``cluster``.
    """
    length = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = docs.select(
        *[c.alias(name) for name, c in _row_columns(key, text, source).items()],
        (same_text(text) if cluster is None else cluster).alias("cluster"), length.alias("n_words"),
    )
    return _pack(materialize(narrow, "lengths"), capacity, shard_docs, copies)


def _pack(narrow: DataFrame, capacity: int, shard_docs: int, copies: DataFrame | None = None) -> DataFrame:
    """:func:`pack` for a stored table with the columns of ``_row_columns``, ``cluster`` and ``n_words``."""
    shards, most = max(1, -(-narrow.count() // shard_docs)), max(1, shard_docs // _REPEATS)
    if shards > 1:
        repeats = narrow.groupBy("row").agg(F.count("*").alias("n")).where(F.col("n") > most)
        repeats = repeats.select("row", F.least(F.ceil(F.col("n") / most), F.lit(shards)).alias("spread"))
        narrow = narrow.join(materialize(repeats, "repeats"), "row", "left")
        offset = F.coalesce(F.pmod("salt", "spread"), F.lit(0))
        shard = F.pmod(F.pmod("row", F.lit(shards)) + offset, F.lit(shards))
    else:
        shard = F.lit(0).cast("long")
    narrow = narrow.select(shard.alias("shard"), "doc_id", "source", "cluster", "n_words")
    if copies is not None:
        named = copies.select("version", F.col("cluster").alias("component"))
        narrow = narrow.join(named, F.col("cluster") == F.col("version"), "left").withColumn("cluster", F.coalesce("component", "cluster"))
        narrow = narrow.select("shard", "doc_id", "source", "cluster", "n_words")
    return narrow.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), PLACED)


def packed_texts(docs: DataFrame, placed: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """The sequences themselves: one row per bin with its document ids, words and text.

    Ids must be unique in ``docs``.
    """
    words = docs.select(F.col(key).cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    pieces = placed.where("bin is not null").join(words, "doc_id").select(
        "shard", "bin", "slot", "doc_id", "n_words", F.concat_ws(" ", F.expr("slice(words, int(first_word) + 1, int(n_words))")).alias("piece"),
    )
    rows = pieces.groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("slot", "doc_id", "piece"))).alias("p"), F.sum("n_words").alias("n_words"))
    return rows.select("shard", "bin", F.col("p.doc_id").alias("doc_ids"), "n_words", F.concat_ws(separator, "p.piece").alias("text"))
