"""Substring dedup over sentence spans.

A span is the shortest run of consecutive sentences that begins at a given
sentence, has at least ``min_sentences`` sentences and at least ``min_words``
words; a sentence of ``long_sentence`` words or more is a span by itself too.
Spans are hashed in one numpy pass over Arrow batches: lower-cased words by a
polynomial modulo the prime 2**61 - 1, runs of words by two more, so by 122 bits. A span that already began earlier in its document is a repeat there and
then; the others are joined globally: a span in several documents stays in the
one with the smallest id, and all sentences it covers go in the others.

A first pass finds the spans of several documents, with partial aggregation over
fixed-width values. A second one keeps only the occurrences that a bitmap of
fixed size lets through, and joins them with the exact spans; both sides are
plain shuffles, so adaptive execution splits hot spans.

Defined cases: null and empty texts stay as they are; repeated rows (same id and
text) are one document and cut alike; rows that share an id but not the text do
not remove spans from each other; rows without id come after all others; a
document with too few sentences or words has no spans; further columns are kept,
and ``n_chars`` follows the new text if present.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.bitmap import broadcast_bitmap, in_bitmap
from terrafold.llm.naming import set_aside
from terrafold.llm.text_arrays import RUN_BASES, WORD_BASE, RunHasher, Words, lower_ascii, mix, slices, text_bytes, word_bytes
from terrafold.session import materialize

MIN_SENTENCES = 2
MIN_WORDS = 20
LONG_SENTENCE = 25
_LAST = (1 << 63) - 1
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_SPANS = "doc long, version long, span_a long, span_b long, first int, last int, again boolean"


def sentence_spans(data: np.ndarray, at: np.ndarray, min_sentences: int, min_words: int, long_sentence: int):
    """Spans of several texts: owner and byte range, and their hashes.

    A sentence ends with a word in ``. ! ?`` or at a line break. The byte range
    reaches from its first word to the first word after it (or the end).
    """
    words = Words(data, at, word_bytes("not_space"))
    if not len(words):
        return np.zeros((0, 3), np.int64), np.zeros((0, 2), np.uint64)
    owner = words.texts()
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    next_start = np.append(words.start[1:], len(data))
    last_of_text = np.append(owner[1:] != owner[:-1], True)
    ends = _STOPS[data[words.end - 1]] | (breaks[next_start] > breaks[words.end]) | last_of_text
    sentence_end = np.flatnonzero(ends) + 1  # word index after each sentence
    sentence_start = np.concatenate(([0], sentence_end[:-1]))
    sentence_owner = owner[sentence_start]
    codes = RunHasher(lower_ascii(data).astype(np.uint16) + np.uint16(1), WORD_BASE).spans(words.start, words.end)
    hashers = [RunHasher(codes + np.uint64(1), base) for base in RUN_BASES]
    n = len(sentence_start)
    # Shortest run with enough sentences and words.
    run_end = np.searchsorted(sentence_end, sentence_start + min_words)
    run_end = np.maximum(run_end, np.arange(n) + min_sentences - 1)
    fits = run_end < n
    fits[fits] = sentence_owner[run_end[fits]] == sentence_owner[fits]
    first = np.flatnonzero(fits)
    alone = np.flatnonzero(sentence_end - sentence_start >= long_sentence)
    begin = sentence_start[np.concatenate((first, alone))]
    end = sentence_end[np.concatenate((run_end[fits], alone))]
    text_end = at[owner[begin] + 1]
    byte_end = np.where(last_of_text[end - 1], text_end, next_start[end - 1])
    ranges = np.stack((owner[begin], words.start[begin] - at[owner[begin]], byte_end - at[owner[begin]]), axis=1)
    return ranges, np.stack([h.spans(begin, end) for h in hashers], axis=1)


def _numbered_spans(part: pa.RecordBatch, limits: tuple[int, int, int]):
    """Spans of (doc, version, text) rows by owner and hash; ``again`` marks all but the first of a hash in its document."""
    ranges, codes = sentence_spans(*text_bytes(part.column(2)), *limits)
    order = np.lexsort((ranges[:, 1], codes[:, 1], codes[:, 0], ranges[:, 0]))
    ranges, codes = ranges[order], codes[order]
    again = np.zeros(len(ranges), dtype=bool)
    again[1:] = (ranges[1:, 0] == ranges[:-1, 0]) & (codes[1:] == codes[:-1]).all(axis=1)
    return ranges, mix(codes[:, 0]), codes[:, 1].view(np.int64), again


def _span_counts(docs: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """Span hashes with the smallest and largest document that has them."""

    def run(batches):
        for part in slices(batches, "text"):
            ranges, code_a, code_b, again = _numbered_spans(part, limits)
            first = np.flatnonzero(~again)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code_a[first].view(np.int64)), pa.array(code_b[first]), part.column(0).take(pa.array(ranges[first, 0]))],
                names=["span_a", "span_b", "doc"],
            )

    spans = docs.mapInArrow(run, "span_a long, span_b long, doc long")
    return spans.groupBy("span_a", "span_b").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))


def _spans_of(docs: DataFrame, bitmap, limits: tuple[int, int, int]) -> DataFrame:
    """Spans that may be in several documents, by the bitmap, and those found again in their own."""

    def run(batches):
        for part in slices(batches, "text"):
            ranges, code_a, code_b, again = _numbered_spans(part, limits)
            kept = np.flatnonzero(again | in_bitmap(code_a, bitmap.value))
            owner = pa.array(ranges[kept, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(owner), part.column(1).take(owner), pa.array(code_a[kept].view(np.int64)), pa.array(code_b[kept]),
                    pa.array(ranges[kept, 1].astype(np.int32)), pa.array(ranges[kept, 2].astype(np.int32)), pa.array(again[kept]),
                ],
                names=["doc", "version", "span_a", "span_b", "first", "last", "again"],
            )

    return docs.mapInArrow(run, _SPANS)


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE,
) -> DataFrame:
    """Byte ranges to remove: one row per document version with ``cuts``."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text")
    )
    limits = (min_sentences, min_words, long_sentence)
    shared = materialize(_span_counts(rows, limits).where("first_doc < last_doc").drop("last_doc"), "shared-spans")
    spans = materialize(_spans_of(rows, broadcast_bitmap(shared, "span_a"), limits), "spans")
    later = spans.join(shared, ["span_a", "span_b"]).where("doc > first_doc").select("doc", "version", "first", "last")
    local = spans.where("again").select("doc", "version", "first", "last")
    return later.unionByName(local).groupBy("doc", "version").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))


RESULT_COLUMNS = ("n_bytes", "n_removed")
_HELPERS = ("doc", "version", "cut_doc", "cut_version", "cuts")


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: str, cuts: list[tuple[int, int]]) -> str:
    raw, kept, at = text.encode(), [], 0
    for a, b in cuts:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def remove_repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without repeated spans, with ``n_bytes`` and ``n_removed`` bytes.

    Columns of these two names are replaced.
    """
    apart, back = set_aside(docs.drop(*RESULT_COLUMNS), _HELPERS)
    names = {v: k for k, v in back.items()}
    key_now, text_now = names.get(key, key), names.get(text, text)
    cuts = repeated_spans(apart, key_now, text_now, **options).withColumnsRenamed({"doc": "cut_doc", "version": "cut_version"})
    keyed = apart.withColumns({"doc": F.coalesce(F.col(key_now).cast("long"), F.lit(_LAST)), "version": F.xxhash64(text_now)})
    same = (F.col("doc") == F.col("cut_doc")) & (F.col("version") == F.col("cut_version"))
    joined = keyed.join(cuts, same, "left").select(*apart.columns, "cuts")
    schema = T.StructType([*apart.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for part in slices(batches, text_now):
            place = part.schema.get_field_index(text_now)
            texts, ranges = part.column(place), part.column(part.schema.get_field_index("cuts")).to_pylist()
            sizes = np.diff(text_bytes(texts)[1])
            removed, new = np.zeros(len(sizes), dtype=np.int64), None
            for i, r in enumerate(ranges):
                if r:
                    new = texts.to_pylist() if new is None else new
                    merged = _merged(r)
                    removed[i] = sum(b - a for a, b in merged)
                    new[i] = _without(new[i], merged)
            columns = [part.column(i) for i, c in enumerate(part.schema.names) if c != "cuts"]
            if new is not None:
                columns[place] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes.astype(np.int64)), pa.array(removed)], names=[f.name for f in schema.fields])

    out = joined.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length(text_now)).otherwise(F.col("n_chars")).cast("long"))
    return out.withColumnsRenamed(back)
