"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few bounded numbers (numpy over Arrow batches, one pass,
nothing shuffled). The model is fitted on at most about ``TRAIN_ROWS`` labelled
rows, chosen by a hash of the id: numbers are cut into bins, and gradient
boosting visits one feature after the other, each time adding a shallow tree's
leaf values to the lookup table of that feature. The strongest pairs of features
then get two-dimensional tables in the same way. A score is the sum of the
table entries of a text's bins, so scoring is bin lookups and additions.

Defined cases: null and empty texts are texts of length 0 and get a score;
labels that are null are ignored, repeated labels count as often as they occur;
with labels of one class, or none, every score is the smoothed share of label 1;
further columns of the documents are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.naming import set_aside
from terrafold.llm.text_arrays import Hasher, Words, lower_ascii, slices, text_bytes, word_bytes
from terrafold.session import materialize

TRAIN_ROWS = 30_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "closing", "symbol", "comma",
    "space", "non_ascii", "word_per_line", "word_per_stop", "distinct_words", "same_as_before", "top_run",
    "symbol_words", "upper_words", "short_words",
)


def _byte_class(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode())] = True
    return table


_CLASSES = {
    "upper": _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _byte_class("0123456789"),
    "closing": _byte_class("!?"),
    "symbol": _byte_class("#$%&*+/<=>@[\\]^_`{|}~"),
    "comma": _byte_class(",;:"),
    "space": _byte_class(" \t\r\n"),
    "non_ascii": np.arange(256) >= 0x80,
}


def _count(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=before[1:])
    return before[at[1:]] - before[at[:-1]]


def text_numbers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of each text, in the order of ``FEATURES``."""
    n = len(at) - 1
    words = Words(data, at, word_bytes("not_space"))
    size, n_words = np.diff(at), words.counts()
    any_bytes, any_words = np.maximum(size, 1), np.maximum(n_words, 1)
    length = words.end - words.start
    counts = {name: _count(table[data], at) for name, table in _CLASSES.items()}
    lines = _count(data == 10, at) + 1
    stops = _count(data == ord("."), at) + 1
    out = {name: c / any_bytes for name, c in counts.items()}
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(n_words)
    out["word_per_line"], out["word_per_stop"] = n_words / lines, n_words / stops
    owner = words.texts()
    if len(words):
        code = Hasher(lower_ascii(data)).spans(words.start, words.end)
        order = np.lexsort((code, owner))
        fresh = np.ones(len(words), dtype=bool)
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
        heads = np.flatnonzero(fresh)
        top = np.zeros(n, dtype=np.int64)
        np.maximum.at(top, owner[order][heads], np.diff(np.append(heads, len(words))))
        again = np.zeros(len(words), dtype=bool)
        again[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        last = data[words.end - 1]
        longest = np.zeros(n, dtype=np.int64)
        np.maximum.at(longest, owner, length)
        total = lambda flags: np.bincount(owner, weights=flags, minlength=n)
        out["distinct_words"] = distinct / any_words
        out["same_as_before"] = total(again) / any_words
        out["top_run"] = top / any_words
        out["symbol_words"] = total(_CLASSES["symbol"][last] | _CLASSES["closing"][last]) / any_words
        out["upper_words"] = total(_CLASSES["upper"][last] | _CLASSES["upper"][data[words.start]]) / any_words
        out["short_words"] = total(length <= 3) / any_words
        out["word_length"], out["longest_word"] = total(length) / any_words, np.log1p(longest)
    else:
        for name in FEATURES:
            out.setdefault(name, np.zeros(n))
    return np.stack([np.asarray(out[name], dtype=np.float32) for name in FEATURES], axis=1)


def with_numbers(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and an array ``numbers`` for every document."""
    rows = docs.select(*keep, text)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keep), T.StructField("numbers", T.ArrayType(T.FloatType()))])
    names = [*keep, "numbers"]

    def run(batches):
        for part in slices(batches, text):
            numbers = text_numbers(*text_bytes(part.column(part.schema.get_field_index(text))))
            offsets = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * len(FEATURES))
            column = pa.ListArray.from_arrays(offsets, pa.array(numbers.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.select(list(keep)).columns, column], names=names)

    return rows.mapInArrow(run, schema)


@dataclass
class AdditiveModel:
    """Bin edges, lookup tables by feature and by pair of features, and the intercept."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, numbers: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, numbers[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, numbers: np.ndarray) -> np.ndarray:
        bins = self.bins(numbers)
        total = np.full(len(bins), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 for none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gains = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    if not len(gains) or gains.max() <= 1e-12:
        return 0.0, 0
    return float(gains.max()), int(gains.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int) -> np.ndarray:
    """Values by bin of a tree with a few leaves, grown by the best cut first."""
    parts = [(0, len(g), *_best_cut(g, h, ridge))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, gain, cut = parts[k]
        if not cut:
            break
        parts[k : k + 1] = [
            (a, a + cut, *_best_cut(g[a : a + cut], h[a : a + cut], ridge)),
            (a + cut, b, *_best_cut(g[a + cut : b], h[a + cut : b], ridge)),
        ]
    values = np.zeros(len(g))
    for a, b, _, _ in parts:
        values[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return values


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts a two-dimensional table once along one side, then each half along the other."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        _, cut = _best_cut(gg.sum(1), hh.sum(1), ridge)
        values, gain = np.zeros_like(gg), 0.0
        for rows in (slice(0, cut), slice(cut, len(gg))) if cut else (slice(0, len(gg)),):
            _, across = _best_cut(gg[rows].sum(0), hh[rows].sum(0), ridge)
            for columns in (slice(0, across), slice(across, gg.shape[1])) if across else (slice(0, gg.shape[1]),):
                part_g, part_h = gg[rows, columns].sum(), hh[rows, columns].sum()
                values[rows, columns] = _leaf(part_g, part_h, ridge)
                gain += part_g**2 / (part_h + ridge)
        if gain > best[0]:
            best = (gain, values.T if turned else values)
    return best


def fit(
    numbers: np.ndarray, labels: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6,
    pair_rounds: int = 40, rate: float = 0.15, leaves: int = 3, ridge: float = 1.0,
) -> AdditiveModel:
    """Cyclic boosting of shallow trees, first on single features, then on the strongest pairs."""
    n, d = numbers.shape
    share = (labels.sum() + 1) / (n + 2)
    edges = [np.unique(np.quantile(numbers[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if not n or labels.min() == labels.max():
        return model
    binned = model.bins(numbers)
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * shallow_tree(
                np.bincount(binned[:, j], g, size), np.bincount(binned[:, j], h, size), ridge, leaves
            )
            model.tables[j] += step
            total += step[binned[:, j]]

    def table_of(values: np.ndarray, a: int, b: int) -> np.ndarray:
        shape = (len(model.tables[a]), len(model.tables[b]))
        return np.bincount(binned[:, a] * shape[1] + binned[:, b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {
        (a, b): pair_tree(table_of(g, a, b), table_of(h, a, b), ridge)[0] for a in range(d) for b in range(a + 1, d)
    }
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * pair_tree(table_of(g, a, b), table_of(h, a, b), ridge)[1]
            model.pair_tables[k] += step
            total += step[binned[:, a], binned[:, b]]
    return model


def train(numbered: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on about ``rows`` labelled rows at most, those with the smallest hashes of their ids."""
    pairs = numbered.select(key, "numbers").join(
        labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("label")), key
    )
    known = materialize(pairs, "labelled")
    share = rows / max(known.count(), rows)
    place = F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(1 << 30)) / (1 << 30)
    sample = known.where(place < share).orderBy(F.xxhash64(key), key, "label").limit(2 * rows).toPandas()
    numbers = np.array(sample["numbers"].tolist(), dtype=np.float32).reshape(len(sample), len(FEATURES))
    return fit(numbers, sample["label"].to_numpy())


def score(numbered: DataFrame, model: AdditiveModel) -> DataFrame:
    """``numbered`` with ``score`` instead of ``numbers``."""
    shared = numbered.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in numbered.schema.fields if f.name != "numbers"]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(batch.schema.get_field_index("numbers")).flatten()
                scores = shared.value.score(flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(scores)], names=[*names, "score"])

    return numbered.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def held_out(key: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: its id, ``held_out``, ``score`` and ``predicted``."""
    numbered = materialize(with_numbers(docs, text, (key,)), "numbers")
    model = train(numbered, labels.where(~held_out(F.col(key))), key, label)
    return score(numbered, model).select(
        key, held_out(F.col(key)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier accepts, with their columns.

    Texts are turned into numbers again for scoring, in the same pass that
    copies the rows, which is cheaper than a join of texts with their scores.
    """
    numbered = with_numbers(docs, text, (key,))
    labelled = numbered.join(labels.select(key).distinct(), key, "left_semi")
    model = train(labelled, labels.where(~held_out(F.col(key))), key, label)
    apart, back = set_aside(docs, ("numbers", "score"))
    text_now = next((k for k, v in back.items() if v == text), text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches, text_now):
            scores = shared.value.score(text_numbers(*text_bytes(part.column(part.schema.get_field_index(text_now)))))
            yield part.filter(pa.array(scores >= threshold))

    return apart.mapInArrow(run, apart.schema).withColumnsRenamed(back).select(*docs.columns)
