"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word's vector holds how often each letter occurs in it. One inserted or deleted
letter moves the vector by an L1 distance of one, one replaced letter by two. So
the near words of a word lie in a small ball around its vector, among the words
of the same length (radius two) and of the lengths one below and above (radius one).

1. Words are counted per task and then summed, whole texts.
2. Every length has a k-d tree whose cells hold about ``CELL_WORDS`` words. Its
   splits are fitted on a sample of at most about ``SAMPLE_WORDS`` words, chosen by
   hash; every word is put into its cell. The splits, of bounded number, are broadcast.
3. A word is sent to every cell of its own and the next length whose box is within
   the radius. Cells with many words (such as anagrams, which no split parts)
   are cut into blocks and cells with many searches into chunks, by counted size;
   every chunk meets every block, so tasks are bounded and no pair is lost.
4. A task builds a k-d tree of its block with bounding boxes (counts are written in unary
   there, so all distances are products of matrices), searches it with all words of the chunk at once, leaves out boxes beyond the radius, and compares the letters of
   the rest in order. It returns the number of near words and the best one per
   word, never the pairs.
5. Forms are followed to their end by pointer jumping; counts at least double
   with every form, so a chain is no longer than the logarithm of the largest count.

Defined cases: null texts have no words; runs of rows without id stay as they are
(nothing is deleted from them); repeated rows count each time; words of any
length take part; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.text_arrays import slices
from terrafold.session import materialize

MIN_LETTERS, MIN_COUNT = 5, 3
SAMPLE_WORDS = 200_000
CELL_WORDS = 12_000
BLOCK_WORDS, CHUNK_WORDS = 16_384, 16_384
_LEAF = 64
_BITS = 512
_PAIRS = 1 << 20  # vector entries compared at once
_FLUSH = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_LETTERS = 26 + 64  # a-z, U+00C0 to U+00FF
_HASHES = 1 << 20


# Words


def misspelt(doc_id: int, run: str) -> str:
    """The run, without one letter if its hash is a multiple of 97."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 97 else run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", edited: bool = True) -> DataFrame:
    """Words of ``MIN_LETTERS`` letters or more with their number of occurrences, from ``MIN_COUNT`` on.

    With ``edited``, runs are passed through :func:`misspelt` first.
    """

    def run(batches):
        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        found: Counter = Counter()
        for part in slices(batches, "text"):
            for doc_id, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not value:
                    continue
                runs = Counter(_RUN.findall(value.encode().lower().decode()))  # bytes.lower is for A-Z only
                if not edited or doc_id is None:
                    found.update(runs)
                else:
                    head = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in runs.items():
                        if not zlib.crc32(word.encode(), head) % 97:
                            word = misspelt(doc_id, word)
                        if len(word) >= MIN_LETTERS:
                            found[word] += n
                if len(found) > _FLUSH:
                    yield rows()
        yield rows()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").where(F.char_length("word") >= MIN_LETTERS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# Vectors and trees


def code_points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return raw.reshape(len(words), length).astype(np.int32)


def vectors(points: np.ndarray) -> np.ndarray:
    """Letter counts of words given by their code points."""
    letter = np.where(points < 0x80, points - ord("a"), points - 0xC0 + 26)
    kind = np.int16 if points.shape[1] < 1 << 14 else np.int32
    flat = np.arange(len(points))[:, None] * _LETTERS + letter
    return np.bincount(flat.ravel(), minlength=len(points) * _LETTERS).reshape(-1, _LETTERS).astype(kind)


def best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """Letter and count (of the lower side) that part vectors most evenly; none for equal vectors."""
    best, found, half = 0, None, len(counts) // 2
    low, high = counts.min(axis=0), counts.max(axis=0)
    for letter in np.flatnonzero(high > low):
        values, number = np.unique(counts[:, letter], return_counts=True)
        below = np.cumsum(number)[:-1]
        k = int(np.argmin(np.abs(below - half)))
        if (even := min(below[k], len(counts) - below[k])) > best:
            best, found = int(even), (int(letter), int(values[k]))
    return found


#: Splits of one length, lists by node: the letter (-1: a cell), its largest count on the lower side, the lower child (or the cell), the upper child.
Cells = tuple[list[int], list[int], list[int], list[int]]
_ALONE: Cells = ([-1], [-1], [-1], [-1])


def fit_cells(counts: np.ndarray, cell_words: float, first_cell: int) -> tuple[Cells, int]:
    """A tree with cells of at most ``cell_words`` of the vectors (more if equal), and the number after its last cell."""
    letter, most, below, above = tree = ([], [], [], [])
    pending, cell = [(counts, None)], first_cell
    while pending:
        rows, hook = pending.pop()
        node = len(letter)
        if hook is not None:
            hook[0][hook[1]] = node
        for column in tree:
            column.append(-1)
        split = best_split(rows) if len(rows) > cell_words else None
        if split is None:
            below[node] = cell
            cell += 1
            continue
        letter[node], most[node] = split
        lower = rows[:, split[0]] <= split[1]
        pending += [(rows[lower], (below, node)), (rows[~lower], (above, node))]
    return tree, cell


def cells_within(tree: Cells, counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell whose box is within the radius of a vector; with radius 0 the cell a vector lies in."""
    letters, most, below, above = tree
    rows, cells = [], []
    # per pending node: rows, their distance to the node's box, and the part of it that a letter already adds
    pending = [(0, np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64), {})]
    while pending:
        node, at, away, sides = pending.pop()
        if not len(at):
            continue
        letter = letters[node]
        if letter < 0:
            rows.append(at)
            cells.append(np.full(len(at), below[node], dtype=np.int64))
            continue
        here, before = counts[at, letter], sides.get(letter, np.zeros(len(at), dtype=np.int64))
        for child, beyond in ((below[node], here - most[node]), (above[node], most[node] + 1 - here)):
            added = np.maximum(beyond, before)  # boxes shrink, so a letter's own distance never falls
            now = away + added - before
            near = now <= radius
            kept = {k: v[near] for k, v in sides.items()}
            kept[letter] = added[near]
            pending.append((child, at[near], now[near], kept))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells)


def unary(points: np.ndarray, searches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both counts in bits: one per letter and count that it may reach, so that L1 distances become numbers of different bits.

    At most about ``_BITS`` in all: where words are so long that letters vary more, evenly spaced counts
    stand for the rest. Distances are then too small at most, and no near word is lost.
    """
    low, high = np.minimum(points.min(axis=0), searches.min(axis=0)), np.maximum(points.max(axis=0), searches.max(axis=0))
    letters = np.flatnonzero(high > low)
    steps = [np.unique(np.linspace(low[x] + 1, high[x], min(high[x] - low[x], max(1, _BITS // len(letters)))).astype(np.int64)) for x in letters]
    if not steps:
        return np.zeros((len(points), 0), np.float32), np.zeros((len(searches), 0), np.float32)
    column, least = np.repeat(letters, [len(x) for x in steps]), np.concatenate(steps)
    return (points[:, column] >= least).astype(np.float32), (searches[:, column] >= least).astype(np.float32)


def balls(points: np.ndarray, searches: np.ndarray, radius: int):
    """Pairs (search, point) with at most ``radius`` different bits, by a k-d tree with bounding boxes; yields arrays of both places."""
    pending = [(np.arange(len(points)), np.arange(len(searches)))]
    size, asked_size = points.sum(axis=1), searches.sum(axis=1)
    while pending:
        at, asked = pending.pop()
        box = points[at]
        number = box.sum(axis=0)
        always, never = number == len(at), number == 0
        away = always.sum() + searches[asked] @ (never.astype(np.float32) - always)
        asked = asked[away <= radius]
        if not len(asked):
            continue
        even = np.minimum(number, len(at) - number)
        if len(at) > _LEAF and len(even) and even.max() > 0:
            lower = box[:, even.argmax()] == 0
            pending += [(at[lower], asked), (at[~lower], asked)]
            continue
        step = max(1, _PAIRS // len(at))
        for k in range(0, len(asked), step):
            some = asked[k : k + step]
            away = asked_size[some][:, None] + size[at] - 2 * (searches[some] @ box.T)
            s, p = np.nonzero(away <= radius)
            yield some[s], at[p]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether code points of equal length differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the longer row is the shorter one with one more code point."""
    n = short.shape[1]
    head, tail = short != long[:, :n], short != long[:, 1:]
    first = np.where(head.any(axis=1), head.argmax(axis=1), n)
    last = np.where(tail.any(axis=1), n - 1 - tail[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_in_block(words: list[str], searches: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (search, word) one edit apart; all words have one length, all searches that length or one less."""
    length, asked = len(words[0]), len(searches[0])
    points, rows = code_points(words, length), code_points(searches, asked)
    check, radius = (one_replaced, 2) if length == asked else (one_inserted, 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s, p in balls(*unary(vectors(points), vectors(rows)), radius):
        step = max(1, _PAIRS // length)
        for k in range(0, len(s), step):
            ok = check(rows[s[k : k + step]], points[p[k : k + step]])
            found.append((s[k : k + step][ok], p[k : k + step][ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def best_of(owner: np.ndarray, other: np.ndarray, counts: np.ndarray, words: list[str]) -> list[tuple]:
    """(place of owner, number of others, largest count of them, first such word) per owner."""
    if not len(owner):
        return []
    used, spot = np.unique(other, return_inverse=True)
    order = np.empty(len(used), dtype=np.int64)
    order[sorted(range(len(used)), key=lambda i: words[used[i]])] = np.arange(len(used))
    by = np.lexsort((order[spot], -counts[other], owner))
    owner, other = owner[by], other[by]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    number = np.diff(np.append(first, len(owner)))
    return [(int(o), int(n), int(counts[x]), words[x]) for o, n, x in zip(owner[first], number, other[first])]


# The search over all words


def _fit(words: DataFrame, sample_words: int, cell_words: int) -> dict[int, Cells]:
    total = words.count()
    share = min(1.0, sample_words / max(total, 1))
    picked = words if share == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(_HASHES)) < int(share * _HASHES))
    by_length: dict[int, list[str]] = {}
    for row in picked.select("word").toLocalIterator():
        by_length.setdefault(len(row["word"]), []).append(row["word"])
    trees, cell = {}, 0
    for length, some in sorted(by_length.items()):
        trees[length], cell = fit_cells(vectors(code_points(sorted(some), length)), max(1.0, cell_words * share), cell)
    return trees


def _sent(words: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """Words with the cells they lie in and those they are searched in: (length, cell, point, asked, word, n); asked is the length of a search."""
    known = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for part in batches:
            texts, counts = part.column(0).to_pylist(), part.column(1).to_numpy()
            places: dict[int, list[int]] = {}
            for i, word in enumerate(texts):
                places.setdefault(len(word), []).append(i)
            for length, at in places.items():
                at = np.asarray(at)
                for some in np.array_split(at, -(-len(at) * length // _PAIRS)):  # long words in small parts
                    own = vectors(code_points([texts[i] for i in some], length))
                    for where, radius, point in ((length, 0, True), (length, 2, False), (length + 1, 1, False)):
                        row, cell = cells_within(known.value.get(where, _ALONE), own, radius)
                        for k in range(0, len(row), 50_000):
                            r = some[row[k : k + 50_000]]
                            size = len(r)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(size, where, np.int32)), pa.array(cell[k : k + 50_000]), pa.array(np.full(size, point)),
                                 pa.array(np.full(size, length, np.int32)), pa.array([texts[i] for i in r], pa.string()), pa.array(counts[r])],
                                names=["length", "cell", "point", "asked", "word", "n"],
                            )

    return words.select("word", "n").mapInArrow(run, "length int, cell long, point boolean, asked int, word string, n long")


def near_words(words: DataFrame, sample_words: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS,
               block_words: int = BLOCK_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per word (of ``word``, ``n``) with near words: ``n_near``, ``best_n`` and ``best``, the near word of the largest count, ties by code point."""
    sent = materialize(_sent(words, _fit(words, sample_words, cell_words)), "sent-words")
    is_point = F.col("point")
    sizes = sent.groupBy("length", "cell").agg(F.count_if(is_point).alias("points"), F.count_if(~is_point).alias("searches"))
    sizes = sizes.where("points > 0 and searches > 0").select(
        "length", "cell",
        F.ceil(F.col("points") / block_words).cast("int").alias("blocks"), F.ceil(F.col("searches") / chunk_words).cast("int").alias("chunks"),
    )
    rows = sent.join(materialize(sizes, "cell-sizes"), ["length", "cell"])
    spread = F.xxhash64(F.lit("part"), "word")
    block = F.pmod(spread, "blocks").cast("int")
    chunk = F.pmod(spread, "chunks").cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("block", F.explode(F.when(is_point, F.array(block)).otherwise(every("blocks"))))
    rows = rows.withColumn("chunk", F.explode(F.when(is_point, every("chunks")).otherwise(F.array(chunk))))

    def search(table: pa.Table) -> pa.Table:
        point = table.column("point").to_numpy(zero_copy_only=False)
        texts, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        asked, length = table.column("asked").to_numpy(), int(table.column("length")[0].as_py())
        inside = np.flatnonzero(point)
        out = []
        for size in (length, length - 1):
            out_of = np.flatnonzero(~point & (asked == size))
            if not len(out_of) or not len(inside):
                continue
            s, p = near_in_block([texts[i] for i in inside], [texts[i] for i in out_of])
            s, p = out_of[s], inside[p]
            out += best_of(s, p, counts, texts)
            if size < length:
                out += best_of(p, s, counts, texts)
        return pa.table(
            [pa.array([texts[o] for o, *_ in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    rows = rows.select("length", "cell", "block", "chunk", "point", "asked", "word", "n")
    found = rows.groupBy("length", "cell", "block", "chunk").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("first")["less"]).alias("best_n"), F.col("first")["best"].alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping over (word, form)."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not now.where("moved").take(1):
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_groups(words: DataFrame, **options) -> DataFrame:
    """Per word of ``words`` (word, n): ``form``, its near word of the largest count if that is twice its own, and ``root``, the last of its forms.

    Also ``n``, ``n_near`` and ``form_n``.
    """
    words = materialize(words.select("word", "n"), "words")
    rows = words.join(near_words(words, **options), "word", "left")
    twice = F.col("best_n") >= 2 * F.col("n")
    rows = materialize(rows.select(
        "word", F.when(twice, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(twice, F.col("best_n")).alias("form_n"),
    ), "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
