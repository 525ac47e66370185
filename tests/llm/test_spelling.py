"""Spelling variants against brute force over all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = []
    for word, n in counts.items():
        near = sorted((-m, w) for w, m in counts.items() if one_edit(word, w))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out.append([word, form, None, n, len(near), counts[form] if form else None])
    forms = {r[0]: r[1] for r in out}
    for r in out:
        at = r[0]
        while forms[at]:
            at = forms[at]
        r[2] = at
    return sorted(map(tuple, out))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def groups(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.spelling_groups(words, **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in found.collect())


def vocabulary(seed, n=400):
    """Words in which one to three edits lead to each other, and anagrams."""
    draw = random.Random(seed)
    words = set()
    while len(words) < n:
        word = list("".join(draw.choice(["an", "the", "ré", "öl", "st", "ing", "çà"]) for _ in range(draw.randint(2, 4))))
        for _ in range(draw.randint(0, 2)):
            at = draw.randrange(len(word))
            word[at : at + draw.randint(0, 1)] = draw.choice("aeéÿst")
        if len(word) >= 5:
            words.add("".join(word))
    return {w: draw.choice([3, 3, 4, 6, 8, 12, 30, 100]) for w in sorted(words)}


@pytest.mark.parametrize("options", [{}, {"sample_words": 60, "cell_words": 10, "block_words": 7, "chunk_words": 5}])
def test_same_as_all_pairs(spark, options):
    counts = vocabulary(len(options))
    assert groups(spark, counts, **options) == brute(counts)


def test_ties_chains_and_long_words(spark):
    long = "ab" * 40_000
    counts = {"wordsa": 3, "wordsb": 9, "wordsc": 9, "words": 18, "wards": 36, "wardsa": 35, long: 5, long[:-1]: 10, long[:-1] + "c": 20,
              "éclat": 3, "eclat": 6, "lone" * 3: 3}
    assert groups(spark, counts) == brute(counts)


def test_anagrams_are_split_over_blocks(spark):
    """All words have the same letters, so no split parts them; words with one letter more are near several."""
    same = ["".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 0, 5040, 17)]
    counts = {w: 3 + i % 5 for i, w in enumerate(same)} | {w[:3] + "x" + w[3:]: 50 for w in same[::9]}
    assert groups(spark, counts, cell_words=20, block_words=64, chunk_words=50) == brute(counts)


def test_words_of_documents(spark):
    draw = random.Random(5)
    pool = ["Straße", "naïve", "Zebra", "zebra", "ÉCOLE", "école", "word's", "tie×tie", "abc", "hello", "hellö"]
    rows = [(i if i % 10 else None, " ".join(draw.choices(pool, k=30))) for i in range(120)]
    rows += [(7, None), (8, ""), (9, "1234 --- ."), (3, "x" * 100_000), (3, "x" * 100_000), (3, "x" * 100_000)] + [(11, "repeat repeat")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("word", "n", "cell", "length")})
    counted = spelling.count_words(docs)
    assert {r["word"]: r["n"] for r in counted.collect()} == brute_words(rows)
    assert any(zlib.crc32(f"{d}:{w.lower()}".encode()) % 97 == 0 for d, t in rows if d for w in (t or "").split())


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(spelling.count_words(docs)).collect() == []


def test_cells_cover_every_ball():
    """Every point within the radius of a search lies in a cell that the search is sent to, and every point in one cell."""
    draw = np.random.default_rng(3)
    points = draw.integers(0, 4, (300, 90)) * (draw.random((300, 90)) < 0.05)
    tree, end = spelling.fit_cells(points[:100], 8, 5)
    row, cell = spelling.cells_within(tree, points, 0)
    assert sorted(row) == list(range(300)) and cell.min() >= 5 and cell.max() < end
    own = dict(zip(row.tolist(), cell.tolist()))
    sent = set(zip(*(x.tolist() for x in spelling.cells_within(tree, points, 2))))
    away = np.abs(points[:, None] - points[None]).sum(axis=2)
    assert all((s, own[p]) in sent for s, p in zip(*np.nonzero(away <= 2)))
    found = {pair for s, p in spelling.balls(*spelling.unary(points, points), 2) for pair in zip(s.tolist(), p.tolist())}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(away <= 2))))
