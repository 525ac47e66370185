"""Merkle manifest against a plain recursive one."""

import hashlib

import pytest
from pyspark.sql import functions as F

from terrafold.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(digests):
    """Root, and the siblings (left, right) of every leaf from the leaf to the root."""
    paths, where, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for leaf, at in enumerate(where):
            run = at // 8 * 8
            paths[leaf].append((nodes[run:at], nodes[at + 1 : run + 8]))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        where = [at // 8 for at in where]
    return nodes[0], paths


def plain_manifest(rows):
    parts = {}
    for row in rows:
        parts.setdefault(row["lang"], []).append((row["doc_id"], plain_leaf(row)))
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        leaves = sorted(parts[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = (leaves, *plain_tree([x[1] for x in leaves]))
    root, over = plain_tree([trees[lang][1] for lang in order])
    out = []
    for lang, up in zip(order, over):
        leaves, subroot, paths = trees[lang]
        for (doc_id, leaf), path in zip(leaves, paths):
            proof = H(*["".join(a) + "".join(b) for a, b in path + up])
            out.append((doc_id, leaf, subroot, root, proof))
    return out


def found(docs, **options):
    rows = merkle.dataset_manifest(docs, **options).collect()
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows], rows


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def rows_of(n, lang="en"):
    return [(i * 7 % 1009, f"text {i}", lang, f"s{i % 3}", i) for i in range(n)]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1}, {"a": 65, "b": 2}, {"en": 600, None: 70, "": 1}, {f"l{i}": 1 + i for i in range(20)}])
def test_same_as_plain_trees(spark, sizes):
    data = [row for lang, n in sizes.items() for row in rows_of(n, lang)]
    docs = spark.createDataFrame(data, SCHEMA)
    got, rows = found(docs)
    assert ordered(got) == ordered(plain_manifest([r.asDict() for r in docs.collect()]))
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    data = [(None, None, None, None, None), (None, "", "en", "", 0), (1, "x", "en", "s", 1), (1, "x", "en", "s", 1), (1, "y", "en", "s", 1),
            (2, "ü" * 300_000, "en", None, 5), (3, "X", "zz", "s", 1)] + [(9, "same", "en", "s", 4)] * 30
    docs = spark.createDataFrame(data, SCHEMA)
    more = docs.withColumns({c: F.lit(c) for c in ("digest", "tree", "place", "leaf", "root", "kids", "steps", "level", "claimed")})
    expected = ordered(plain_manifest([r.asDict() for r in docs.collect()]))
    got, rows = found(docs)
    assert ordered(got) == expected
    assert len(got) == len(data) and all(r["verified"] for r in rows)
    assert ordered(found(more)[0]) == expected


def test_no_rows(spark):
    got, _ = found(spark.createDataFrame([], SCHEMA))
    assert got == []


def test_changed_rows_do_not_verify(spark):
    docs = spark.createDataFrame([(i, f"Text {i}" if i % 2 else f"text {i}", "en" if i % 3 else "de", "s", i) for i in range(100)], SCHEMA)
    rows = merkle.dataset_manifest(docs, tampered=merkle.lower_ascii("text")).collect()
    for r in rows:
        assert r["verified"] == (r["doc_id"] % 2 == 0) == (r["leaf"] == r["claimed"]) == (r["folded_root"] == r["root"])


def test_steps_fold_outside_spark(spark):
    docs = spark.createDataFrame(rows_of(100) + rows_of(3, "de"), SCHEMA)
    for r in merkle.dataset_manifest(docs).collect():
        now = r["leaf"]
        for left, right in r["steps"]:
            now = H(bytes(left).hex(), now, bytes(right).hex())
        assert now == r["root"]


def test_schema(spark):
    kinds = dict(merkle.dataset_manifest(spark.createDataFrame(rows_of(3), SCHEMA)).dtypes)
    assert kinds["doc_id"] == "bigint" and kinds["verified"] == "boolean" and kinds["root"] == "string"
