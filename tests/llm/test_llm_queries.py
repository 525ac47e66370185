"""Whole queries against SQL, brute force or held-out labels."""

import hashlib
import math
import os
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from terrafold.llm import packing, queries, span_dedup, spotsigs

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert numbers == list(range(1, 14))
    assert queries.statements().keys() <= queries.queries().keys()


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df, sql = queries.queries()[name](spark, sf_dir), queries.statements()[name]
    described = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    expected = duck.execute(sql)
    columns = [d[0] for d in expected.description]
    assert _sorted(df.columns, df.collect()) == _sorted(columns, expected.fetchall())


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_chat_formatting", "op9_document_fingerprints"])
def test_native_plans_run_no_python(name, spark, sf_dir):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Substring dedup


def _sentences(text):
    """(start byte, end byte, words) of every sentence; the end is the next sentence's start."""
    raw = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out, first = [], 0
    for i, (_, end) in enumerate(words):
        after = words[i + 1][0] if i + 1 < len(words) else len(raw)
        if raw[end - 1 : end] in b".!?" or b"\n" in raw[end:after] or i + 1 == len(words):
            out.append((words[first][0], after, [raw[a:b].lower() for a, b in words[first : i + 1]]))
            first = i + 1
    return out


def brute_spans(texts):
    found = defaultdict(list)
    for d in sorted(texts):
        s = _sentences(texts[d])
        for i in range(len(s)):
            if len(s[i][2]) >= span_dedup.LONG_SENTENCE:
                found[tuple(s[i][2])].append((d, s[i][0], s[i][1]))
            words = []
            for j in range(i, len(s)):
                words += s[j][2]
                if j - i + 1 >= span_dedup.MIN_SENTENCES and len(words) >= span_dedup.MIN_WORDS:
                    found[tuple(words)].append((d, s[i][0], s[j][1]))
                    break
    gone = defaultdict(set)
    for places in found.values():
        for d, a, b in sorted(set(places))[1:]:
            gone[d].update(range(a, b))
    out = {}
    for d, text in texts.items():
        raw = text.encode()
        out[d] = (bytes(x for i, x in enumerate(raw) if i not in gone[d]).decode(), len(raw), len(gone[d]))
    return out


def test_substring_dedup_equals_brute_force(spark, sf_dir, texts):
    rows = queries.substring_dedup(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["text"], r["n_bytes"], r["n_removed"]) for r in rows}
    expected = brute_spans(texts)
    assert got == expected and any(v[2] for v in expected.values())


# Packing


def naive_pack(rows, capacity):
    """(doc, piece) to bin number, for rows (doc_id, source, cluster, words) of one shard."""
    bins, out = [], {}
    for d, _, _, n in rows:
        for piece in range(n // capacity):
            out[d, piece] = len(bins)
            bins.append([0, set(), set()])
    for d, source, cluster, n in sorted(rows, key=lambda r: (-(r[3] % capacity), rows.index(r))):
        size = n % capacity
        if not size:
            continue
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        out[d, n // capacity] = i
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return out


def test_packing_equals_naive_best_fit(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = packing.pack(docs, capacity=300, shard_docs=40).collect()
    facts = {
        r["doc_id"]: r for r in docs.select("doc_id", "source", packing.same_text("text").alias("cluster"),
                                            F.regexp_count("text", F.lit(packing.WORD)).alias("n")).collect()
    }
    shards = defaultdict(set)
    for r in placed:
        shards[r["shard"]].add(r["doc_id"])
    assert len(shards) > 2 and sum(map(len, shards.values())) == len(facts)
    for shard, ids in shards.items():
        rows = [(d, facts[d]["source"], facts[d]["cluster"], facts[d]["n"]) for d in sorted(ids)]
        got = {(r["doc_id"], r["piece"]): r["bin"] for r in placed if r["shard"] == shard and r["bin"] is not None}
        assert got == naive_pack(rows, 300)
    words = defaultdict(int)
    for r in placed:
        words[r["doc_id"]] += r["n_words"]
    assert words == {d: f["n"] for d, f in facts.items()}


def test_packing_query_packs_every_word(spark, sf_dir, texts):
    words = defaultdict(int)
    for r in queries.best_fit_packing(spark, sf_dir).collect():
        words[r["doc_id"]] += r["n_words"]
    assert words == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}


# Suffix-array dedup


def brute_covered(texts, width=100):
    """(n_bytes, n_removed, n_spans, kept hash) of every (id, text) in order."""
    seen, out = set(), {}
    for d, text in texts:
        raw = text.encode()
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(window)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, sf_dir, texts):
    rows = queries.suffix_array_dedup(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    expected = brute_covered(sorted(texts.items()))
    assert got == expected and any(v[1] for v in expected.values())


# Quality classifier


def test_quality_on_held_out_labels(spark, sf_dir, duck):
    rows = queries.quality_classifier(spark, sf_dir).collect()
    labels = dict(duck.execute("select doc_id, quality from labels").fetchall())
    assert len(rows) == duck.execute("select count(*) from documents").fetchone()[0]
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in labels:
            right.append(r["predicted"] == labels[r["doc_id"]])
    assert sum(right) / len(right) >= 0.9


# Fingerprints


def _signatures(text):
    plain = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.lower())
    words = [w for w in plain.split(" ") if w]
    content = [w for w in words if w not in spotsigs.SKIPPED]
    out = set()
    for i, w in enumerate(content):
        if w in spotsigs.ANCHORS:
            chain = [x for x in content[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if chain:
                out.add(f"{w} {' '.join(chain)}")
    if not out and content:
        # Content words, then perhaps anchors, which have a line break before and a tab behind them.
        first = next((i for i, w in enumerate(content) if w in spotsigs.ANCHORS), len(content))
        out = {" ".join(content) if first == len(content) else (" ".join(content[:first]) + " " if first else "") + "\n" + " ".join(content[first:]) + " \t"}
    hashed = (xxhash.xxh64_intdigest(s.encode(), 42) for s in out)
    return sorted(h - (1 << 64) if h >= 1 << 63 else h for h in hashed)


def _classes(sets, percent=spotsigs.PERCENT):
    """The smallest id that similar sets connect with each id, by comparing all pairs."""
    above = {d: d for d in sets}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                above[high] = low
    return {d: root(d) for d in sets}


def test_fingerprints_equal_brute_force(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries.document_fingerprints(spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(rows) == sorted(texts)
    classes = _classes({d: set(_signatures(t)) for d, t in texts.items()})
    assert {d: r["class_id"] for d, r in rows.items()} == classes
    assert len(set(classes.values())) < len(texts)
    for d, after in zip(order, [*order[1:], order[0]]):
        n = len(texts[d])
        edited = texts[d][: n - n // 3] + texts[after][: n // 3]
        own, changed, following = (_signatures(t) for t in (texts[d], edited, texts[after]))
        r = rows[d]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{s % (1 << 64):016X}" for s in own)
        assert r["edited_fingerprint"] == "".join(f"{s % (1 << 64):016X}" for s in changed)
        for got, other in ((r["near_edited"], changed), (r["near_next"], following)):
            union = len({*own, *other})
            assert math.isclose(got, len({*own} & {*other}) / union if union else 1.0)
