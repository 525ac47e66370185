"""N-gram Jaccard join with grouped prefixes.

A document's set holds the hashes of its distinct word n-grams. Two sets of
Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of
each, in any order of tokens that all documents agree on. Here the lowest
quarter of the hash range comes first, by document frequency, so the prefix is
made of rare tokens; the other tokens follow by hash.

1. One numpy pass lists, for every document, its set's size, a hash of the set
   and its tokens of the low range (and as many others as a prefix may need).
2. Frequencies of the listed tokens are counted, in blocks of tokens that Spark
   deals out by hash range; tokens of one set only, however many copies it has, need
   no partner. Sets whose prefix is made of such tokens are done: no link.
3. Sets with equal size and prefix become one group. Groups that meet in a token
   and lie in the same or the next size band are linked in stars, not in pairs,
   and the connected components of these links are the candidates.
4. The members of a candidate component are expanded and verified exactly, in
   one task, against members that share a prefix token and are not connected
   yet. Components above ``block_bytes`` of text are split into blocks, and every pair of blocks
   is verified, so no task holds more than two blocks.

The result links every pair of different sets at or above the threshold, as
connected components; equal sets are one member and are never expanded to pairs.

Defined cases: null, empty and wordless texts have an empty set and link with
nothing; a text of fewer words than an n-gram has one token, all its words;
repeated rows are linked copies; rows without id take part, but a component is
named after its smallest id that is not null; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.bitmap import bits_for, broadcast_bitmap, in_bitmap
from terrafold.llm.components import connected_components
from terrafold.llm.text_arrays import Hasher, Words, lower_ascii, mix, runs_of, slices, text_bytes, word_bytes
from terrafold.session import materialize, release

LOW_RANGE = 0.25
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 18  # hashing needs many times its input, which stays in the cache so
_PART = 1 << 18  # tokens ranked at a time
_BLOCK = 1 << 20  # listed tokens counted at a time before they are dealt out
_BUCKET = 1 << 18  # listed tokens that a bucket has on average
_SETS = "doc_id long, version long, n_words long, n_shingles long, set_id long, n_listed int, tokens array<long>"


def _lower_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, Words]:
    data = lower_ascii(data)
    return data, Words(data, at, word_bytes("not_space"))


def token_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    tokens, first = _token_sets(*_lower_words(data, at), n)
    return [tokens[a:b] for a, b in zip(first[:-1], first[1:])]


def _token_sets(data: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts end to end, and where each begins."""
    counts = words.counts()
    first = _begins(np.where(counts >= n, counts - n + 1, counts > 0))
    tokens = np.empty(first[-1], dtype=np.uint64)
    if not len(tokens):
        return tokens, first
    codes = Hasher(data).spans(words.start, words.end)
    grams = runs_of(codes, n)
    for at, to, a, count in zip(first[:-1].tolist(), first[1:].tolist(), words.first.tolist(), counts.tolist()):
        if count >= n:
            one = tokens[at:to]
            one[:] = grams[a : a + to - at]
            one.sort()
        elif count:
            tokens[at] = runs_of(codes[a : a + count], count)[0] + np.uint64(count)
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = tokens[1:] != tokens[:-1]
    fresh[first[:-1][counts > 0]] = True
    return tokens[fresh], _begins(fresh)[first]


def _begins(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of these lengths begins, and the total at the end."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def set_hashes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each of the sets that lie end to end."""
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def set_hash(tokens: np.ndarray) -> int:
    return int(set_hashes(tokens, np.array([0, len(tokens)]))[0])


def prefix_length(n: int, percent: int) -> int:
    """How many leading tokens any set of similarity ``percent``/100 must hit."""
    return n - -(-percent * n // 100) + 1


def _listed_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document with its tokens; columns besides ``doc_id``, ``text`` and ``version`` come last, as they are."""
    low_end = np.uint64(int(LOW_RANGE * 2**64))
    more = [f for f in docs.schema.fields if f.name not in ("doc_id", "text", "version")]
    own = T._parse_datatype_string(_SETS)

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            raw, at = text_bytes(part.column(1))
            data, words = _lower_words(raw, at)
            tokens, first = _token_sets(data, words, n)
            sizes = np.diff(first)
            low = np.diff(_begins(tokens < low_end)[first])
            listed = np.where(sizes > 0, np.maximum(low, prefix_length(sizes, percent)), 0)
            place = np.arange(len(tokens)) - np.repeat(first[:-1], sizes)
            flat = tokens[place < np.repeat(listed, sizes)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(words.counts(), pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(set_hashes(tokens, first), pa.int64(), mask=sizes == 0), pa.array(listed.astype(np.int32), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(_begins(listed).astype(np.int32)), pa.array(flat)), *part.columns[3:]],
                names=[*own.names, *part.schema.names[3:]],
            )

    return docs.select("doc_id", "text", "version", *[f.name for f in more]).mapInArrow(run, T.StructType([*own.fields, *more]))


def _token_counts(key: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, with the smallest ``low``, the largest ``high`` and the sum of ``n`` of each."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(n[order], at)


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for each run of values between two cuts."""
    at = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def token_blocks(batches, buckets: int):
    """For batches (set_id, tokens): the counts of their tokens, a row per bucket of the hash range.

    A token that many sets have is one entry per block. The largest set is given by its
    bits that differ from the smallest: zeros for most tokens, which compress well.
    """
    for batch in batches:
        first = _begins(np.diff(batch.column(1).offsets.to_numpy()))
        tokens, set_id = batch.column(1).flatten().to_numpy().view(np.uint64), batch.column(0).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(first[:-1] // _BLOCK)) + 1).tolist(), len(set_id)]
        for a, b in zip(ends[:-1], ends[1:]):
            part = tokens[first[a] : first[b]]
            if not len(part):
                continue
            owner = np.repeat(set_id[a:b], np.diff(first[a : b + 1]))
            key = part << np.uint64(2) | part >> np.uint64(62)  # most tokens are of the low range, so their first bits say little
            key, low, high, n = _token_counts(key, owner, owner, np.ones(len(key), dtype=np.int64))
            bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(key)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]].view(np.int64)), *(_binaries(x, cuts) for x in (key, low, low ^ high, n))],
                names=["bucket", "key", "low", "differ", "n"],
            )


def shared_tokens(blocks: pa.Table) -> pa.Table:
    """Tokens of one bucket's blocks that more than one set has, and how many rows have them."""
    key, low, differ, n = (
        np.frombuffer(b"".join(blocks.column(name).to_pylist()), kind)
        for name, kind in (("key", np.uint64), ("low", np.int64), ("differ", np.int64), ("n", np.int64))
    )
    key, low, high, n = _token_counts(key, low, low ^ differ, n)
    token = (key >> np.uint64(2) | key << np.uint64(62)).view(np.int64)
    return pa.table({"token": token[low < high], "df": n[low < high]})


def _shared(sets: DataFrame) -> DataFrame:
    """Listed tokens of more than one set: (token, df)."""
    buckets = max(1, -(-(sets.agg(F.sum("n_listed")).first()[0] or 0) // _BUCKET))

    def count(batches):
        return token_blocks(batches, buckets)

    blocks = sets.select("set_id", "tokens").mapInArrow(count, "bucket long, key binary, low binary, differ binary, n binary")
    return blocks.groupBy("bucket").applyInArrow(shared_tokens, "token long, df long")


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """Groups of sets with equal size and prefix: (set_id, n_shingles, group, prefix), sets without a partner left out."""
    rows = sets.select("set_id", F.explode("tokens").alias("token"))
    shared = materialize(_shared(sets), "shared-tokens")
    is_high = (F.col("token") < 0) | (F.col("token") >= int(LOW_RANGE * 2**64))  # as signed numbers
    found = rows.join(shared.hint("shuffle_hash"), "token").select(  # a few of the tokens: rows need no sort
        "set_id", F.struct(is_high.alias("high"), F.when(is_high, 0).otherwise(F.col("df")).alias("df"), "token").alias("t")
    )
    found = found.groupBy("set_id").agg(F.sort_array(F.collect_set("t")).alias("found"))
    sizes = sets.groupBy("set_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_listed").alias("n_listed"))
    n = F.col("n_shingles")
    length = n - F.ceil(n * percent / 100) + 1
    alone = F.col("n_listed") - F.size("found")
    rows = found.join(sizes, "set_id").withColumn("wanted", (length - alone).cast("int")).where("wanted > 0")
    prefix = F.slice("found", F.lit(1), F.col("wanted"))["token"]
    rows = rows.select("set_id", "n_shingles", (alone > 0).alias("own"), prefix.alias("prefix"))
    group = F.xxhash64("n_shingles", "prefix", F.when(F.col("own"), F.col("set_id")))
    groups = materialize(rows.select("set_id", "n_shingles", group.alias("group"), "prefix"), "groups")
    release(shared)
    return groups


def _candidates(groups: DataFrame, percent: int) -> DataFrame:
    """Candidate components of groups: (group, component)."""
    one = groups.groupBy("group").agg(F.min("set_id").alias("set_id"))  # a group's members have the same prefix
    heads = groups.join(one, ["group", "set_id"]).select("group", "n_shingles", "prefix").dropDuplicates(["group"])
    band = F.floor(F.log(F.col("n_shingles")) / float(np.log(100 / percent))).cast("int")
    met = materialize(heads.select(F.explode("prefix").alias("token"), band.alias("band"), "group"), "prefix-tokens")
    stars = materialize(met.groupBy("token", "band").agg(F.min("group").alias("centre"), F.count("*").alias("n")), "stars")
    rays = met.join(stars.where("n > 1").hint("shuffle_hash"), ["token", "band"]).select(F.col("group").alias("u"), F.col("centre").alias("v"))
    above = stars.select("token", (F.col("band") - 1).alias("band"), F.col("centre").alias("v"))
    steps = stars.select("token", "band", F.col("centre").alias("u")).join(above.hint("shuffle_hash"), ["token", "band"]).select("u", "v")
    found = connected_components(rays.unionByName(steps)).withColumnRenamed("node", "group")
    release(met, stars)  # the components are stored
    return found


def _shared_ranks(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For sets that lie end to end: the ranks of their tokens that other sets have too, ascending in each set,
    where each set's begin, and the number of such tokens. Tokens of few sets come first."""
    ordered = np.sort(tokens)
    again = ordered[1:] == ordered[:-1]
    begin = np.flatnonzero(again & ~np.append(False, again[:-1]))
    df = np.flatnonzero(again & ~np.append(again[1:], False)) - begin + 2
    shared = ordered[begin]
    del ordered, again, begin
    if not len(shared):
        return np.zeros(0, np.int32), np.zeros(len(first), np.int64), 0
    rank = np.empty(len(shared), dtype=np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(shared), dtype=np.int32)
    ranks, is_shared = [], np.empty(len(tokens), dtype=bool)
    for a in range(0, len(tokens), _PART):
        part = tokens[a : a + _PART]
        at = np.minimum(np.searchsorted(shared, part), len(shared) - 1)
        same = is_shared[a : a + _PART] = shared[at] == part
        ranks.append(rank[at[same]])
    ranks, begins = np.concatenate(ranks), _begins(is_shared)[first]
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        ranks[a:b].sort()
    return ranks, begins, len(shared)


def _meeting_prefixes(ranks: np.ndarray, begins: np.ndarray, wanted: np.ndarray, n_shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by which the sets' prefixes, their first ``wanted`` ranks, meet, end to end, and where each set's begin.

    Of the tokens that the same sets have in their prefixes, one is enough.
    """
    length = np.maximum(wanted, 0)
    owner = np.repeat(np.arange(len(wanted), dtype=np.int32), length)
    token = ranks[np.repeat(begins[:-1] - _begins(length)[:-1], length) + np.arange(len(owner))]
    who = np.zeros(n_shared, dtype=np.uint64)
    np.add.at(who, token, mix(np.arange(1, len(wanted) + 1, dtype=np.uint64))[owner])
    several = np.flatnonzero(np.bincount(token, minlength=n_shared) > 1)
    kept = np.zeros(n_shared, dtype=bool)
    kept[several[np.unique(who[several], return_index=True)[1]]] = True
    use = kept[token]
    return token[use], _begins(np.bincount(owner[use], minlength=len(wanted)))


def linked_members(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For every set the first set of its connected component, by position."""
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
    return _linked_members(tokens, _begins(np.array([len(s) for s in sets], dtype=np.int64)), percent)


def _linked_members(tokens: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """:func:`linked_members` of sets that lie end to end.

    Sets are taken by size. Each looks up the earlier sets that share a token of
    its prefix (rarest tokens of this collection first) and verifies those it is
    not connected with yet. They are held by token and component, so a component
    the set already belongs to is passed over at once, however large. Tokens of one
    set come first in its prefix and are no more than a number.
    """
    n = np.diff(first)
    above, sizes = list(range(len(n))), n.tolist()

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    ranks, begins, n_shared = _shared_ranks(tokens, first)
    wanted = np.where(n > 0, prefix_length(n, percent) - (n - np.diff(begins)), 0)
    meeting, ends = _meeting_prefixes(ranks, begins, wanted, n_shared)
    begins, ends = begins.tolist(), ends.tolist()
    marked = np.zeros(n_shared, dtype=bool)
    by_token: dict[int, dict[int, list[int]]] = {}
    for x in np.argsort(n, kind="stable").tolist():
        prefix = meeting[ends[x] : ends[x + 1]].tolist()
        if not prefix:
            continue
        size, own = sizes[x], ranks[begins[x] : begins[x + 1]]
        marked[own] = True
        tried: set[int] = set()
        for t in prefix:
            held = by_token.setdefault(t, {})
            for r in [r for r in held if above[r] != r]:
                held.setdefault(root(r), []).extend(held.pop(r))
            for r, members in held.items():
                if root(r) == root(x):
                    continue
                for y in members:
                    if y in tried or 100 * sizes[y] < percent * size:
                        continue
                    tried.add(y)
                    common = int(np.count_nonzero(marked[ranks[begins[y] : begins[y + 1]]]))
                    if 100 * common >= percent * (size + sizes[y] - common):
                        low, high = sorted((root(x), root(y)))
                        above[high] = low
                        break
        marked[own] = False
        for t in prefix:
            by_token[t].setdefault(root(x), []).append(x)
    return np.array([root(i) for i in range(len(n))], dtype=np.int64)


def _place(doc_id: str, version: str) -> Column:
    """Where the text of a set is found again: by id, or by text for rows without id."""
    return F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(F.lit("no id"), version))


def _likely(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Texts that may be of members (place, text), by a bitmap of their places, so that few are shuffled; once each without id."""
    bits = bits_for(members.count())
    wanted = broadcast_bitmap(members.select("place"), "place", bits)

    @F.pandas_udf("boolean")
    def is_marked(places: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(places.to_numpy(np.int64).view(np.uint64), wanted.value, bits))

    def likely(part: DataFrame) -> DataFrame:
        part = part.where(F.col("text").isNotNull()).select(_place("doc_id", "version").alias("place"), "text")
        return part.where(is_marked("place"))  # only places leave the JVM

    unnamed = likely(rows.where(F.col("doc_id").isNull())).groupBy("place").agg(F.first("text").alias("text"))
    return likely(rows.where(F.col("doc_id").isNotNull())).unionByName(unnamed)


def linked_sets(table: pa.Table, n: int, percent: int) -> pa.Table:
    """Links (u, v) that connect what is similar among texts given with the hashes of their sets (set_id, text)."""
    kept, sizes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in slices(table.select(["set_id", "text"]).to_batches(), "text", SLICE_BYTES):
        tokens, first = _token_sets(*_lower_words(*text_bytes(part.column(1))), n)
        size, set_id = np.diff(first), part.column(0).to_numpy()
        same = (size > 0) & (set_hashes(tokens, first) == set_id)  # else another text of the same id
        kept.append(tokens[np.repeat(same, size)])
        sizes.append(size[same])
        ids.append(set_id[same])
    tokens, first, ids = np.concatenate(kept), _begins(np.concatenate(sizes)), np.concatenate(ids)
    del kept
    label = _linked_members(tokens, first, percent)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"u": ids[moved], "v": ids[label[moved]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def _links(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) between sets of one block pair."""

    def verify(table: pa.Table) -> pa.Table:
        return linked_sets(table, n, percent)

    return members.groupBy("component", "block_a", "block_b").applyInArrow(verify, "u long, v long")


def _linked_sets(rows: DataFrame, n: int, percent: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """All sets, one per row (doc_id, version, text), and the classes of those with a link: (node, component), both ``set_id``."""
    sets = materialize(_listed_sets(rows, n, percent), "sets")
    linked = sets.where("n_shingles > 0")
    groups = _groups(linked, percent)
    found = _candidates(groups, percent)
    members = groups.select("set_id", "group").join(found, "group", "left").select(
        "set_id", F.coalesce("component", "group").alias("component")
    )
    several = materialize(members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    first = linked.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("version").alias("version"))
    first = first.select("set_id", _place("doc_id", "version").alias("place"))
    members = materialize(members.join(several, "component").join(first, "set_id"), "members")
    texts = _likely(rows, members).join(members, "place").select("component", "set_id", "text")
    texts = materialize(texts, "member-texts")
    release(groups, several, members)
    size = texts.groupBy("component").agg(F.ceil(F.sum(F.octet_length("text")) / block_bytes).cast("int").alias("blocks"))
    size = materialize(size, "blocks")
    placed = texts.join(size, "component").withColumn("block", F.pmod(F.col("set_id"), "blocks").cast("int"))
    placed = placed.select("component", "set_id", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select(
        "component", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "set_id", "text"
    )
    classes = connected_components(_links(placed, n, percent))
    release(texts, size)
    return sets, classes


def near_copies(docs: DataFrame, text: str = "text", n: int = 4, percent: int = 85, block_bytes: int = BLOCK_BYTES, key: str = "doc_id") -> DataFrame:
    """For every text hash that is linked with another set: ``version`` and ``cluster``, the same for all texts of a component."""
    return counted_near_copies(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), n, percent, block_bytes)[1]


def counted_near_copies(docs: DataFrame, n: int = 4, percent: int = 85, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Every document's other columns, ``version`` and ``n_words``, counted in the pass that makes the sets, and :func:`near_copies`."""
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "version": F.xxhash64("text")})
    sets, classes = _linked_sets(rows, n, percent, block_bytes)
    found = sets.where("n_shingles > 0").select("version", "set_id").distinct().join(classes.withColumnRenamed("node", "set_id"), "set_id")
    copies = materialize(found.groupBy("version").agg(F.min("component").alias("cluster")), "near-copies")
    return sets.select(*[c for c in rows.columns if c != "text"], "n_words"), copies


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    sets, classes = _linked_sets(rows, n, percent, block_bytes)
    labelled = sets.select("doc_id", "n_shingles", "set_id").join(
        classes.withColumnRenamed("node", "set_id"), "set_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "set_id").alias("class"))
    labelled = materialize(labelled, "labelled")
    names = labelled.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(materialize(names, "names"), "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those linked to one with a smaller id; columns and rows else as they are.

    Rows without id, and repeated rows of a document that stays, stay.
    """
    copies = jaccard_components(docs, key, text, **options).where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(copies, key, "left_anti").select(*docs.columns)
