"""Merkle manifest of a dataset with an inclusion proof per row, by pointer jumping.

Every row is a leaf: a hash over its columns, each written as its length and
value. Per part (language) the leaves in order of their id are hashed in runs of
``FANOUT`` consecutive nodes, level by level, until one node is left, the
subroot; the subroots in order of their part give the root in the same way.

1. Leaves are stored with their digests only, spread by range of (part, id), and
   numbered by counting rows per range and part, so no task sees a whole part.
2. A level is one aggregation: a run of nodes becomes a row with the digests of
   its nodes. A level has an eighth of the rows of the one before.
3. Exploding the runs gives every inner node a pointer to its parent and a
   segment, the siblings on its left and right. A self-join replaces the pointer
   by the parent's and appends the parent's segment, so the distance to the
   ancestor doubles with every round, and after log2(depth) rounds every node
   points to the root. Nodes far up are few (small joins are broadcast by
   their size), and nodes further down share an ancestor with few others.
4. A leaf takes the last hop from its run: its siblings there, followed by the
   run's segment. Leaves themselves are never joined.

Defined cases: null columns are hashed as ``-``; null and empty texts differ; rows
without part come first, as a part of their own; rows without id come first in
their part, repeated ids go by their digests, and equal rows are leaves of their own; no rows give no
rows; further columns are ignored, and columns are found by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.session import materialize

FANOUT = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = "top"  # the tree over the subroots; parts begin with "-" or ":"


def leaf_digest(columns: dict[str, Column] | None = None, names: tuple[str, ...] = LEAF_COLUMNS) -> Column:
    """Digest of a row as bytes; ``columns`` replaces some columns by expressions."""
    parts = []
    for name in names:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def lower_ascii(text: str) -> Column:
    return F.translate(F.col(text), _UPPER, _LOWER)


def _text(digests: Column) -> Column:
    """Digests as they are hashed: lowercase hex."""
    return F.lower(F.hex(digests))


def _hash(digests: Column) -> Column:
    """Digest of digests laid end to end."""
    return F.unhex(F.sha2(_text(digests).cast("binary"), 256))


def _joined(digests: Column) -> Column:
    """Digests of an array laid end to end."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _numbered(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with their place in their tree from 0, and (tree, leaves) of every tree."""
    keys = ["tree", *order]
    stored = materialize(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")  # equal rows can be told apart
    spread = stored.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row")
    spread = materialize(spread.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ordered-leaves")
    piece = F.shiftright("_at", 33)
    counts = spread.groupBy("tree", piece.alias("_piece")).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    counts = materialize(counts, "pieces")  # a row per range and tree in it
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select("tree", "_piece", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"))
    rows = spread.withColumn("_piece", piece).join(materialize(shift, "shifts"), ["tree", "_piece"])
    rows = rows.withColumn("place", F.col("_at") + F.col("_shift")).drop("_piece", "_at", "_shift")
    return rows, counts.groupBy("tree").agg(F.sum("n").alias("leaves"))


def _run(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Runs of consecutive nodes: (tree, place, leaves, kids), kids in order with their digests and the columns to carry."""
    kids = F.array_sort(F.collect_list(F.struct("place", "digest", *carry)))
    return nodes.groupBy("tree", F.expr(f"place div {FANOUT}").alias("place"), "leaves").agg(kids.alias("kids"))


def _levels(leaves: DataFrame, sizes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """Stored runs of every level, the lowest first, with their ``digest``; a tree of one leaf has one run, whose digest is the leaf's."""
    sizes = materialize(sizes, "sizes")
    most = sizes.agg(F.max("leaves")).first()[0] or 0
    found, nodes, level, reach = [], leaves.join(sizes, "tree"), 1, 1
    while level == 1 or reach < most:
        runs = _run(nodes, carry if level == 1 else [])
        lone = F.col("leaves") == 1
        digest = F.when(lone, F.col("kids")[0]["digest"]).otherwise(_hash(_joined(F.col("kids")["digest"])))
        runs = materialize(runs.select("tree", F.lit(level).alias("level"), "place", "leaves", digest.alias("digest"), "kids"), f"level-{level}")
        found.append(runs)
        reach *= FANOUT
        level += 1
        nodes = runs.where(F.col("leaves") > reach).select("tree", "place", "leaves", "digest")
    return found


def _step(kids: Column, k: Column) -> Column:
    """Siblings left and right of the kid at place ``k`` (from 0), as one segment; none for a tree of one leaf."""
    digests = kids["digest"]
    pair = F.struct(
        _joined(F.slice(digests, F.lit(1), k)).alias("left"),
        _joined(F.slice(digests, k + 2, F.lit(FANOUT))).alias("right"),
    )
    return F.when(F.col("leaves") > 1, F.array(pair)).otherwise(F.array().cast("array<struct<left:binary,right:binary>>"))


def _ends(levels: list[DataFrame]) -> DataFrame:
    """The last node of every tree: (tree, level, digest)."""
    found = None
    for k, runs in enumerate(levels):
        last = runs.where(F.col("leaves") <= FANOUT ** (k + 1))
        last = last if k == 0 else last.where(F.col("leaves") > FANOUT**k)
        last = last.select("tree", "level", "digest")
        found = last if found is None else found.unionByName(last)
    return found


def _hops(levels: list[DataFrame]) -> DataFrame:
    """Pointers of inner nodes to their parents in the same tree, with their segments."""
    found = None
    for runs in levels[1:]:
        kids = runs.select("*", F.posexplode("kids").alias("k", "kid"))
        hop = kids.select(
            "tree", (F.col("level") - 1).alias("level"), F.col("kid")["place"].alias("place"),
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("place").alias("up_place"),
            _step(F.col("kids"), F.col("k")).alias("steps"),
        )
        found = hop if found is None else found.unionByName(hop)
    return found


def _to_root(hops: DataFrame, depth: int) -> DataFrame:
    """Segments of all nodes to the root, after ceil(log2(depth)) rounds of pointer jumping."""
    now, distance = materialize(hops, "hops"), 1
    while distance < depth:
        above = now.select(
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("place").alias("up_place"),
            F.struct(F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_place").alias("place")).alias("to"),
            F.col("steps").alias("more"),
        )
        met = now.join(above, ["up_tree", "up_level", "up_place"], "left")
        now = materialize(met.select(
            "tree", "level", "place",
            F.col("to")["tree"].alias("up_tree"), F.col("to")["level"].alias("up_level"), F.col("to")["place"].alias("up_place"),
            F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat("steps", "more")).alias("steps"),
        ), "hops")
        distance *= 2
    return now


def fold(leaf: Column, steps: Column) -> Column:
    """Root that follows from a leaf's digest and its segments."""
    return F.aggregate(steps, leaf, lambda a, s: _hash(F.concat(s["left"], a, s["right"])))


def manifest(leaves: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """Proofs of leaves given as (part, order columns, digest, columns to carry).

    Returns the carried columns with ``digest``, ``subroot``, ``root`` (bytes) and
    ``steps``: per level from the leaf to the root the siblings left and right of the path.
    """
    tree = F.when(F.col("part").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), "part"))  # "-" sorts before ":"
    rows, sizes = _numbered(leaves.select(tree.alias("tree"), "digest", *dict.fromkeys([*order, *carry])), [*order, "digest"])
    parts = _levels(rows, sizes, carry)
    subroots = materialize(_ends(parts), "subroots")
    tops = subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("part"), "level", "digest")
    tops, count = _numbered(tops, ["part"])
    over = _levels(tops, count, ["part", "level"])
    kids = over[0].select("*", F.posexplode("kids").alias("k", "kid"))
    crossing = kids.select(
        F.col("kid")["part"].alias("tree"), F.col("kid")["level"].alias("level"), F.lit(0).cast("long").alias("place"),
        F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("place").alias("up_place"),
        _step(F.col("kids"), F.col("k")).alias("steps"),
    )
    hops = crossing
    for more in (_hops(parts), _hops(over)):
        hops = hops if more is None else hops.unionByName(more)
    paths = _to_root(hops, len(parts) + len(over)).where((F.col("level") == 1) & (F.col("tree") != _TOP))
    top = _ends(over).first()  # one row, or none without leaves
    root = F.lit(bytes(top["digest"]) if top else b"")
    known = materialize(subroots.select("tree", F.col("digest").alias("subroot")), "part-roots")
    runs = parts[0].join(paths.select("tree", "place", "steps"), ["tree", "place"]).join(known, "tree").withColumn("root", root)
    each = runs.select("*", F.posexplode("kids").alias("k", "kid"))
    return each.select(
        *[F.col("kid")[c].alias(c) for c in carry], F.col("kid")["digest"].alias("digest"), "subroot", "root",
        F.concat(_step(F.col("kids"), F.col("k")), "steps").alias("steps"),
    )


def dataset_manifest(docs: DataFrame, tampered: Column | None = None, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Per document its leaf, subroot, root and proof, and the root that follows from the row as found later.

    ``tampered`` is the text as found later (default: as it is); ``claimed`` is the
    digest of the row with it. Digests are lowercase hex, ``steps`` bytes.
    """
    later = F.col(text) if tampered is None else tampered
    leaves = docs.select(
        F.col(part).alias("part"), F.col(key).alias("doc_id"), leaf_digest().alias("digest"),
        F.when(~later.eqNullSafe(F.col(text)), leaf_digest({text: later})).alias("claimed"),
    )
    found = manifest(leaves, ["doc_id"], ["doc_id", "claimed"])
    siblings = F.aggregate("steps", F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"]))
    folded = _text(fold(F.coalesce("claimed", "digest"), F.col("steps")))
    found = found.select(
        "doc_id", _text(F.col("digest")).alias("leaf"), _text(F.coalesce("claimed", "digest")).alias("claimed"),
        _text(F.col("subroot")).alias("subroot"), _text(F.col("root")).alias("root"),
        F.sha2(_text(siblings).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), "steps",
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
