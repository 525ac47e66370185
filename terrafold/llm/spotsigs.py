"""Document fingerprints by spot signatures, with DataFrame expressions only.

A text is lower-cased and split into words; other stop words are left out. At
every anchor (an article or a similarly common word) a chain of the next content
words is taken, across any number of following anchors. The set of hashed
(anchor, chain) pairs is the document's signature set; it follows the running
text and ignores headings, menus and lists, which hold few anchors.

Near duplicates are found per partition of set lengths: two sets can only reach a
Jaccard similarity of t if their lengths differ by at most a factor of 1/t, so a
set meets the sets of its own band of lengths and the next. Of each set only the
prefix is listed that any similar set must hit, rarest signatures first.

Equal sets are one class before anything is compared. In a list (the classes of
one band with one signature) the shortest sets are compared with the others in
rounds; what is similar becomes one component, and members of one component are
not compared any more. So a large group of near copies costs a few comparisons
per member, not all its pairs. A list is done when its members are one component
or all have had their turn, so no similar pair stays apart; only a list of many
sets that are not similar is compared pair by pair, as far as their lengths and
the places of the signature allow.

Defined cases: null texts are empty and have the empty fingerprint; two empty
sets have likeness 1, an empty and another set 0, and an empty set is in no
class; a text without anchors has one signature, of its whole wording; repeated
rows share their results; ids may tie or be null, and a class is named after its
smallest id that is not null; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.components import connected_components
from terrafold.session import materialize, release

# Articles and forms of "to be" as anchors, by language (en, fr, de, es).
ANCHORS = (
    "a an the is was are be "
    "le la les un une des est "
    "der die das ein eine ist war "
    "el los las una es son"
).split()
# Other stop words, left out of the chains.
SKIPPED = (
    "and as at by for from in it of on or that this to with "
    "au aux avec ce dans de du en et il ou par pas pour que qui se sur "
    "als auf auch den dem für im mit nicht sich und von zu "
    "al con del lo no para por su y"
).split()
CHAIN = 2
PERCENT = 80
CENTRES = 16  # sets of a list that are compared with the others in the first round; four times as many in each next


def _any(words: list[str]) -> str:
    return "(" + "|".join(dict.fromkeys(words)) + ")"


def marked(text: Column) -> Column:
    """The words of a text, single-spaced, with a line break before every run of anchors and a tab after it."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    content = F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), f"(?<= ){_any(SKIPPED)} ", "")
    # Possessive, so that Java neither backtracks nor recurses in a long run.
    return F.regexp_replace(content, f"(?<= )((?:{_any(ANCHORS)} )++)", "\n$1\t")


def _first_words(piece: Column, chain: int) -> Column:
    """The first content words of a piece: what follows its anchors."""
    return F.rtrim(F.substring_index(F.ltrim(F.substring_index(piece, "\t", -1)), " ", chain))


def signatures(pieces: Column, heads: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of a marked text split at its line breaks; ``heads`` are the pieces' first words.

    The first piece precedes all anchors; any other begins with its anchors and
    has a content word, but perhaps for the last, so ``chain`` pieces hold the chain.
    """

    def of_piece(piece: Column, i: Column) -> Column:
        ahead = F.concat_ws(" ", *(F.get(heads, i + k) for k in range(chain)))
        words = F.rtrim(F.substring_index(ahead, " ", chain))
        anchors = F.split(F.rtrim(F.substring_index(piece, "\t", 1)), " ")
        spots = F.transform(anchors, lambda anchor: F.xxhash64(F.concat(anchor, F.lit(" "), words)))
        return F.when((i > 0) & (words != ""), spots).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, of_piece))))


def with_signatures(rows: DataFrame, texts: dict[str, str], chain: int = CHAIN) -> DataFrame:
    """Add a signature set under each name of ``texts`` for the text column it names."""
    kept = rows.columns
    rows = rows.withColumns({f"{name}__m": marked(F.col(text)) for name, text in texts.items()})
    rows = rows.withColumns({f"{name}__p": F.split(F.col(f"{name}__m"), "\n") for name in texts})
    rows = rows.withColumns({f"{name}__h": F.transform(F.col(f"{name}__p"), lambda p: _first_words(p, chain)) for name in texts})
    rows = rows.withColumns({f"{name}__s": signatures(F.col(f"{name}__p"), F.col(f"{name}__h"), chain) for name in texts})
    found = {}
    for name in texts:
        wording = F.trim(F.col(f"{name}__m"))
        whole = F.when(wording == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.xxhash64(wording)))
        found[name] = F.when(F.size(f"{name}__s") > 0, F.col(f"{name}__s")).otherwise(whole)
    return rows.select(*kept, *(column.alias(name) for name, column in found.items()))


def fingerprint(signature_set: Column) -> Column:
    """A signature set as text: 16 hexadecimal digits each, in order."""
    return F.array_join(F.transform(signature_set, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    together = F.size(a) + F.size(b) - common
    return F.when(together == 0, 1.0).otherwise(common / together)


def _prefixes(heads: DataFrame, percent: int) -> DataFrame:
    """The signatures any similar set must hit, rarest first: (node, n, token, place); those of one set only left out."""
    tokens = heads.select("node", F.explode("s").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-signatures")
    found = tokens.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    rows = found.join(heads.select("node", F.size("s").alias("n")), "node")
    alone = F.col("n") - F.size("found")
    wanted = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    rows = rows.select("node", "n", alone.alias("alone"), F.slice("found", F.lit(1), F.greatest(wanted, F.lit(0)).cast("int")).alias("first"))
    rows = rows.select("node", "n", "alone", F.posexplode("first").alias("place", "t"))
    stored = materialize(rows.select("node", "n", F.col("t.token").alias("token"), (F.col("alone") + F.col("place")).alias("place")), "prefixes")
    release(shared)
    return stored


def _lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """Lists by (token, band): the classes of the band, and as ``longer`` those of the next, each its own component at first."""
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9).cast("int")
    either = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("longer")), F.struct((band - 1).alias("band"), F.lit(True).alias("longer"))))
    rows = prefixes.withColumn("of", either)
    return rows.select("token", F.col("of.band").alias("band"), F.col("of.longer").alias("longer"), "node", "n", "place", F.col("node").alias("component"))


def _open(lists: DataFrame) -> DataFrame:
    """The rows of lists that still have several components and a set whose turn has not come."""
    lists_left = lists.groupBy("token", "band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.bool_and("longer").alias("done")
    ).where("low < high and not done")
    return lists.join(lists_left.select("token", "band"), ["token", "band"])


def link_sets(heads: DataFrame, percent: int = PERCENT, centres: int = CENTRES) -> DataFrame:
    """Connected components of similar sets (node, s): ``node`` and ``component``, for nodes with a link only."""
    sets = heads.select("node", "s")
    lists = _lists(_prefixes(heads, percent), percent)
    labels = None
    now = materialize(_open(lists), "lists")
    turn = Window.partitionBy("token", "band").orderBy("n", "node")
    while not now.isEmpty():
        first = now.where("not longer").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= centres)
        first = materialize(first.drop("longer", "turn"), "centres")
        c, x = first.alias("c"), now.alias("x")
        n_c, n_x = F.col("c.n"), F.col("x.n")
        # A similar pair's first common signature has all its others behind it, in both sets.
        most = F.least(n_c - F.col("c.place"), n_x - F.col("x.place"))
        fits = (
            (F.struct(n_c, F.col("c.node")) < F.struct(n_x, F.col("x.node")))
            & (F.col("c.component") != F.col("x.component"))
            & (100 * n_c >= percent * n_x)
            & ((100 + percent) * most >= percent * (n_c + n_x))
        )
        same = (F.col("c.token") == F.col("x.token")) & (F.col("c.band") == F.col("x.band"))
        met = c.join(x, same).where(fits).select(F.col("c.node").alias("a"), F.col("x.node").alias("b"))
        pairs = materialize(met.distinct(), "pairs")
        both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
        both = both.withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
        similar = both.where(100 * F.col("common") >= percent * (F.size("s_a") + F.size("s_b") - F.col("common")))
        similar = similar.select(F.col("a").alias("u"), F.col("b").alias("v"))
        known = [] if labels is None else [labels]
        links = materialize(similar, "links")
        new = labels is None or not links.isEmpty()
        if new:
            whole = links if labels is None else links.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
            labels = materialize(connected_components(whole), "labels")
        last = first.groupBy("token", "band").agg(F.max(F.struct("n", "node")).alias("last"))
        rest = now.drop("component").join(last, ["token", "band"], "left").where(
            F.col("last").isNull() | (F.struct("n", "node") > F.col("last"))
        ).drop("last")
        rest = rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        old, now = now, materialize(_open(rest), "lists")
        release(old, first, pairs, links, *(known if new else []))
        centres *= 4
    if labels is None:
        return heads.select("node", F.col("node").alias("component")).limit(0)
    return labels


def signature_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The signature set of every document version, stored: ``id``, ``version``, ``s`` and two hashes of the set, ``code_a`` and ``code_b``."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    rows = with_signatures(rows, {"s": "text"}).select("id", "version", "s").dropDuplicates(["id", "version"])
    return materialize(rows.select("*", F.xxhash64("s").alias("code_a"), F.xxhash64(F.lit("second"), "s").alias("code_b")), "signature-sets")


def similar_classes(sets: DataFrame, percent: int = PERCENT, centres: int = CENTRES) -> DataFrame:
    """``code_a``, ``code_b`` and ``class_id`` of the sets of :func:`signature_sets` that are not empty.

    A class holds all documents that similar sets connect and is named after its smallest id.
    """
    rows = sets.where(F.size("s") > 0)
    heads = rows.select("code_a", "code_b", "s").dropDuplicates(["code_a", "code_b"])
    heads = materialize(heads.withColumn("node", F.monotonically_increasing_id()), "heads")  # stored, so the numbers stay
    found = link_sets(heads, percent, centres)
    codes = heads.select("node", "code_a", "code_b").join(found, "node", "left").select(
        "code_a", "code_b", F.coalesce("component", "node").alias("component")
    )
    codes = materialize(codes, "codes")
    named = rows.groupBy("code_a", "code_b").agg(F.min("id").alias("id")).join(codes, ["code_a", "code_b"])
    names = materialize(named.groupBy("component").agg(F.min("id").alias("class_id")), "names")
    classes = materialize(codes.join(names, "component").select("code_a", "code_b", "class_id"), "classes")
    release(heads, codes, names)
    return classes


def next_by_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document version with the next one in descending order of ids.

    One narrow row per document is range-partitioned by id and stored with its
    partition; inside a partition the next row is a window away, and the last
    row of a partition takes the first row of the partition below it.
    """
    ids = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("version"), F.coalesce(F.char_length(text), F.lit(0)).alias("n"))
    ranged = ids.distinct().repartitionByRange("id", "version")
    stored = materialize(ranged.withColumn("part", F.spark_partition_id()), "id-ranges")
    me = F.struct("id", "version")
    inside = Window.partitionBy("part").orderBy(F.desc_nulls_last("id"), F.desc("version"))
    tops = stored.groupBy("part").agg(F.max(me).alias("top"))  # one row per partition
    below = Window.orderBy(F.desc("part"))
    tops = tops.select(
        "part", F.coalesce(F.lead("top").over(below), F.first("top").over(below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("turn")
    )
    linked = stored.withColumn("after", F.lead(me).over(inside)).join(tops, "part")
    after = F.coalesce("after", "turn")
    return linked.select("id", "version", "n", after["id"].alias("next_id"), after["version"].alias("next_version"))


def edited_pairs(docs: DataFrame, links: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its edited text: ``id``, ``version``, ``n_chars``, ``edited``; ``links`` as of :func:`next_by_id`.

    In the edited text the last third (rounded down, in code points) is replaced
    by as many of the first code points of the next document, or all it has.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("version"))
    wanted = links.select(
        F.col("next_id").alias("w_id"), F.col("next_version").alias("w_version"),
        F.col("id").alias("h_id"), F.col("version").alias("h_version"), F.floor(F.col("n") / 3).cast("int").alias("third"),
    )
    given = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("version") == F.col("w_version"))).select(
        "h_id", "h_version", F.substring(F.col("text"), F.lit(1), F.col("third")).alias("head")
    ).dropDuplicates(["h_id", "h_version"])
    both = rows.join(given, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("version") == F.col("h_version")))
    n = F.char_length("text")
    return both.select(
        "id", "version", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 3)).cast("int")), "head").alias("edited"),
    )


def _edited_sets(docs: DataFrame, links: DataFrame, key: str, text: str) -> DataFrame:
    found = with_signatures(edited_pairs(docs, links, key, text), {"edited_set": "edited"})
    return found.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited")


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with ``n_chars``, ``edited_sha256``, ``own_set``, ``edited_set``, ``next_set`` and ``class_id``.

    The only step that shuffles texts comes first and is stored as sets, so its
    shuffle files go before the classes are searched. Every set is computed once.
    """
    links = materialize(next_by_id(docs, key, text), "next")
    edited = materialize(_edited_sets(docs, links, key, text), "edited-sets")
    after = materialize(links.select("id", "version", "next_id", "next_version"), "following")
    release(links)
    sets = signature_sets(docs, key, text)
    classes = similar_classes(sets)
    of_next = sets.select(F.col("id").alias("w_id"), F.col("version").alias("w_version"), F.col("s").alias("next_set"))
    of_next = after.join(of_next, F.col("next_id").eqNullSafe(F.col("w_id")) & (F.col("next_version") == F.col("w_version")))
    of_next = of_next.select(F.col("id").alias("n_id"), F.col("version").alias("n_version"), "next_set")
    own = sets.join(classes, ["code_a", "code_b"], "left").select(
        F.col("id").alias("o_id"), F.col("version").alias("o_version"), F.col("s").alias("own_set"), "class_id"
    )
    rows = edited.join(own, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("version") == F.col("o_version")))
    rows = rows.join(of_next, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("version") == F.col("n_version")))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "own_set", "edited_set", "next_set", F.coalesce("class_id", "id").alias("class_id")
    )
