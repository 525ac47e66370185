"""Line dedup by a log-template tree, with DataFrame expressions only.

Tokens with digits become ``<*>``. The tree has a fixed depth: a line goes to
the leaf of its token count and its first ``depth`` tokens. Inside a leaf a
token is a constant of its position if at least ``min_docs`` document lines have
it there, otherwise a variable field, again ``<*>``; what results is the line's
template. A template with enough constants that occurs in at least ``min_docs``
documents is boilerplate: its lines are dropped everywhere but in the document
with the smallest id, so no content disappears altogether.

With ``long_words``, a line of that many tokens or more goes from the second
document on (``long_min_docs``): by its template, or as the same masked line, as a
token is called constant from ``min_docs`` documents on only. A copy without its
long lines is no longer found as a copy, so drop whole copies first; a second
pass with ``only_long`` reads no other lines.

Counting works on line hashes (128 bits) with partial aggregation. Only leaves
that hold several different lines need their tokens, and those are exploded once
per different line, however often it occurs. A leaf, line or template shared by
a third of all documents is therefore a few counters; the joins back to the
line occurrences are plain stored tables, whose hot keys adaptive execution can
split.

Defined cases: null and empty texts stay as they are; lines without tokens are
kept and match nothing; a line that occurs several times in a document counts
once, and in a document that loses it goes everywhere; repeated rows (same id
and text) count as one document and are cut alike; rows without id sort last;
further columns are kept, and ``n_chars`` follows the new text if present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.naming import set_aside
from terrafold.session import materialize

MIN_DOCS = 3
LONG_MIN_DOCS = 2
DEPTH = 3
CONSTANT_SHARE = 0.6
NOT_BLANK = r"[^\x20\x09-\x0D]"
SPACES = r"[\x09-\x0D]"
#: A token with a digit; beginning at the token's first character, it looks at every character once.
DIGIT_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_LAST = (1 << 63) - 1


def masked_tokens(line: Column) -> Column:
    """The tokens of a line, ``<*>`` for every one that has a digit; a very long token is read once.

    Lines are cut at single spaces, which needs no pattern; the few with other white space or digits are rewritten first.
    """
    plain = F.when(line.rlike(SPACES), F.regexp_replace(line, SPACES, " ")).otherwise(line)
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(plain, DIGIT_TOKEN, "<*>")).otherwise(plain)
    return F.array_remove(F.split(masked, " "), "")


def _lines(docs: DataFrame, key: str, text: str, depth: int, least: int = 1) -> DataFrame:
    """One row per line of at least ``least`` tokens: document, place, tokens, line hash and leaf.

    Lines that are blank or too short for so many tokens go first, as a filter on tokens makes Spark cut every line twice.
    """
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("version"),
        F.posexplode(F.split(text, "\n")).alias("place", "line"),
    )
    rows = rows.where(F.col("line").rlike(NOT_BLANK) if least <= 1 else F.octet_length("line") >= 2 * least - 1)
    rows = rows.select("doc", "version", "place", masked_tokens(F.col("line")).alias("tokens"))
    if least > 1:
        rows = rows.where(F.size("tokens") >= least)
    return rows.select(
        "doc", "version", "place", "tokens",
        F.xxhash64("tokens").alias("line_a"), F.xxhash64(F.lit("second"), "tokens").alias("line_b"),
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"),
    )


def _varied_templates(lines: DataFrame, varied: DataFrame, counts: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Template of every line of the leaves that hold several lines."""
    different = (
        lines.join(varied, "leaf", "left_semi")
        .groupBy("line_a", "line_b", "leaf").agg(F.first("tokens").alias("tokens"))
        .join(counts.select("line_a", "line_b", "docs"), ["line_a", "line_b"])
    )
    placed = materialize(
        different.select("leaf", "line_a", "line_b", "docs", F.posexplode("tokens").alias("at", "token")), "line-tokens"
    )
    constants = placed.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).drop("n")
    marked = placed.join(constants.withColumn("constant", F.lit(True)), ["leaf", "at", "token"], "left")
    word = F.struct("at", F.when(F.col("constant"), F.col("token")).otherwise("<*>").alias("token"))
    rebuilt = marked.groupBy("line_a", "line_b", "leaf").agg(
        F.array_sort(F.collect_list(word)).alias("words"),
    )
    kept = F.size(F.filter("words", lambda w: w["token"] != "<*>"))
    words = F.transform("words", lambda w: w["token"])
    return rebuilt.where(kept >= share * F.size("words")).select(
        "line_a", "line_b", F.xxhash64("leaf", words).alias("template_a"), F.xxhash64(F.lit("second"), "leaf", words).alias("template_b"),
    )


def dropped_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, share: float = CONSTANT_SHARE,
    long_words: int | None = None, long_min_docs: int = LONG_MIN_DOCS, only_long: bool = False,
) -> DataFrame:
    """Places of the lines to drop: one row per document version with ``places``."""
    lines = _lines(docs, key, text, depth, long_words if only_long else 1)
    narrow = materialize(
        lines.select("doc", "version", "place", "line_a", "line_b", "leaf", F.size("tokens").alias("n_tokens"),
                     F.size(F.array_remove("tokens", "<*>")).alias("n_fixed")),
        "lines",
    )
    in_docs = narrow.select("doc", "version", "line_a", "line_b", "leaf", "n_tokens", "n_fixed").distinct()
    counts = materialize(
        in_docs.groupBy("line_a", "line_b", "leaf", "n_tokens", "n_fixed").agg(F.count("*").alias("docs")), "line-counts"
    )
    leaves = materialize(
        counts.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("variants")).where(F.col("docs") >= min_docs),
        "leaves",
    )
    varied = leaves.where("variants > 1").select("leaf")
    alone = counts.join(leaves.where("variants = 1").select("leaf"), "leaf", "left_semi").where(
        F.col("n_fixed") >= share * F.col("n_tokens")
    )
    itself = ("line_a", "line_b", F.col("line_a").alias("template_a"), F.col("line_b").alias("template_b"))
    templates = alone.select(*itself).unionByName(_varied_templates(lines, varied, counts, min_docs, share))
    if long_words is not None:
        same = (F.col("n_tokens") >= long_words) & (F.col("docs") >= long_min_docs) & (F.col("n_fixed") >= share * F.col("n_tokens"))
        templates = templates.unionByName(counts.where(same).select(*itself)).distinct()
    templates = materialize(templates, "templates")
    found = materialize(
        narrow.join(templates, ["line_a", "line_b"]).select("doc", "version", "place", "n_tokens", "template_a", "template_b"), "occurrences"
    )
    # The smallest document has one version that counts as first: that with the smallest text hash.
    per_doc = found.groupBy("template_a", "template_b", "doc", "version").agg(F.first("n_tokens").alias("n_tokens"))  # one length per template
    recurring = per_doc.groupBy("template_a", "template_b").agg(
        F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.first("n_tokens").alias("n_tokens")
    )
    enough = F.lit(min_docs) if long_words is None else F.when(F.col("n_tokens") >= long_words, long_min_docs).otherwise(min_docs)
    recurring = materialize(recurring.where(F.col("n") >= enough).drop("n", "n_tokens"), "recurring")
    later = found.drop("n_tokens").join(recurring, ["template_a", "template_b"]).where("doc > first_doc")
    return later.groupBy("doc", "version").agg(F.collect_set("place").alias("places"))


RESULT_COLUMNS = ("n_lines", "n_dropped")
_HELPERS = ("doc", "version", "cut_doc", "cut_version", "places", "lines")


def drop_template_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without recurring lines, with ``n_lines`` and ``n_dropped``.

    Columns of these two names are replaced.
    """
    apart, back = set_aside(docs.drop(*RESULT_COLUMNS), _HELPERS)
    names = {v: k for k, v in back.items()}
    key_now, text_now = names.get(key, key), names.get(text, text)
    cuts = dropped_lines(apart, key_now, text_now, **options).withColumnsRenamed({"doc": "cut_doc", "version": "cut_version"})
    keyed = apart.withColumns({"doc": F.coalesce(F.col(key_now).cast("long"), F.lit(_LAST)), "version": F.xxhash64(text_now)})
    same = (F.col("doc") == F.col("cut_doc")) & (F.col("version") == F.col("cut_version"))
    joined = keyed.join(cuts, same, "left").withColumn(
        "lines", F.when(F.col("places").isNotNull(), F.split(text_now, "\n"))
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    changes = {
        "n_lines": F.coalesce(F.regexp_count(F.col(text_now), F.lit("\n")) + 1, F.lit(0)).cast("long"),
        "n_dropped": F.when(F.col("places").isNotNull(), F.size("places")).otherwise(0).cast("long"),
        text_now: F.when(F.col("places").isNotNull(), kept).otherwise(F.col(text_now)),
    }
    out = joined.withColumns(changes)
    if "n_chars" in docs.columns:
        recounted = F.when(F.col("places").isNotNull(), F.char_length(text_now)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", recounted.cast("long"))
    return out.select(*apart.columns, *RESULT_COLUMNS).withColumnsRenamed(back)


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without recurring lines, with the columns they came with."""
    apart, back = set_aside(docs, RESULT_COLUMNS)
    names = {v: k for k, v in back.items()}
    out = drop_template_lines(apart, names.get(key, key), names.get(text, text), **options)
    return out.drop(*RESULT_COLUMNS).withColumnsRenamed(back).select(*docs.columns)
