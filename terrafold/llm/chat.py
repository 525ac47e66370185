"""Chat formatting: turns of a conversation to one marked string, with a loss mask.

Only DataFrame expressions are used. The turns of a conversation are collected,
sorted and rendered with array functions:

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

Adjacent turns of one role are merged into one block, its texts kept apart by
``<|im_sep|>`` so that the turns can be read back. Every control string begins
with ``<|``; inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (in roles a newline becomes ``<\\n``), so no text can produce or break
a mark, and the step is reversible.
Work grows with the length of a conversation, not with its square.

Defined cases: null texts and roles are empty; turns sort by turn, role, text,
null turn first; repeated rows are repeated turns; rows without a conversation
id form one conversation; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
BLOCK_TURNS = 256  # turns whose positions are added up together
CHUNK_BITS = 10  # loss text is read from chunks of 1,024 code points


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chat(
    turns: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds the 1-based code point position and length of every
    (escaped) text of a loss role inside ``formatted``, in order; marks are
    never under the loss mask.
    """
    rows = turns.select(
        F.col(conversation).alias("conversation"),
        F.struct(
            F.col(order).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conversation").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        closes = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        head = F.when(opens, F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).otherwise(SEPARATOR)
        return F.struct(
            head.alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise("").alias("tail"),
            t["role"].isin(*loss_roles).alias("loss"),
        )

    def advance(state: Column, p: Column) -> Column:
        """Add the lengths of a piece, and its span if it counts for the loss."""
        begins = state["at"] + F.char_length(p["head"])
        length = F.char_length(p["body"])
        spans = F.when(
            p["loss"],
            F.concat(state["spans"], F.array(F.struct(begins.alias("start"), length.alias("length")))),
        ).otherwise(state["spans"])
        return F.struct((begins + length + F.char_length(p["tail"])).alias("at"), spans.alias("spans"))

    def place(state: Column, block: Column) -> Column:
        """Add the length of a block, and its spans with the position where it begins."""
        begun = F.struct(state["at"].alias("at"), block["spans"].alias("spans"))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["blocks"], F.array(begun)).alias("blocks"))

    # An array that grows by one element is copied each time: short within a block, one per block across them.
    spans = "array<struct<start:int,length:int>>"
    nothing = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {spans})").alias("spans"))
    no_block = F.struct(F.lit(1).alias("at"), F.expr(f"cast(array() as array<struct<at:int,spans:{spans}>>)").alias("blocks"))
    pieces = sorted_turns.select("conversation", F.transform("turns", piece).alias("pieces"))
    starts = F.sequence(F.lit(1), F.size("pieces"), F.lit(BLOCK_TURNS))
    blocks = F.transform(starts, lambda i: F.aggregate(F.slice("pieces", i, F.lit(BLOCK_TURNS)), nothing, advance))
    placed = F.aggregate(blocks, no_block, place)["blocks"]
    moved = F.transform(
        placed, lambda b: F.transform(b["spans"], lambda s: F.struct((b["at"] + s["start"]).alias("start"), s["length"].alias("length")))
    )
    return pieces.select(
        F.col("conversation").alias(conversation),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten(moved).alias("loss_spans"),
    )


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""

    def turns_of(block: Column) -> Column:
        opened = F.substring(block, len(START) + 1, 2**31 - 1)
        role = F.substring_index(opened, "\n", 1)
        texts = F.split(F.substring(opened, F.char_length(role) + 2, F.lit(2**31 - 1)), _quoted(SEPARATOR))
        return _once(
            _unescape_role(role), lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescape(x).alias("text")))
        )

    blocks = F.filter(F.split(formatted, _quoted(END)), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns_of))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, not again for every element of a function inside."""
    return F.get(F.transform(F.array(value), use), 0)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between.

    The string is cut into chunks in one pass and a span is read from the chunks
    it lies in, as a position in a long string is found from its beginning only.
    """
    size = 1 << CHUNK_BITS
    chunks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def read(c: Column, s: Column) -> Column:
        first, end = s["start"] - 1, s["start"] - 1 + s["length"]
        count = F.shiftright(end + size - 1, CHUNK_BITS) - F.shiftright(first, CHUNK_BITS)
        around = F.array_join(F.slice(c, F.shiftright(first, CHUNK_BITS) + 1, F.greatest(count, F.lit(0))), "")
        return unescape(F.substring(around, first.bitwiseAND(size - 1) + 1, s["length"]))

    return _once(chunks, lambda c: F.array_join(F.transform(spans, lambda s: read(c, s)), ""))
