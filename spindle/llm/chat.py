"""Chat formatting with typed content parts, in DataFrame functions alone.

A message is a role and an array of parts ``struct<type, text, ref, units>``. A visitor turns each part into text:
``text`` parts are escaped and kept; ``image``, ``audio`` and ``document`` parts become a placeholder, and their
reference and the number of tokens that the placeholder stands for are recorded, in order. Parts of any other type,
or of none, become the placeholder for unknown parts, with their reference and no tokens.

The template is ``<|turn|>role<|says|>content<|over|>`` and a line feed. In roles and texts a backslash is doubled and
put behind the first character of every control string, the template's own and those of other common templates, so
no control string is left in them and the escaping can be undone.

Turns of a conversation are gathered twice: first by spans of the turn number, then by conversation, so a conversation
of very many turns reaches its last task as few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"
SPAN = 64


@dataclass(frozen=True)
class Template:
    """Control strings, and the tokens that a unit of each kind of part expands to (images: patches, audio: seconds, documents: pages)."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    over: str = "<|over|>\n"
    placeholder: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    unknown: str = "<|unknown|>"
    tokens_a_unit: dict[str, float] = field(default_factory=lambda: {"image": 1.0, "audio": 12.5, "document": 256.0})
    # Starts of control strings of common templates.
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")
    learn_from: tuple[str, ...] = ("assistant",)


def escape(text: Column, template: Template) -> Column:
    """Text without control strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    """Undoes :func:`escape`: every backslash gives way to the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(PARTS)


def _choose(part: Column, by_kind: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for kind, value in by_kind.items():
        out = F.when(part["type"] == kind, value) if out is None else out.when(part["type"] == kind, value)
    return out.otherwise(otherwise)


def _visit(part: Column, template: Template, learn: Column) -> Column:
    """A part's piece of the content, with what there is to record of it."""
    is_text = F.coalesce(part["type"] == "text", F.lit(False))
    piece = _choose(part, {"text": escape(F.coalesce(part["text"], F.lit("")), template)} | {k: F.lit(v) for k, v in template.placeholder.items()}, F.lit(template.unknown))
    rate = _choose(part, {k: F.lit(float(v)) for k, v in template.tokens_a_unit.items()}, F.lit(0.0))
    # Units default to one; negative and undefined ones count as none.
    units = F.coalesce(part["units"], F.lit(1.0))
    units = F.when(F.isnan(units) | (units < 0), 0.0).otherwise(units)
    tokens = F.least(F.ceil(units * rate), F.lit(2**53)).cast("long")
    return F.struct(
        piece.alias("piece"),
        (is_text & learn).alias("learn"),
        F.when(~is_text, F.struct(F.coalesce(part["type"], F.lit("")).alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))).alias("attachment"),
    )


def _starts(pieces: Column, length) -> Column:
    """Positions at which pieces start, one more than pieces: their running total."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(pieces, zero, lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + length(p))))


def format_chats(messages: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """``(conv_id, formatted, loss_spans, attachments, n_turns, expanded_tokens)``: a row for each conversation.

    ``loss_spans`` are ``(turn, turn_start, start, length)`` in code points of ``formatted``: the texts of the learnt
    roles, in order, ``turn`` counted from 0 and ``turn_start`` the place of its turn mark. ``attachments`` are
    ``(turn, kind, ref, tokens)`` in order. Messages are ordered by turn, nulls first, equal turns by role and parts;
    repeated rows are turns of their own. Null roles, parts and texts are empty. Messages without an id are one
    conversation without an id. Other columns are ignored; no rows give no rows.
    """
    template = template or Template()
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    learn = role.isin(*template.learn_from)
    m = messages.select(
        F.col(id_col).alias("conv_id"),
        F.floor(F.col(turn_col) / SPAN).cast("long").alias("span"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)).alias("parts")).alias("key"),
        learn.alias("learn"),
    )
    head = F.concat(F.lit(template.turn), escape(F.col("key.role"), template), F.lit(template.says))
    m = m.withColumn("visited", F.transform("key.parts", lambda p: _visit(p, template, F.col("learn"))))
    m = m.withColumn("at", _starts(F.col("visited"), lambda p: F.char_length(p["piece"]).cast("long")))
    m = m.withColumn("body", F.concat(head, F.array_join(F.transform("visited", lambda p: p["piece"]), ""), F.lit(template.over)))
    placed = F.transform("visited", lambda p, i: F.struct(p["learn"].alias("learn"), (F.char_length(head) + F.element_at("at", i + 1)).alias("start"), F.char_length(p["piece"]).cast("long").alias("length")))
    spans = F.transform(F.filter(placed, lambda p: p["learn"]), lambda p: F.struct(p["start"], p["length"]))
    found = F.transform(F.filter("visited", lambda p: p["attachment"].isNotNull()), lambda p: p["attachment"])
    turns = m.select("conv_id", "span", F.struct("key", "body", F.char_length("body").cast("long").alias("length"), spans.alias("spans"), found.alias("found")).alias("t"))

    # First by spans of turns, then by conversation. Both sort by what the messages hold.
    some = turns.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    some = some.withColumn("at", _starts(F.col("ts"), lambda t: t["length"]))
    some = some.select(
        "conv_id",
        F.struct(
            "span",
            F.array_join(F.transform("ts", lambda t: t["body"]), "").alias("body"),
            F.element_at("at", -1).alias("length"),
            F.size("ts").cast("long").alias("n"),
            F.transform("ts", lambda t, i: F.struct(F.element_at("at", i + 1).alias("at"), t["spans"].alias("spans"), t["found"].alias("found"))).alias("turns"),
        ).alias("s"),
    )
    whole = some.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    whole = whole.withColumn("at", _starts(F.col("ss"), lambda s: s["length"])).withColumn("nth", _starts(F.col("ss"), lambda s: s["n"]))
    base = lambda i, j: F.element_at("nth", i + 1) + j.cast("long")
    spans = F.flatten(F.transform("ss", lambda s, i: F.flatten(F.transform(s["turns"], lambda t, j: F.transform(t["spans"], lambda x: F.struct(
        base(i, j).alias("turn"), (F.element_at("at", i + 1) + t["at"]).alias("turn_start"), (F.element_at("at", i + 1) + t["at"] + x["start"]).alias("start"), x["length"].alias("length")))))))
    found = F.flatten(F.transform("ss", lambda s, i: F.flatten(F.transform(s["turns"], lambda t, j: F.transform(t["found"], lambda x: F.struct(
        base(i, j).alias("turn"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ss", lambda s: s["body"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        found.alias("attachments"),
        F.element_at("nth", -1).alias("n_turns"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation of text parts: split at the marks, escaping undone."""
    template = template or Template()
    pieces = F.split(formatted, "\\Q" + template.over + "\\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(template.turn) + 1), F.char_length(piece))
        both = F.split(inner, "\\Q" + template.says + "\\E", 2)
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, escaping undone. Spans are cut from their own turns, not from the whole string."""
    template = template or Template()
    # An array of one struct: a lambda's argument is computed once, while the body is computed for every span.
    both = F.array(F.struct(F.split(formatted, "\\Q" + template.over + "\\E").alias("pieces"), spans.alias("spans")))
    cut = lambda z, s: unescape(F.substring(z["pieces"][s["turn"].cast("int")], (s["start"] - s["turn_start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.flatten(F.transform(both, lambda z: F.transform(z["spans"], lambda s: cut(z, s)))), "")
