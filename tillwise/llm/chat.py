"""Chat formatting: every assistant turn is an example of its own, whose context is all
turns before it and in which only that reply is trained on.

``format_chat`` puts the turns in the template and numbers their characters, a row per
turn; ``examples`` copies the contexts out, a row per assistant turn. Examples are as many
characters as the method asks for: the sum of all prefixes. Their making is dealt out by
that sum, so that a long conversation is expanded by many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
USER = ("<s>[INST] ", " [/INST]")
ASSISTANT = (" ", " </s>")
OTHER = ("[ROLE ", "]", " [/ROLE]")
#: Characters of examples that one task's share of a conversation has.
SHARE_CHARS = 16 << 20
#: Characters of examples that go on together.
_BATCH_CHARS = 4 << 20
_NAME, _ESCAPE = re.compile(r"(?:\]\\|[^\]])*"), re.compile(r"([<\[\\])\\")
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\]|/?ROLE[ \]])|\\"


def escaped(text: Column) -> Column:
    """A backslash after the first character of every control string, and of every
    backslash. No control string is left, and ``unescaped`` gives the text back."""
    return F.regexp_replace(text, f"({_CONTROL})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def turn_order() -> list[Column]:
    """Turns by number, null first; ties by role, then text."""
    return [F.col("turn"), F.col("role"), F.col("text")]


def format_chat(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) -> one row per turn: conv_id, turn,
    position (from 1), role, piece, context_chars, loss_start, loss_end.

    ``piece`` is the turn in the template. The pieces of a conversation in order are its
    formatted string; an example is the string up to and including an assistant's piece.
    ``context_chars`` is the length of the string before the piece, and loss covers its
    characters from ``loss_start`` up to before ``loss_end``, both counted in the whole
    string. Other roles have no loss (null).

    A null text is empty. Roles other than user and assistant, null too, are named in the
    template. Null conv_id is a conversation of its own. Repeated rows are turns. A long
    conversation streams through its task in order and is never held as a whole.
    """
    role = F.col("role")
    text = F.coalesce("text", F.lit(""))
    safe = escaped(text)
    named = F.when(role.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.regexp_replace(escaped(role), r"\]", "\\]\\\\")))
    is_user, is_assistant = role.eqNullSafe(F.lit("user")), role.eqNullSafe(F.lit("assistant"))
    before = F.when(is_user, F.lit(USER[0])).when(is_assistant, F.lit(ASSISTANT[0])).otherwise(
        F.concat(F.lit(OTHER[0]), named, F.lit(OTHER[1]), F.lit(" ")))
    after = F.when(is_user, F.lit(USER[1])).when(is_assistant, F.lit(ASSISTANT[1])).otherwise(F.lit(OTHER[2]))
    pieces = (conversations.select("conv_id", "turn", "role", text.alias("text"))
              .withColumn("head", F.length(before)).withColumn("body", F.length(safe))
              .withColumn("piece", F.concat(before, safe, after)))
    ordered = Window.partitionBy("conv_id").orderBy(*turn_order())
    upto = F.sum(F.length("piece")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(is_assistant, F.col("context_chars") + F.col("head"))
    return (pieces.withColumn("position", F.row_number().over(ordered))
            .withColumn("context_chars", F.coalesce(upto, F.lit(0)).cast("long"))
            .select("conv_id", "turn", "position", "role", "piece", "context_chars", start.cast("long").alias("loss_start"),
                    (start + F.col("body")).cast("long").alias("loss_end")))


def parsed(formatted: DataFrame) -> DataFrame:
    """Role and text of every piece, read from the template alone, and what the loss mask
    covers: the columns of ``formatted`` with found_role, found_text and loss_text (null
    where nothing is trained on)."""
    piece = F.col("piece")
    other = F.regexp_extract(piece, r"(?s)^\[ROLE ((?:\]\\|[^\]])*)\] (.*) \[/ROLE\]$", 1)
    body = F.regexp_extract(piece, r"(?s)^\[ROLE ((?:\]\\|[^\]])*)\] (.*) \[/ROLE\]$", 2)

    def within(ends: tuple[str, str]) -> Column:
        return piece.substr(F.lit(len(ends[0]) + 1), F.length(piece) - len(ends[0]) - len(ends[1]))

    is_user, is_other = piece.startswith(USER[0]), piece.startswith(OTHER[0])
    role = F.when(is_user, F.lit("user")).when(is_other, F.when(other != "", unescaped(
        F.regexp_replace(F.expr("substr(_other, 2)"), r"\]\\", "]")))).otherwise(F.lit("assistant"))
    text = F.when(is_user, within(USER)).when(is_other, body).otherwise(within(ASSISTANT))
    masked = piece.substr(F.col("loss_start") - F.col("context_chars") + 1, F.col("loss_end") - F.col("loss_start"))
    return formatted.withColumn("_other", other).withColumns({
        "found_role": role, "found_text": unescaped(text),
        "loss_text": F.when(F.col("loss_start").isNotNull(), unescaped(masked))}).drop("_other")


def _rows(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), fields.values())], list(fields))


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples from turns in order: the string so far is all that is kept."""
    group, prefix, rows, held = None, "", [], 0
    fields = {"conv_id": None, "position": pa.int64(), "text": pa.string(), "loss_start": pa.int64(), "loss_end": pa.int64(),
              "is_last": pa.bool_()}
    for batch in batches:
        fields["conv_id"] = batch.schema.field(0).type
        for conv, share, own, position, piece, start, end, last in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (conv, share):
                group, prefix = (conv, share), ""
            prefix += piece
            if own:
                rows.append((conv, position, prefix, start, end, last))
                held += len(prefix)
                if held >= _BATCH_CHARS:
                    yield _rows(rows, fields)
                    rows, held = [], 0
    if rows:
        yield _rows(rows, fields)


def examples(formatted: DataFrame) -> DataFrame:
    """The result of ``format_chat`` -> one row per assistant turn: conv_id, position, text,
    loss_start, loss_end, is_last.

    ``text`` is the formatted string from the conversation's first turn to that reply, and
    only its characters from ``loss_start`` to before ``loss_end`` are trained on. A
    conversation that ends in another role's turn has one row more, its whole string without
    loss (null), a prompt still to be answered; so ``is_last`` marks one row of every
    conversation, and that row holds all its turns.

    Every example is made, however long. A conversation's examples are made in shares of
    about ``SHARE_CHARS`` characters, and a share receives the turns up to its last example:
    turns are copied less often than the examples themselves repeat them.
    """
    by_conversation = Window.partitionBy("conv_id")
    earlier = by_conversation.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    chars = F.when(F.col("is_last") | F.col("loss_start").isNotNull(), F.col("context_chars") + F.length("piece"))
    turns = (formatted.withColumn("is_last", F.col("position") == F.max("position").over(by_conversation))
             .withColumn("chars", chars)
             .withColumn("first", F.floor(F.coalesce(F.sum("chars").over(earlier), F.lit(0)) / SHARE_CHARS))
             .withColumn("final", F.max("first").over(by_conversation))
             .withColumn("share", F.explode(F.sequence("first", "final"))))
    dealt = turns.repartition("conv_id", "share").sortWithinPartitions("conv_id", "share", "position").select(
        "conv_id", "share", (F.col("chars").isNotNull() & (F.col("share") == F.col("first"))).alias("own"),
        F.col("position").cast("long"), "piece", "loss_start", "loss_end", "is_last")
    return dealt.mapInArrow(
        _expanded, f"conv_id {kind}, position long, text string, loss_start long, loss_end long, is_last boolean")


def read_turns(text: str) -> Iterator[tuple[str | None, str]]:
    """Role and text of every turn of a formatted string, from the template alone."""
    def plain(escaped_text: str) -> str:
        return _ESCAPE.sub(r"\1", escaped_text)

    at = 0
    while at < len(text):
        if text.startswith(USER[0], at):
            role, start, after = "user", at + len(USER[0]), USER[1]
        elif text.startswith(OTHER[0], at):
            named = _NAME.match(text, at + len(OTHER[0]))
            role = plain(named[0][1:].replace("]\\", "]")) if named[0] else None
            start, after = named.end() + len(OTHER[1]) + 1, OTHER[2]
        else:
            role, start, after = "assistant", at + len(ASSISTANT[0]), ASSISTANT[1]
        end = text.index(after, start)
        yield role, plain(text[start:end])
        at = end + len(after)


_DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
            "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_examples": pa.int64(), "example_chars": pa.int64()}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its examples in order, an example at a time; its last
    row closes it."""
    count = chars = total = 0
    loss = hashlib.sha256()
    for batch in batches:
        rows = []
        for conv, reply, size, whole in zip(*(c.to_pylist() for c in batch.columns)):
            if reply is not None:
                count, chars, total = count + 1, chars + len(reply), total + size
                loss.update(reply.encode())
            if whole is not None:
                turns, n = hashlib.sha256(), 0
                for role, text in read_turns(whole):
                    turns.update(f"{role or ''}\n{text}\n".encode())
                    n += 1
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), len(whole), count, total))
                count = chars = total = 0
                loss = hashlib.sha256()
        if rows:
            yield _rows(rows, _DIGESTS)


def conversation_digests(expanded: DataFrame) -> DataFrame:
    """What the result of ``examples`` says when it is read back: one row per conversation
    with its turns and the SHA-256 of role, line feed, text, line feed per turn, read from its
    last row; characters and SHA-256 of the text that its examples train on, in order; the
    length of its formatted string; the number of its examples and their characters.

    A null role reads as empty. Null conv_id is a conversation of its own. An example's loss
    is read from its own text; only the last row's text goes on to be put in order."""
    text = F.col("text")
    reply = unescaped(text.substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = expanded.select(F.col("conv_id").cast("long"), "position",
                           F.when(F.col("loss_start").isNotNull(), reply).alias("reply"),
                           F.length(text).cast("long").alias("chars"), F.when(F.col("is_last"), text).alias("whole"))
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "reply", "chars", "whole").mapInArrow(
        _digested, ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in _DIGESTS.items()))
