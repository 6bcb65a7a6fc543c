"""Chat formatting from an event log.

A conversation is stored as events: a turn is opened, its text arrives in deltas,
it may be edited, or thrown away and generated anew. The log is partitioned by
conversation and turn, sorted by sequence and folded into final messages, which
are rendered with a template that can be read back exactly. Folding by turn keeps
a conversation that owns much of the log spread over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<s>[INST] ", "\n", " [/INST]</s>\n"
# Control strings of common templates; a backslash after the first character disarms them.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
EVENTS = "conv_id bigint, turn bigint, message bigint, seq bigint, kind string, role string, body string"


def escaped(text: Column) -> Column:
    """Backslashes doubled, control strings disarmed."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        text = F.replace(text, F.lit(word), F.lit(f"{word[0]}\\{word[1:]}"))
    return text


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescaped_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def events_of(rows: DataFrame, delta_chars: int = 256) -> DataFrame:
    """An event log of stored turns: every row is opened and its text arrives in deltas.

    Each row is a message of its own, also where rows share a turn or are repeated.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.groupBy("conv_id", "turn", "role", "body").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = rows.withColumn("message", F.xxhash64("role", "body", "copy"))
    pieces = F.sequence(F.lit(0), F.ceil(F.char_length("body") / delta_chars).cast("bigint"))
    steps = rows.select("conv_id", "turn", "message", "role", "body", F.explode(pieces).alias("seq"))
    opens = F.col("seq") == 0
    at = ((F.col("seq") - 1) * delta_chars + 1).cast("int")
    return steps.select(
        "conv_id",
        "turn",
        "message",
        "seq",
        F.when(opens, "open").otherwise("delta").alias("kind"),
        F.when(opens, F.col("role")).alias("role"),
        F.when(~opens, F.substring("body", at, F.lit(delta_chars))).otherwise("").alias("body"),
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final state of every message.

    ``open`` starts a message and names its role, ``delta`` appends, ``edit``
    replaces all text so far, ``regenerate`` empties it (and may name a new role),
    ``delete`` removes the message if it comes last. Events take effect by ``seq``,
    those with the same seq by kind and body. Redelivered events count once. Null
    bodies are empty; a message that was never opened has an empty role.
    """
    keys = ["conv_id", "turn", "message"]
    step = F.struct("seq", "kind", F.coalesce("body", F.lit("")).alias("body"), "role")
    grouped = events.distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    # What counts begins at the last event that replaces the text.
    resets = F.expr("array_max(transform(filter(steps, e -> e.kind in ('edit', 'regenerate', 'open')), e -> e.seq))")
    kept = grouped.select(
        *keys,
        "steps",
        F.coalesce(resets, F.expr("steps[0].seq")).alias("last"),
        F.expr("filter(steps, e -> e.role is not null and e.kind in ('open', 'regenerate'))").alias("named"),
    ).filter("steps[size(steps) - 1].kind != 'delete'")
    text = "array_join(transform(filter(steps, e -> e.seq >= last and e.kind in ('delta', 'edit')), e -> e.body), '')"
    return kept.select(
        *keys, F.coalesce(F.expr("try_element_at(named, -1).role"), F.lit("")).alias("role"), F.expr(text).alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation as one string, turns in order.

    ``loss`` holds the (start, end) code points of the assistant's texts. Turns
    with a null number come first; messages of one turn by their rendered text.
    """
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(MID))
    parts = messages.select(
        "conv_id",
        F.struct(
            "turn",
            F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("piece"),
            F.char_length(head).cast("bigint").alias("head"),
            (F.col("role") == "assistant").alias("loss"),
        ).alias("part"),
    )
    size = F.char_length("part.piece").cast("bigint")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(before), F.lit(0))
    span = F.struct((at + F.col("part.head")).alias("start"), (at + size - len(CLOSE)).alias("end"))
    return (
        parts.withColumn("span", F.when(F.col("part.loss"), span))
        .groupBy("conv_id")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["piece"]), "").alias("formatted"),
            F.array_sort(F.collect_list("span")).alias("loss"),
        )
    )


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("not a rendered conversation")
        mid = formatted.index(MID, at + len(OPEN))
        end = formatted.index(CLOSE, mid)
        out.append((unescaped_role(formatted[at + len(OPEN) : mid]), unescaped(formatted[mid + 1 : end]), mid + 1, end))
        at = end + len(CLOSE)
    return out


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, read back from the strings and loss spans."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for conv, formatted, loss in zip(*(column.to_pylist() for column in batch.columns)):
                turns, masked = hashlib.sha256(), hashlib.sha256()
                read_turns = read_back(formatted)
                for role, text, _, _ in read_turns:
                    turns.update(f"{role}\n{text}\n".encode())
                chars = 0
                for span in loss:
                    text = unescaped(formatted[span["start"] : span["end"]])
                    chars += len(text)
                    masked.update(text.encode())
                rows.append((conv, len(read_turns), turns.hexdigest(), chars, masked.hexdigest(), len(formatted)))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rendered.select("conv_id", "formatted", "loss").mapInArrow(read, DIGEST)
