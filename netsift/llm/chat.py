"""Chat formatting from event logs.

A conversation is a log of events ``(conv_id, seq, message, kind, role, text)``:

- ``message`` opens a message, or gives it a new text if it is open;
- ``delta`` appends streamed text to it (and opens it if it is not open);
- ``edit`` replaces its text;
- ``regenerate`` discards its text, later deltas build it anew;
- ``delete`` takes it out.

``fold_events`` folds each message's events in order of ``seq`` into its final
text; a message keeps the place of its first event. ``render`` writes every
message as one segment of the formatted conversation:
``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<|``
becomes ``<\\|`` and every backslash between ``<`` and ``|`` is doubled, so no
text can hold a control string and the escape can be undone exactly.

The work is spread by message, not by conversation: a conversation that holds a
large share of all rows is folded and rendered by many tasks. Reading back in
order (:func:`digest_segments`) streams over the sorted segments and keeps only
running digests.

Edge cases: a null text is empty, a null role is the empty string, unknown or
null kinds count as ``message``; events of equal ``seq`` are ordered by kind and
text; a repeated event of kind ``delta`` appends twice; rows of a null
conversation form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)

EVENT_COLUMNS = ["conv_id", "seq", "message", "kind", "role", "text"]


def escape(text: str) -> str:
    """``<|`` becomes ``<\\|``; any backslashes already there are doubled first."""
    return _OPEN.sub(lambda m: "<" + m[1] * 2 + "\\|", text)


def unescape(text: str) -> str:
    return _OPEN.sub(lambda m: "<" + m[1][: len(m[1]) // 2] + "|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message, first_seq, role, text)``; every other column is left out."""
    conv, seq, message = (events.schema[c].dataType.simpleString() for c in ("conv_id", "seq", "message"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, first, role, parts, alive = None, None, "", [], False
        for frame in frames:
            done: list[tuple] = []
            for conv_id, at, name, kind, who, text in frame[EVENT_COLUMNS].itertuples(index=False, name=None):
                key = (None if pd.isna(conv_id) else conv_id, None if pd.isna(name) else name)
                if current is None or key != current:
                    if current is not None and alive:
                        done.append((*current, first, role, "".join(parts)))
                    current, first, role, parts, alive = key, at, "", [], False
                if kind == "delete":
                    parts, alive = [], False
                    continue
                alive = True
                if who:
                    role = who
                if kind == "regenerate":
                    parts = []
                elif kind == "delta":
                    parts.append(text or "")
                else:
                    parts = [text or ""]
            yield pd.DataFrame(done, columns=["conv_id", "message", "first_seq", "role", "text"])
        if current is not None and alive:
            yield pd.DataFrame([(*current, first, role, "".join(parts))], columns=["conv_id", "message", "first_seq", "role", "text"])

    return (
        bound_batches(events).select(*EVENT_COLUMNS)
        .repartition("conv_id", "message")
        .sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
        .mapInPandas(run, f"conv_id {conv}, message {message}, first_seq {seq}, role string, text string")
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One segment per message, with the span ``[loss_start, loss_end)`` of its code points under the loss mask (else null)."""
    conv = messages.schema["conv_id"].dataType.simpleString()
    seq, message = (messages.schema[c].dataType.simpleString() for c in ("first_seq", "message"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            role, text = frame["role"].map(escape_role), frame["text"].map(escape)
            head = START + role + "\n"
            trained = frame["role"] == trained_role
            begin = head.str.len().where(trained)
            yield pd.DataFrame(
                {
                    "conv_id": frame["conv_id"],
                    "message": frame["message"],
                    "first_seq": frame["first_seq"],
                    "segment": head + text + END + "\n",
                    "loss_start": begin.astype("Int64"),
                    "loss_end": (begin + text.str.len()).astype("Int64"),
                }
            )

    return messages.select("conv_id", "message", "first_seq", "role", "text").mapInPandas(
        run, f"conv_id {conv}, message {message}, first_seq {seq}, segment string, loss_start long, loss_end long"
    )


def format_conversations(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Segments of the formatted conversations; a conversation is the concatenation of its segments by ``(first_seq, message)``."""
    return render(fold_events(events), trained_role)


def digest_segments(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: turns, text under the loss mask and their digests, per conversation."""
    conv = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, started = None, False
        n = loss = chars = 0
        turns = masked = None
        for frame in frames:
            done: list[tuple] = []
            for conv_id, segment, begin, end in frame[["conv_id", "segment", "loss_start", "loss_end"]].itertuples(index=False, name=None):
                key = None if pd.isna(conv_id) else int(conv_id) if conv in ("bigint", "int") else conv_id
                if not started or key != current:
                    if started:
                        done.append((current, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                    current, started = key, True
                    n = loss = chars = 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                found = _SEGMENT.fullmatch(segment)
                role, text = unescape_role(found[1]), unescape(found[2])
                turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if not pd.isna(begin):
                    said = unescape(segment[int(begin) : int(end)])
                    masked.update(said.encode("utf-8", "replace"))
                    loss += len(said)
                n += 1
                chars += len(segment)
            yield pd.DataFrame(done, columns=names)
        if started:
            yield pd.DataFrame([(current, n, turns.hexdigest(), loss, masked.hexdigest(), chars)], columns=names)

    return (
        segments.repartition("conv_id")
        .sortWithinPartitions("conv_id", "first_seq", "message")
        .select("conv_id", "segment", "loss_start", "loss_end")
        .mapInPandas(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as an event log. Assistant texts arrive as a generation that is
    discarded and then streamed anew in two deltas, so that the fold has work to do; the others as messages.

    Rows that share conversation and turn stay separate messages, ordered by role and text; equal rows are told apart by
    counting them first.
    """
    text = F.coalesce("text", F.lit(""))
    rows = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
        .withColumn("copy", F.monotonically_increasing_id())
        .withColumn("message", F.concat_ws(":", F.format_string("%020d", F.coalesce(F.col("turn").cast("long"), F.lit(0)) + F.lit(1 << 40)), "role", F.sha2("text", 256), F.format_string("%020d", "copy")))
    )
    half = (F.length("text") / 2).cast("int")
    streamed = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("delta").alias("kind"), F.substring("text", 1, 8).alias("part")),
        F.struct(F.lit(1).alias("step"), F.lit("regenerate").alias("kind"), F.lit("").alias("part")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.col("text").substr(F.lit(1), half).alias("part")),
        F.struct(F.lit(3).alias("step"), F.lit("delta").alias("kind"), F.col("text").substr(half + 1, F.length("text")).alias("part")),
    )
    whole = F.array(F.struct(F.lit(0).alias("step"), F.lit("message").alias("kind"), F.col("text").alias("part")))
    return rows.withColumn("event", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(whole))).select(
        "conv_id", (F.coalesce(F.col("turn").cast("long"), F.lit(0)) * 4 + F.col("event.step")).alias("seq"), "message", F.col("event.kind").alias("kind"), "role", F.col("event.part").alias("text")
    )
