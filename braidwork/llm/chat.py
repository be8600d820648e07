"""Chat formatting by event-sourced reconstruction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template, fixed values: what opens and closes a turn of each role; other roles are named in their mark.
OPENS = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSES = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<<ROLE ", ">>", "<</ROLE>>"
#: Escapes inside texts and role names, fixed values. No control string is left, since each has one of the first two.
ESCAPES = {"<": "\\l", "[": "\\b", ">": "\\g", "\\": "\\\\"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b").replace(">", "\\g")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    back = {v[1]: k for k, v in ESCAPES.items()}
    parts, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        parts += [text[at:i], back[text[i + 1]]]
        at = i + 2
    return "".join(parts) + text[at:]


class Conversation:
    """The state that a conversation's events are folded into: messages in order, each a role and pieces of text.

    open: a new message of this role, with its first text. delta: more text at the end of the last message, or
    of message number `target`. edit: the text of message `target`, or else of the last one, is replaced and what
    came after it is dropped, since it answered something else. regenerate: message `target` (or else the last one of the
    assistant) loses its text, and what came after it is dropped; deltas or an open follow. An event of no
    known kind, or whose target isn't there, changes nothing; a delta with no message opens one of its role.
    """

    def __init__(self, key):
        self.key, self.messages = key, []

    def fold(self, kind: str, target, role: str, text: str) -> None:
        known = target is not None and 0 <= target < len(self.messages)
        if kind == "open" or kind == "delta" and target is None and not self.messages:
            self.messages.append([role, [text]])
        elif kind == "delta" and (known or target is None):
            self.messages[target if known else -1][1].append(text)
        elif kind == "edit" and (known or target is None and self.messages):
            target = target if known else len(self.messages) - 1
            del self.messages[target + 1 :]
            self.messages[target][1] = [text]
        elif kind == "regenerate":
            if target is None:
                target = next((i for i in range(len(self.messages) - 1, -1, -1) if self.messages[i][0] == "assistant"), None)
            if target is not None and 0 <= target < len(self.messages):
                del self.messages[target + 1 :]
                self.messages[target][1] = []

    def rendered(self) -> tuple[str, list[list[int]]]:
        """The formatted text, and the spans of the assistant's texts in it: what the loss is taken on."""
        out, at, spans = [], 0, []
        for role, pieces in self.messages:
            body = escape("".join(pieces))
            opened = OPENS.get(role, f"{OTHER_OPEN}{escape(role)}{OTHER_MID}")
            if role == "assistant":
                spans.append([at + len(opened), at + len(opened) + len(body)])
            turn = opened + body + CLOSES.get(role, OTHER_CLOSE)
            out.append(turn)
            at += len(turn)
        return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: the inverse of rendering."""
    turns, at = [], 0
    while at < len(formatted):
        role = next((r for r, mark in OPENS.items() if formatted.startswith(mark, at)), None)
        if role is not None:
            low = at + len(OPENS[role])
        else:
            if not formatted.startswith(OTHER_OPEN, at):
                raise ValueError(f"no turn opens at {at}")
            mid = formatted.index(OTHER_MID, at)
            role, low = unescape(formatted[at + len(OTHER_OPEN) : mid]), mid + len(OTHER_MID)
        close = CLOSES.get(role, OTHER_CLOSE)
        high = formatted.index(close, low)
        turns.append((role, unescape(formatted[low:high])))
        at = high + len(close)
    return turns


def format_events(events: DataFrame, order: list[str]) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of [begin, end) in characters).

    events: conv_id, kind, target, role, text and the columns of `order`, which say their sequence (nulls
    first; events alike in all columns may change places). Null text counts as empty, null role as `user`,
    null kind as `open`. Null conv_ids form one conversation. An empty table gives no row; other columns are
    ignored.

    Events are partitioned by conversation and sorted by sequence, and each task folds its sorted rows as they
    stream by, so it holds the texts of one conversation at a time. A conversation is one string in the end,
    hence its text is the least a task must hold.
    """
    id_type = events.schema["conv_id"].dataType.simpleString()
    rows = events.select("conv_id", F.coalesce("kind", F.lit("open")).alias("kind"), F.col("target").cast("long").alias("target"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    places = [f"_o{i}" for i in range(len(order))]
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *places, "kind", "role", "text").select("conv_id", "kind", "target", "role", "text")

    def fold(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, done, held = None, [], 0
        for frame in frames:
            for key, kind, target, role, text in zip(*(frame[c].astype(object) for c in frame.columns), strict=True):
                key = None if pd.isna(key) else key
                if current is None or key != current.key:
                    if current is not None:
                        done.append((current.key, *current.rendered()))
                        held += len(done[-1][1])
                    current = Conversation(key)
                    if held > 8_000_000 or len(done) > 5000:
                        yield out_frame(done)
                        done, held = [], 0
                current.fold(kind, None if pd.isna(target) else int(target), role, text)
        if current is not None:
            done.append((current.key, *current.rendered()))
        if done:
            yield out_frame(done)

    def out_frame(done: list) -> pd.DataFrame:
        frame = pd.DataFrame(done, columns=["conv_id", "formatted", "loss_spans"])
        return frame if id_type == "string" else frame.astype({"conv_id": "Int64"})

    return sorted_rows.mapInPandas(fold, f"conv_id {id_type}, formatted string, loss_spans array<array<long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the formatted text and its mask."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def read(frames):
        for frame in frames:
            out = []
            for text, spans in zip(frame["formatted"], frame["loss_spans"], strict=True):
                turns = parse(text)
                whole = hashlib.sha256()
                for role, body in turns:
                    whole.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                out.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            made = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            made.insert(0, "conv_id", frame["conv_id"].to_numpy() if id_type == "string" else frame["conv_id"].astype("Int64"))
            yield made

    return formatted.mapInPandas(read, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The columns that say the sequence of what `conversation_events` makes.
SEQUENCE = ["turn", "row_role", "row_head", "row_hash", "row", "step"]


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Each row of the table as the events of a stream that ends in its message.

    An assistant's message is opened empty, gets a draft in a delta, is regenerated, and then comes in two
    deltas. Any other is opened with a draft, edited to its first half, and completed by a delta. SEQUENCE orders
    the events; rows of one turn go by role and text. Rows alike in all of that are as many messages, one behind
    the other: a number of the row keeps the events of each together, and it doesn't matter which comes first.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("user"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def event(step: int, kind: str, said) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("said"))

    none, draft = F.lit(""), F.reverse(first)
    talk = F.array(event(0, "open", none), event(1, "delta", draft), event(2, "regenerate", none), event(3, "delta", first), event(4, "delta", second))
    other = F.array(event(0, "open", draft), event(1, "edit", first), event(2, "delta", second))
    of_row = F.when(F.col("role") == "assistant", talk).otherwise(other)
    made = rows.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("row_head"), F.xxhash64("text").alias("row_hash"), F.monotonically_increasing_id().alias("row"), F.explode(of_row).alias("e"))
    return made.select("conv_id", "turn", F.col("role").alias("row_role"), "row_head", "row_hash", "row", "e.step", "e.kind", F.lit(None).cast("long").alias("target"), "role", F.col("e.said").alias("text"))
