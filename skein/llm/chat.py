r"""Chat formatting by event-sourced reconstruction.

A log holds one event per row: ``conv_id, seq, message, kind, role, text``. Kinds: ``open``
begins a message of a role, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate``
empties it for new deltas, ``drop`` removes it. The log is partitioned by conversation, sorted by
``seq`` and folded into final messages, which are then rendered.

Template: ``### role: text</turn>`` and a line feed per message. In roles and texts a backslash
is put before every backslash, ``###`` and ``</turn>``, and in roles before ``:``, so the output
reads back exactly. The loss mask covers the escaped texts of assistant messages.

Defined cases: a null text is empty, a null role is the empty role; events of a message that was
never opened open it with their role; equal ``seq`` are taken by message, kind, role, text; an
event of an unknown kind has no effect; rows of a table that repeat are turns of their own;
events without conv_id are one conversation without one; very long texts are taken whole; other
columns, whatever their names, are ignored; an empty log gives an empty result. One conversation
is one string in the output, so one task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import ids

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
EVENT = "seq long, message long, kind string, role string, text string"
RENDERED = f"{ids.SCHEMA}, formatted string, mask array<struct<start:long,end:long>>"
DIGEST = f"{ids.SCHEMA}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: An escaped thing, or what ends a role or a text.
_NEXT_COLON = re.compile(r"\\(?:\\|###|</turn>|:)|: ")
_NEXT_TAIL = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def fold(events: Iterable[tuple]) -> list[tuple[str, str]]:
    """(role, text) of the messages that remain, in the order they were opened."""
    open_: dict[int, list] = {}
    for _, message, kind, role, text in events:
        if kind in ("open", "delta", "edit", "regenerate"):
            one = open_.setdefault(message, [role or "", []])
            if kind == "delta":
                one[1].append(text or "")
            elif kind == "edit":
                one[1] = [text or ""]
            elif kind == "regenerate":
                one[1] = []
        elif kind == "drop":
            open_.pop(message, None)
    return [(role, "".join(parts)) for role, parts in open_.values()]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask, in code points."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head = HEAD + escape(role).replace(":", "\\:") + COLON
        body = escape(text)
        out += [head, body, TAIL]
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), mask


def _until(pattern: re.Pattern, text: str, at: int) -> re.Match:
    for m in pattern.finditer(text, at):
        if m[0][0] != "\\":
            return m
    raise ValueError("the conversation breaks off")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    found, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        colon = _until(_NEXT_COLON, formatted, at + len(HEAD))
        tail = _until(_NEXT_TAIL, formatted, colon.end())
        found.append((unescape(formatted[at + len(HEAD) : colon.start()]), unescape(formatted[colon.end() : tail.start()])))
        at = tail.end()
    return found


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log it would have been streamed as.

    Messages take four histories in turn: streamed in two deltas; a draft that is regenerated;
    a draft that is edited; streamed, with a message between that is dropped.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit("")).alias("text")
    df = conversations.select("conv_id", "turn", "role", text).withColumn("message", F.row_number().over(order).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substr("text", F.lit(1), half), F.substr(F.col("text"), half + 1, F.length("text"))
    none, own, other = F.lit(None).cast("string"), F.col("message"), -F.col("message")
    streamed = [("open", own, none), ("delta", own, first), ("delta", own, rest)]
    histories = (
        streamed,
        [("open", own, none), ("delta", own, rest), ("regenerate", own, none), *streamed[1:]],
        [("open", own, none), ("delta", own, first), ("edit", own, F.col("text"))],
        [streamed[0], ("open", other, none), streamed[1], ("delta", other, rest), ("drop", other, none), streamed[2]],
    )
    longest = max(map(len, histories))

    def events(history: list) -> Column:
        made = [F.struct((own * longest + i).alias("seq"), message.alias("message"), F.lit(kind).alias("kind"), part.alias("text")) for i, (kind, message, part) in enumerate(history)]
        return F.array(*made)

    chosen = events(histories[0])
    for k, history in enumerate(histories[1:], 1):
        chosen = F.when(F.pmod(own, F.lit(len(histories))) == k, events(history)).otherwise(chosen)
    return df.select("conv_id", "role", F.explode(chosen).alias("e")).select("conv_id", "e.seq", "e.message", "e.kind", "role", "e.text")


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [render(fold((e["seq"], e["message"], e["kind"], e["role"], e["text"]) for e in events)) for events in batch["events"]]
        masks = [[{"start": a, "end": b} for a, b in m] for _, m in made]
        yield batch[["missing", "id"]].assign(formatted=[f for f, _ in made], mask=masks)


def format_log(log: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``mask`` per conversation of a log."""
    event = F.struct("seq", "message", "kind", "role", "text")
    each = log.groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("events")).select(*ids.apart("conv_id"), "events")
    return each.mapInPandas(_rendered, RENDERED).select(ids.together("conv_id"), "formatted", "mask")


@dataclass(frozen=True)
class _Digest:
    """Reads formatted conversations back."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in batches:
            rows = zip(*(batch[c].tolist() for c in ("missing", "id", "formatted", "mask")), strict=True)
            yield pd.DataFrame([(missing, conv_id, *self.row(formatted, mask)) for missing, conv_id, formatted, mask in rows], columns=names)

    @staticmethod
    def row(formatted, mask) -> tuple:
        turns = parse(formatted)
        loss = "".join(unescape(formatted[m["start"] : m["end"]]) for m in mask)
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)


def report(rendered: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from them."""
    made = rendered.select(*ids.apart("conv_id"), "formatted", "mask").mapInPandas(_Digest(), DIGEST)
    return made.select(ids.together("conv_id"), *(c for c in made.columns if c not in ("missing", "id")))


def probe(conversations: DataFrame) -> DataFrame:
    """The table with conversation -7, whose texts hold the template's own control strings."""
    spark = conversations.sparkSession
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
