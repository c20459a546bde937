"""Chat formatting with a grammar that is parsed back before anything is given out.

A conversation is its turns in order, each ``<|turn|>role<|says|>text<|end|>`` and a line break. The parser reads one
control string after another from the left, and undoes escapes in what lies between. ``render`` writes a turn plainly,
parses it and compares it with the source; where they differ, or a control string of another template (``FOREIGN``) stands
in the content, the content is escaped and parsed again. Each whole segment is parsed and compared once more.

Escaping adds a back slash after the first character of a control string, also of one that is broken already (``<|end|>``,
``<\\|end|>``, ...). So undoing it needs no table, and a text that merely looks escaped comes back as it was.

The result comes in segments of bounded size, in order; a conversation of any length streams through its task and is never
held whole. Null text and null role are empty; the rows without a conversation id are one conversation. Turns sort by
number (null first), then role and text, so ties and repeated rows have one order. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = (TURN, SAYS, END)
# Control strings of common templates.
FOREIGN = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
TRAINED = ("assistant",)  # roles whose texts are under the loss mask
SEGMENT_TURNS, SEGMENT_CHARS = 256, 4_000_000

_ANY = re.compile("|".join(map(re.escape, CONTROL + FOREIGN)))
#: Control strings, also with back slashes after the first character.
BROKEN = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL + FOREIGN)
_BROKEN = re.compile(BROKEN)

SEGMENTS = "segment int, formatted string, loss array<struct<start:int,end:int>>"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(content: str) -> str:
    return _BROKEN.sub(lambda m: m[0][0] + "\\" + m[0][1:], content)


def unescape(content: str) -> str:
    return _BROKEN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], content)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns (role, text); None if the text isn't in the grammar."""
    turns, at, role = [], 0, ""
    expected, begun = TURN, 0
    for m in _ANY.finditer(formatted):
        if m[0] != expected or (expected == TURN and m.start() != at):
            return None
        if expected == SAYS:
            role = unescape(formatted[begun : m.start()])
        elif expected == END:
            turns.append((role, unescape(formatted[begun : m.start()])))
            at = m.end() + 1
            if formatted[m.end() : at] != "\n":
                return None
        begun = m.end()
        expected = {TURN: SAYS, SAYS: END, END: TURN}[expected]
    return turns if expected == TURN and at == len(formatted) else None


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text starts and ends in it; escaped only if it doesn't parse back plainly."""
    for way in (str, escape):
        head = f"{TURN}{way(role)}{SAYS}"
        body = way(text)
        out = f"{head}{body}{END}\n"
        if parse(out) == [(role, text)]:
            return out, len(head), len(head) + len(body)
    raise ValueError(f"a turn doesn't parse back: {role!r}, {text[:200]!r}")


def formatted(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of each conversation in order: ``id, segment, formatted`` and the character spans under the loss mask."""
    rows = turns.select(F.col(id).alias("c"), F.col(turn).alias("t"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(n) for x, n in ((role, "r"), (text, "x"))])
    rows = rows.repartition("c").sortWithinPartitions(F.asc_nulls_first("c"), F.asc_nulls_first("t"), "r", "x").drop("t")
    kind = turns.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        conversation, segment, size = None, 0, 0

        def flush() -> pa.RecordBatch:
            parts, spans, at = [], [], 0
            for who, says in held:
                one, start, end = render(who, says)
                if who in TRAINED:
                    spans.append({"start": at + start, "end": at + end})
                parts.append(one)
                at += len(one)
            whole = "".join(parts)
            if parse(whole) != held:
                raise ValueError(f"conversation {conversation} doesn't parse back")
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([conversation], own), pa.array([segment], pa.int32()), pa.array([whole], pa.string()), pa.array([spans], span)], names=[id, "segment", "formatted", "loss"])

        for batch in batches:
            own = batch.column(0).type
            for c, who, says in zip(*(x.to_pylist() for x in batch.columns)):
                if held and (c != conversation or len(held) == SEGMENT_TURNS or size >= SEGMENT_CHARS):
                    yield flush()
                    segment = segment + 1 if c == conversation else 0
                    held, size = [], 0
                conversation = c
                held.append((who, says))
                size += len(says)
        if held:
            yield flush()

    return rows.mapInArrow(run, f"`{id}` {kind}, {SEGMENTS}")


def read_back(segments: DataFrame, id: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Per conversation, from the formatted text alone: turns, their digest, and length and digest of what is under the
    mask. ``in_order``: the segments come straight from ``formatted``, so they needn't be sorted again."""
    rows = segments.select(F.col(id), "segment", "formatted", "loss")
    if not in_order:
        rows = rows.repartition(id).sortWithinPartitions(F.asc_nulls_first(id), "segment")
    kind = segments.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, any_yet = None, False
        n = chars = length = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def flush() -> pa.RecordBatch:
            values = [n, turns.hexdigest(), chars, loss.hexdigest(), length]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([conversation], own), *[pa.array([v]) for v in values]], names=[id, *names])

        for batch in batches:
            own = batch.column(0).type
            for c, segment, text, spans in zip(*(x.to_pylist() for x in batch.columns)):
                if segment == 0:
                    if any_yet:
                        yield flush()
                    conversation, any_yet = c, True
                    n = chars = length = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for who, says in parse(text):
                    turns.update(f"{who}\n{says}\n".encode())
                    n += 1
                for span in spans:
                    under = unescape(text[span["start"] : span["end"]])
                    loss.update(under.encode())
                    chars += len(under)
                length += len(text)
        if any_yet:
            yield flush()

    return rows.mapInArrow(run, f"`{id}` {kind}, {DIGESTS}")
