"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back."""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from driftframe.llm.common import small_batches
from driftframe.llm.templates import Template, unescape

#: Turns start with ###, role and colon and end with </turn>; \ # < : of roles and texts are escaped.
TURNS = "{% for m in messages %}### {{ m.role | escape }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %} </turn>\n{% endfor %}"
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*) </turn>\n", re.S)
#: Characters after which an output chunk is closed.
CHUNK = 1 << 16
FORMATTED = "conv_id long, chunk_no long, formatted string, loss array<struct<start:long,end:long>>, is_last boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def format_conversations(turns: DataFrame, source: str = TURNS) -> DataFrame:
    """The formatted conversations of ``turns`` (conv_id, turn, role, text) as chunks (FORMATTED).

    Turns are in the order of turn (null first), then role and text, so that ties have one order;
    repeated rows are turns of their own. Null role or text is empty; a null conv_id is a conversation.
    ``loss`` are the spans between generation markers, in code points from the conversation's start; a
    span that goes on in the next chunk is cut there. Rows are streamed in order, so a conversation of
    any length takes the memory of a turn and a chunk. Other columns are ignored.
    """
    small_batches(turns.sparkSession)
    chosen = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(role, '') role", "coalesce(text, '') text")
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches):
        template = Template(source)
        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))))
        held: list[tuple] = []
        for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in own)
            for chunk in _chunks(conv, template.stream(messages=messages)):
                held.append(chunk)
                if sum(len(c[2]) for c in held) >= CHUNK or len(held) >= 256:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return ordered.mapInArrow(render, FORMATTED)


def _chunks(conv, pieces):
    parts, spans, start, at, k = [], [], 0, 0, 0
    for text, generated in pieces:
        if generated:
            spans.append({"start": at, "end": at + len(text)})
        parts.append(text)
        at += len(text)
        if at - start >= CHUNK:
            yield (conv, k, "".join(parts), spans, False)
            parts, spans, start, k = [], [], at, k + 1
    yield (conv, k, "".join(parts), spans, True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "chunk_no": pa.int64(), "formatted": pa.string(), "loss": pa.list_(_SPAN), "is_last": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


class Reader:
    """Reads a formatted conversation, chunk by chunk, back to turns and the text under the loss mask."""

    def __init__(self, conv):
        self.conv, self.buffer, self.turns, self.chars, self.loss_chars = conv, "", 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, spans: list[dict]) -> list[tuple[str, str]]:
        found = []
        for span in spans:
            text = unescape(formatted[span["start"] - self.chars : span["end"] - self.chars])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        self.buffer, at = self.buffer + formatted, 0
        while m := _TURN.match(self.buffer, at):
            found.append((unescape(m[1]), unescape(m[2])))
            self.said.update(f"{found[-1][0]}\n{found[-1][1]}\n".encode())
            at = m.end()
        self.buffer, self.turns = self.buffer[at:], self.turns + len(found)
        return found

    def digest(self) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {self.conv}: {self.buffer[:40]!r} is no turn")
        return (self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGEST per conversation of ``format_conversations``, from its chunks in the order they come."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in DIGEST.split(", ")]

    def read(batches):
        reader = None
        for b in batches:
            done = []
            for conv, _, text, spans, last in zip(*(c.to_pylist() for c in b.columns)):
                reader = reader or Reader(conv)
                reader.feed(text, spans)
                if last:
                    done.append(reader.digest())
                    reader = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    return formatted.mapInArrow(read, DIGEST)
