r"""Chat formatting: conversations rendered by a compiled template, with the model's own text marked.

The template (``template.py``) is compiled once per task into closures.  The
default one writes each turn as ``### role: text</turn>`` and a line feed.
Inside roles and texts the characters that a control string needs are
replaced (``\`` by ``\\``, ``#`` by ``\h``, ``<`` by ``\l``, and in roles
``:`` by ``\c``), so neither mark can occur in a text, and ``read_back``
recovers every turn exactly.

Plan: one exchange by conversation and a sort inside the partitions; the
renderer and the reader are generators over the sorted rows, so a task holds a
turn and one part of output at a time, however long a conversation is.  Turns
of one conversation follow each other in one digest, so one task reads them.

``format_conversations`` returns ``conv_id, part, formatted, loss``: the parts
of about ``PART_CHARS`` code points, cut between turns, and the ranges of
generated text in code points of the whole conversation.

Defined results: a null text or role is empty; a null ``conv_id`` is a
conversation of its own; rows of equal turn are ordered by role and text;
repeated rows are repeated turns; an empty table gives no rows.  Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .template import compile_template

TURN, COLON, END = "### ", ": ", "</turn>\n"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '### ' + m.role|label + ': ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}"
    "{{ '</turn>\n' }}"
    "{% endfor %}"
)
PART_CHARS = 1 << 16
_CODE = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_LABEL = str.maketrans(_CODE | {":": "\\c"})
_TEXT = str.maketrans(_CODE)
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def escape(text: str | None) -> str:
    return (text or "").translate(_TEXT)


def label(role: str | None) -> str:
    return (role or "").translate(_LABEL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            yield dict(zip(names, row))


def _batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded text size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", _LOSS)])
PARTS = "conv_id long, part long, formatted string, loss array<struct<start:long,end:long>>"


def render_parts(pieces: Iterable[tuple[str, bool]], part_chars: int = PART_CHARS) -> Iterator[tuple[str, list[dict]]]:
    """Pieces of a conversation gathered to parts that end with a turn; at least one part."""
    held: list[str] = []
    loss: list[dict] = []
    at = size = 0
    open_at = -1
    any_part = False
    for text, generated in pieces:
        if generated and open_at < 0:
            open_at = at
        elif not generated and open_at >= 0:
            loss.append({"start": open_at, "end": at})
            open_at = -1
        held.append(text)
        at += len(text)
        size += len(text)
        if size >= part_chars and open_at < 0 and text.endswith(END):
            yield "".join(held), loss
            held, loss, size, any_part = [], [], 0, True
    if open_at >= 0:
        loss.append({"start": open_at, "end": at})
    if held or loss or not any_part:
        yield "".join(held), loss


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Rendered parts of every conversation, in order inside each partition."""
    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, {"escape": escape, "label": label})

        def parts() -> Iterator[tuple]:
            for conv_id, rows in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                messages = ({"role": r["role"] or "", "text": r["text"] or ""} for r in rows)
                for k, (text, loss) in enumerate(render_parts(run(messages=messages), part_chars)):
                    yield conv_id, k, text, loss

        yield from _batched(parts(), _PARTS)

    return (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(render, PARTS))


def turns(parts: Iterable[tuple[str, list[dict]]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, generated text, code points) of each turn, read from the formatted parts alone."""
    base = 0
    for formatted, loss in parts:
        spans = iter(loss)
        span = next(spans, None)
        at = 0
        while at < len(formatted):
            colon = formatted.index(COLON, at)
            end = formatted.index(END, colon)
            if not formatted.startswith(TURN, at):
                raise ValueError("no turn starts here")
            generated = ""
            while span is not None and span["end"] - base <= end:
                generated += unescape(formatted[span["start"] - base:span["end"] - base])
                span = next(spans, None)
            yield (unescape(formatted[at + len(TURN):colon]), unescape(formatted[colon + len(COLON):end]), generated,
                   end + len(END) - at)
            at = end + len(END)
        base += len(formatted)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted parts.

    Takes the rows in the order in which ``format_conversations`` returns
    them; parts that were written and read again must first be brought
    together by ``conv_id`` and sorted by ``part``.
    """
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv_id, of in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                said, learnt = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                for role, text, generated, length in turns((r["formatted"], r["loss"]) for r in of):
                    said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    learnt.update(generated.encode("utf-8", "surrogatepass"))
                    n, loss_chars, chars = n + 1, loss_chars + len(generated), chars + length
                yield conv_id, n, said.hexdigest(), loss_chars, learnt.hexdigest(), chars

        yield from _batched(rows(), _DIGEST)

    return parts.mapInArrow(digest, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(given.unionByName(extra)))


def _sql_escaped(text: str, marks: str) -> str:
    """Code points of an escaped text: every mark takes two."""
    return f"(2 * length({text}) - length(regexp_replace({text}, '[{marks}]', '', 'g')))"


ORACLE = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(COLON) + len(END)} + {_sql_escaped('role', '#<:' + chr(92) * 2)} + {_sql_escaped('text', '#<' + chr(92) * 2)})::BIGINT
         AS formatted_chars
FROM given GROUP BY conv_id
"""
