"""Chat formatting with typed content parts (operator 4).

A message holds parts in order: text, image, audio, document. A visitor turns
text into escaped text and every other part into a numbered placeholder, and
records the attachment with the number of tokens it will be expanded to. The
formatted conversation is a table with one segment a turn; segments joined in
turn order are the conversation. So formatting needs no shuffle, and a
conversation with very many turns is never put together in one place.

Escaping sets a backslash before every backslash, ``<`` and ``[``; all control
strings and placeholders begin with ``<`` or ``[`` without one, so ``parse``
gives every text back.

Null role and null text are empty; a null part list has no parts. Turns with
equal number stand in the order of their segments, repeated rows included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
KINDS = ("image", "audio", "document")
#: Tokens by kind: (size units of a part for each token).
UNITS = {"image": 784, "audio": 40, "document": 1}
PART = "struct<kind:string,text:string,ref:string,size:bigint>"
BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

_BODY = r"(?:[^\\<\[]|\\.|<(?:image|audio|document) \d+>)*"
_TURN = re.compile(
    rf"<s>\[INST\] (?P<user>{_BODY}) \[/INST\]| (?P<assistant>{_BODY})</s>|<<SYS>>\n(?P<system>{_BODY})\n<</SYS>>\n\n"
    rf"|<<ROLE (?P<role>(?:[^\\<\[>]|\\.)*)>>\n(?P<other>{_BODY})\n<</ROLE>>\n",
    re.S,
)


def escaped(text: Column, also: str = "") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([\\<\[{also}])", r"\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of every turn of joined segments."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        kind = "other" if m["other"] is not None else next(k for k in MARKS if m[k] is not None)
        out.append((unescaped(m["role"]) if kind == "other" else kind, unescaped(m[kind]), m.start(kind), m.end(kind)))
        at = m.end()
    return out


def text_parts(turns: DataFrame) -> DataFrame:
    """Turns with plain ``text`` as turns with one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))
    return turns.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One segment a turn: ``formatted``, the span under the loss mask (assistant turns) in code points, and attachments.

    ``turns``: conv_id, turn, role, parts (array of kind, text, ref, size).
    Attachments: place of the part, kind, ref and expanded token count.
    """
    known = F.col("role").isin(*MARKS)
    role = F.coalesce(F.col("role"), F.lit(""))

    def mark(k: int, other: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, pair in MARKS.items():
            out = out.when(F.col("role") == name, pair[k])
        return out.otherwise(other)

    def visit(part: Column, place: Column) -> Column:
        holder = F.concat(F.lit("<"), part["kind"], F.lit(" "), place.cast("string"), F.lit(">"))
        return F.when(part["kind"].isin(*KINDS), holder).otherwise(escaped(part["text"]))

    def attach(part: Column, place: Column) -> Column:
        units = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), part["kind"])
        tokens = F.when(part["kind"].isin(*KINDS), F.ceil(F.coalesce(part["size"], F.lit(0)) / units))
        return F.struct(place.alias("place"), part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.cast("bigint").alias("tokens"))

    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    found = F.filter(F.transform(parts, attach), lambda a: a["kind"].isin(*KINDS))
    head = mark(0, F.concat(F.lit("<<ROLE "), escaped(role, ">"), F.lit(">>\n")))
    tail = mark(1, F.lit("\n<</ROLE>>\n"))
    out = turns.select("conv_id", "turn", F.array_join(F.transform(parts, visit), "").alias("_body"), head.alias("_head"), tail.alias("_tail"),
                       (known & (F.col("role") == "assistant")).alias("_loss"), found.alias("attachments"))
    start = F.when(F.col("_loss"), F.char_length("_head"))
    return out.select("conv_id", "turn", F.concat("_head", "_body", "_tail").alias("formatted"), start.cast("bigint").alias("loss_start"),
                      (start + F.char_length("_body")).cast("bigint").alias("loss_end"), "attachments")


def read_back(segments: DataFrame) -> DataFrame:
    """Turns and trained text of each conversation, read from its segments as digests.

    Segments stream through sorted tasks with the digest of one conversation
    as the only state, so memory doesn't grow with a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or conv != now:
                    if state is not None:
                        done.append(_told(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if lo is not None:
                    trained = unescaped(text[lo:hi])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(text)
            if done:
                yield _batch(done)
        if state is not None:
            yield _batch([_told(now, state)])

    keyed = segments.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id")
    return keyed.sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, BACK)


def _told(conv: int, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in BACK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
