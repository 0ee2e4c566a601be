"""Chat formatting: a finite-state machine over roles, a template, loss flags.

The machine checks the order of turns; the template says which marks surround a
turn and whether its text counts for the loss. Control strings inside texts are
escaped with a backslash, so ``read_back`` recovers every turn from the output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, small_batches

START = ""


@dataclass(frozen=True)
class RoleRule:
    head: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, loss flags and allowed turn orders. A role without a rule gets ``other`` marks and breaks the order."""

    roles: dict[str, RoleRule] = field(
        default_factory=lambda: {
            "system": RoleRule("### System: "),
            "user": RoleRule("### User: "),
            "assistant": RoleRule("### Assistant: ", True),
        }
    )
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)
    other: str = "### Role "
    other_end: str = ": "
    end: str = "</turn>\n"

    @property
    def controls(self) -> list[str]:
        return [r.head for r in self.roles.values()] + [self.other, self.end.rstrip("\n")]

    def head(self, role: str) -> str:
        rule = self.roles.get(role)
        return rule.head if rule else f"{self.other}{role.encode('utf-8').hex()}{self.other_end}"


class Codec:
    """Escapes texts for a template, and reads turns back from formatted text."""

    def __init__(self, template: ChatTemplate):
        self.template = template
        names = "|".join(re.escape(c) for c in template.controls)
        self._escape = re.compile(rf"\\|{names}")
        self._plain = re.compile(r"\\(.)", re.S)
        self._head = {r.head: name for name, r in template.roles.items()}
        heads = "|".join(re.escape(h) for h in self._head)
        self._turn = re.compile(
            rf"(?:(?P<head>{heads})|{re.escape(template.other)}(?P<hex>[0-9a-f]*){re.escape(template.other_end)})"
            rf"(?P<text>(?:[^\\<]|\\.|<(?!{re.escape(template.end[1:])}))*+){re.escape(template.end)}",
            re.S,
        )

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\" + m[0] if m[0] != "\\" else "\\\\", text)

    def unescape(self, text: str) -> str:
        return self._plain.sub(r"\1", text)

    def turns(self, formatted: str) -> Iterator[tuple[str, str, int]]:
        """(role, text, where it ends) of each whole turn at the start of ``formatted``."""
        at = 0
        while m := self._turn.match(formatted, at):
            at = m.end()
            role = self._head[m["head"]] if m["head"] else bytes.fromhex(m["hex"]).decode("utf-8")
            yield role, self.unescape(m["text"]), at


SEGMENTS = "conv_id long, turn long, seq long, part int, segment string, loss boolean, valid_so_far boolean, complete boolean"
_PARTS = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("part", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid_so_far", pa.bool_()), ("complete", pa.bool_())]
)
#: Segments of an output batch hold about so many characters.
BATCH_CHARS = 4_000_000


def _formatter(template: ChatTemplate):
    codec = Codec(template)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars, now, state, ok, seq = 0, object(), START, True, 0
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != now:
                    now, state, ok, seq = conv, START, True, 0
                ok = ok and role in template.moves.get(state, ())
                state = role
                rule = template.roles.get(role)
                whole = ok and state in template.final
                for part, (segment, loss) in enumerate(((template.head(role), False), (codec.escape(text), bool(rule and rule.loss)), (template.end, False))):
                    out.append((conv, turn, seq, part, segment, loss, ok, whole))
                    chars += len(segment)
                seq += 1
                if chars > BATCH_CHARS:
                    yield _batch(out)
                    out, chars = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTS.types, strict=True)], schema=_PARTS)


def format_chats(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments of every conversation in order, each with its loss flag.

    ``conversations``: conv_id, turn, role, text; other columns are ignored.
    Turns of one conversation come together sorted, and the machine passes over
    them as a stream: a conversation of any length needs memory for one turn.
    Each turn gives three rows (head, text, end); ``valid_so_far`` tells whether
    the order of turns was allowed up to here, ``complete`` whether it might end here.

    Null texts and roles count as empty. Equal turn numbers are ordered by role,
    then text; null turns come first; null conv_ids form one conversation.
    Repeated rows stay, and usually break the order. An empty table gives no segments.
    """
    template = template or ChatTemplate()
    small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return arrow_map(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), _formatter(template), SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _reader(template: ChatTemplate):
    codec = Codec(template)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d, out = object(), None, []

        def close() -> None:
            if d is not None:
                if d["left"]:
                    raise ValueError(f"conversation {now}: text after the last turn can't be read back")
                out.append((now, d["n"], d["turns"].hexdigest(), d["loss_n"], d["loss"].hexdigest(), d["chars"], d["valid"]))

        for batch in batches:
            for conv, seq, segment, loss, ok, complete in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "segment", "loss", "valid_so_far", "complete")), strict=True):
                if conv != now or d is None:
                    close()
                    if seq != 0:
                        raise ValueError(f"conversation {conv}: its segments don't come together and in order")
                    now, d = conv, {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "valid": False, "left": ""}
                d["chars"] += len(segment)
                d["valid"] = ok and complete
                d["left"] += segment
                if loss:
                    said = codec.unescape(segment)
                    d["loss_n"] += len(said)
                    d["loss"].update(said.encode("utf-8"))
                if segment == template.end:
                    end = 0
                    for role, text, end in codec.turns(d["left"]):
                        d["n"] += 1
                        d["turns"].update(f"{role}\n{text}\n".encode())
                    d["left"] = d["left"][end:]
            if len(out) > 5000:
                yield _digests(out)
                out.clear()
        close()
        if out:
            yield _digests(out)

    return run


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])


def read_back(segments: DataFrame, template: ChatTemplate | None = None, in_order: bool = False) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the output of ``format_chats``.

    Segments may lie anywhere; they are brought together and read as a stream.
    ``in_order`` vouches that they still lie as they were made, which saves the
    shuffle: a conversation that doesn't begin with its first segment then
    raises an error. An empty table gives no digests.
    """
    small_batches(segments.sparkSession)
    if not in_order:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "part")
    return arrow_map(segments, _reader(template or ChatTemplate()), DIGESTS)
