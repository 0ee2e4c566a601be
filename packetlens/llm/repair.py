"""Conversation structure repair: the cheapest edits that give every conversation a lawful order of roles.

The grammar of roles is a small automaton. For each turn and state a backward
pass finds the least cost to go; a forward walk then takes, among the edits
whose cost equals the cost to go, the one whose initial is least in ASCII. In
every state an edit leads to one state only, so the walk needs no search.

A conversation of any length is cut into blocks of BLOCK entries. A block's
cost from each state to each state is a small matrix; the matrices of a
conversation, combined from its end, give every block the costs to go behind
it, and the states in which the blocks are entered follow from the walks of
each. So blocks are solved side by side, and only the digest reads a
conversation in one stream. Rows that are equal in turn, role and text are one
entry with a number: all but the first of them must go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, small_batches, written

#: Entries of a block.
BLOCK = 4096
#: Texts of an output batch hold about so many characters.
BATCH_CHARS = 4_000_000

#: White space, the marks that end a text, what edits cost, and what a truncated turn costs unless it goes.
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LAWFUL = ("su", "ua", "au")

#: Faults of a turn; the first two must go.
NONE, BLANK, DUPLICATE, CUT = range(4)

# States: nothing yet, after the system turn, after a user turn, after an assistant turn. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60


def options(code: int) -> list[list[tuple[str, int, int]]]:
    """By state the edits of a turn that use it up, as (initial, cost, state behind), in ASCII order. ``code``: 4 * class of the role's initial + fault."""
    initial, fault = divmod(code, 4)
    out = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            to = {0: SYSTEM if state == START else None, 1: USER if state != USER else None, 2: ASSISTANT if state == USER else None}.get(initial)
            if to is not None:
                own.append(("K", more, to))
            own.append(("R", RETITLE + more, NEXT[state]))
        out.append(own)
    return out


OPTIONS = [options(code) for code in range(16)]


def _matrices() -> np.ndarray:
    """For each code the least cost from state to state over inserts and the edit of one turn."""
    between = np.full((4, 4), FAR)
    for s in range(4):
        between[s, s] = 0
        between[s, NEXT[s]] = INSERT
        if NEXT[NEXT[s]] != s:
            between[s, NEXT[NEXT[s]]] = 2 * INSERT
    out = np.full((16, 4, 4), FAR)
    for code, by_state in enumerate(OPTIONS):
        edit = np.full((4, 4), FAR)
        for s, own in enumerate(by_state):
            for _, cost, to in own:
                edit[s, to] = min(edit[s, to], cost)
        out[code] = (between[:, :, None] + edit[None, :, :]).min(1)
    return out


MATRICES = _matrices()


def to_go(codes: list[int], counts: list[int], end: list[int]) -> list[tuple[int, ...]]:
    """Costs to go by state before each entry, and ``end`` behind the last one."""
    f = tuple(end)
    out = [f]
    for code, n in zip(reversed(codes), reversed(counts), strict=True):
        more = DELETE * (n - 1)
        g = [min(cost + f[to] for _, cost, to in own) + more for own in OPTIONS[code]]
        user, assistant = min(g[USER], INSERT + g[ASSISTANT]), min(g[ASSISTANT], INSERT + g[USER])
        f = (min(g[START], INSERT + user), min(g[SYSTEM], INSERT + user), user, assistant)
        out.append(f)
    return out[::-1]


def walk(codes: list[int], counts: list[int], costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """Initials of the edits from ``state`` on, each the least in ASCII of those that keep to the costs to go, and the state behind."""
    audit = []
    for i, (code, n) in enumerate(zip(codes, counts, strict=True)):
        again = DELETE * (n - 1)
        while True:
            left, behind = costs[i][state], costs[i + 1]
            tight = [(letter, to) for letter, cost, to in OPTIONS[code][state] if cost + again + behind[to] == left]
            if tight and tight[0][0] == "D" or INSERT + costs[i][NEXT[state]] != left:
                audit.append(tight[0][0] + "D" * (n - 1))
                state = tight[0][1]
                break
            audit.append("I")
            state = NEXT[state]
    while last and state not in (START, ASSISTANT):
        audit.append("I")
        state = NEXT[state]
    return "".join(audit), state


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_ENTRY = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("pos", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("code", pa.int32()), ("n", pa.int64()), ("digest", pa.binary())])
ENTRY = "conv_id long, block long, pos int, turn long, role string, text string, code int, n long, digest binary"


def _dealer(size: int):
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pos, now, held, n, out, chars = TaskContext.get().partitionId() << 32, -1, object(), None, 0, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, turn, role, text, code, digest = row
                if held and (conv, turn, role, digest) == (held[0], held[3], held[4], held[8]):
                    n += 1
                    continue
                if held:
                    out.append((*held[:7], n, held[8]))
                    chars += len(held[5])
                if chars > BATCH_CHARS or len(out) > 10_000:
                    yield _batch(out, _ENTRY)
                    out, chars = [], 0
                pos += 1
                if conv != now or pos == size:
                    block, pos, now = block + 1, 0, conv
                held, n = (conv, block, pos, turn, role, text, code, 1, digest), 1
        if held:
            yield _batch([*out, (*held[:7], n, held[8])], _ENTRY)

    return deal


def entries(turns: DataFrame) -> DataFrame:
    """The turns in order, dealt into blocks: equal rows once with their number, the class of the role's initial and the faults of the text itself.

    Ranges of conversations, turns and roles share out the sorted rows, so a
    conversation may span any number of tasks. The table is written, since
    blocks are numbered by it.
    """
    small_batches(turns.sparkSession)
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    inked = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(inked == "", BLANK).when(F.right(inked, F.lit(1)).isin(*ENDS), NONE).otherwise(CUT)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    rows = rows.withColumn("code", (4 * initial + fault).cast("int")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(arrow_map(rows, _dealer(BLOCK), ENTRY), "turns")


def _costs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's matrix, all blocks of a batch at once: a step takes one more entry from each block's end."""
    for batch in batches:
        column = batch.column(2)
        codes, first = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        n = batch.column(3).flatten().to_numpy()
        sizes = np.diff(first)
        m = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(sizes), 1, 1))
        for back in range(1, int(sizes.max(initial=0)) + 1):
            own = np.flatnonzero(sizes >= back)
            at = first[own + 1] - back
            m[own] = np.minimum((MATRICES[codes[at]][:, :, :, None] + m[own][:, None, :, :]).min(2) + DELETE * (n[at] - 1)[:, None, None], FAR)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(m.reshape(-1, 16)), pa.list_(pa.int64()))], names=["conv_id", "block", "m"])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go behind each block of a conversation, from its last block on."""
    for batch in batches:
        out = []
        for blocks in batch.column(0).to_pylist():
            f = np.array(FINAL)
            for i, x in reversed(list(enumerate(blocks))):
                out.append((x["block"], f.tolist(), i == 0, i == len(blocks) - 1))
                f = (np.array(x["m"]).reshape(4, 4) + f).min(1)
                f = np.minimum(f, INSERT + f[list(NEXT)])
                f[[START, SYSTEM]] = np.minimum(f[[START, SYSTEM]], INSERT + f[USER])
        if out:
            yield _batch(out, pa.schema([("block", pa.int64()), ("end", pa.list_(pa.int64())), ("opens", pa.bool_()), ("closes", pa.bool_())]))


_WALK = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("audits", pa.list_(pa.string())), ("behind", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64()))]
    + [(x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.int32()), ("last", pa.int32())]
)
WALK = "conv_id long, block long, audits array<string>, behind array<int>, costs array<long>, blank long, duplicate long, truncated long, illegal long, first int, last int"


def lawful(a: int, b: int) -> bool:
    """Whether classes of initials may stand side by side."""
    return "sua?"[a] + "sua?"[b] in LAWFUL


def _walks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's walk from every state in which it may be entered, and what its turns lack."""
    for batch in batches:
        out, chars = [], 0
        for i in range(batch.num_rows):  # a block at a time: its lists are long
            conv, block, codes, counts, end, opens, closes = (c[i].as_py() for c in batch.columns)
            costs = to_go(codes, counts, end)
            found = [walk(codes, counts, costs, s, closes) if s == START or not opens else ("", 0) for s in range(4)]
            kinds, faults = [c // 4 for c in codes], [0, 0, 0, 0]
            illegal = sum(not lawful(a, b) for a, b in zip(kinds, kinds[1:], strict=False))
            for c, n in zip(codes, counts, strict=True):
                faults[c % 4] += n if c % 4 in (BLANK, DUPLICATE) else 1
                faults[DUPLICATE] += 0 if c % 4 in (BLANK, DUPLICATE) else n - 1
                illegal += n - 1
            out.append((conv, block, [a for a, _ in found], [s for _, s in found], list(costs[0]), faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, kinds[0], kinds[-1]))
            chars += sum(len(a) for a, _ in found)
            if chars > BATCH_CHARS:
                yield _batch(out, _WALK)
                out, chars = [], 0
        if out:
            yield _batch(out, _WALK)


def _entered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block is entered; what its border to the block before adds; the whole cost, at the first block."""
    for batch in batches:
        out = []
        for blocks in batch.column(0).to_pylist():
            state, before = START, None
            for x in blocks:
                out.append((x["block"], state, int(before is not None and not lawful(before, x["first"])), x["costs"][START] if before is None else 0))
                state, before = x["behind"][state], x["last"]
        if out:
            yield _batch(out, pa.schema([("entry_block", pa.int64()), ("state", pa.int32()), ("border", pa.int64()), ("cost", pa.int64())]))


def _by_conversation(rows: DataFrame, *columns: str) -> DataFrame:
    """The blocks of each conversation in order: a BLOCK-th of its entries."""
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("blocks")).select("blocks")


@dataclass
class Repair:
    """Entries of the conversations and, for each of their blocks, the edits."""

    entries: DataFrame
    edits: DataFrame


def plan(turns: DataFrame) -> Repair:
    """The cheapest edits of every conversation of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    A conversation's rows count by turn, nulls first, then role and text. Null
    texts and roles count as one space; null conv_ids form one conversation;
    repeated rows are duplicates. An empty table gives no edits.
    """
    rows = entries(turns)
    lean = rows.select("conv_id", "block", "pos", "role", "code", "n", "digest")
    inked = (F.col("code") % 4) != BLANK
    first = lean.where(inked).groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"))
    first = first.agg(F.min(F.struct("block", "pos")).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    later = F.col("_first").isNotNull() & inked & (F.struct("block", "pos") > F.col("_first"))
    code = F.when(later, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code")).cast("int")
    judged = lean.join(first, same, "left").select("conv_id", "block", "pos", code.alias("code"), "n")
    in_order = F.sort_array(F.collect_list(F.struct("pos", "code", "n")))
    blocks = judged.groupBy("conv_id", "block").agg(in_order.alias("x"))
    blocks = written(blocks.select("conv_id", "block", F.transform("x", lambda x: x["code"]).alias("codes"), F.transform("x", lambda x: x["n"]).alias("counts")), "blocks")
    costs = arrow_map(blocks, _costs, "conv_id long, block long, m array<long>")
    ends = arrow_map(_by_conversation(costs, "m"), _ends, "block long, end array<long>, opens boolean, closes boolean")
    told = blocks.join(ends, "block").select("conv_id", "block", "codes", "counts", "end", "opens", "closes")
    walks = written(arrow_map(told, _walks, WALK), "walks")
    entered = arrow_map(_by_conversation(walks, "behind", "first", "last", "costs"), _entered, "entry_block long, state int, border long, cost long")
    edits = walks.join(entered, F.col("block") == F.col("entry_block"))
    return Repair(rows, edits.select("conv_id", "block", "state", F.col("audits")[F.col("state")].alias("audit"), "cost", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("border")).alias("illegal")))


_TURN = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
TURN = "conv_id long, block long, seq long, role string, text string, edit string"


def _rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, at, state, seq, out, chars, block, conv = "", 0, START, 0, [], 0, None, None

    def inserted() -> None:
        nonlocal at, state, seq
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            out.append((conv, block, seq, NAMES[state], "", "I"))
            at, seq = at + 1, seq + 1

    for batch in batches:
        for conv_id, own, pos, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pos < 0:  # the edits of a block, ahead of its entries
                inserted()
                conv, block, audit, at, state, seq = conv_id, own, role, 0, n, 0
                continue
            inserted()
            letter = audit[at]
            at += n
            if letter != "D":
                state = NEXT[state] if letter == "R" else SYSTEM if role.startswith("s") else NEXT[state]
                out.append((conv, block, seq, role if letter == "K" else NAMES[state], text, letter))
                seq, chars = seq + 1, chars + len(text)
            if chars > BATCH_CHARS or len(out) > 10_000:
                yield _batch(out, _TURN)
                out, chars = [], 0
    inserted()
    if out:
        yield _batch(out, _TURN)


def repaired(plan_: Repair, *keys: str) -> DataFrame:
    """The turns that the edits leave, in order of (block, seq), each with the initial of its edit.

    ``keys`` deal out the work: by block, unless whole conversations are wanted in one partition.
    """
    texts = plan_.entries.select("conv_id", "block", "pos", "role", "text", "n")
    heads = plan_.edits.select("conv_id", "block", F.lit(-1).alias("pos"), F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"), F.col("state").cast("long").alias("n"))
    rows = texts.unionByName(heads).repartition(*(keys or ("conv_id", "block"))).sortWithinPartitions("conv_id", "block", "pos")
    return arrow_map(rows, _rebuild, TURN)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, out = object(), None, []
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now or digest is None:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if len(out) > 5000:
            yield _batch(out, schema)
            out = []
    if digest is not None:
        out.append((now, digest.hexdigest()))
    if out:
        yield _batch(out, schema)


def report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: what it lacks, the edits and their cost, a digest of its repaired turns.

    ``ids`` names conversations (conv_id) that get a row even without turns:
    zeros, an empty audit, the digest of nothing. Beside what ``plan`` says of
    odd rows: an empty table gives an empty report.
    """
    done = plan(turns)
    told = done.edits.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated", "illegal")),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    gaps = done.entries.select("conv_id", "turn").groupBy("conv_id").agg(span.cast("long").alias("gaps"))
    digests = arrow_map(repaired(done, "conv_id"), _digest, "conv_id long, repaired_sha256 string")
    known = (ids if ids is not None else turns).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = known.unionByName(told, True).unionByName(gaps, True).unionByName(digests, True)
    most: list[Column] = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return every.groupBy("conv_id").agg(*most, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
