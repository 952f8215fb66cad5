"""Cheapest repair of conversations, streamed in the order of their turns.

A repaired conversation is a system turn or none, then turns of user and assistant in pairs, or nothing at all. The least cost of
ending well, from each of four states of that grammar, is carried through a conversation's rows from the last to the
first; each row keeps one byte, the best edit for each state. Spark then sorts the rows the other way, spilling them with their
bytes when they don't fit, and a walk from the first row on follows them. Rows are dealt by conversation once, both
passes work batch by batch, and no pass holds more of a conversation than its state, however many turns that has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
EDITS = "DIKR"  #: delete, insert, keep, rerole; in the order that breaks ties
_DELETE, _INSERT, _KEEP, _REROLE = range(4)
#: States: nothing yet; a system turn; a user turn; an assistant turn. Of each, the next one by a turn's initial, and by an added turn.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ADDED = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class RepairParams:
    delete: int = 3
    insert: int = 2
    rerole: int = 2
    truncated: int = 1  #: for a truncated turn that stays


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), damaged by crc32 of `conv_id:turn` modulo 20; nulls count as one space, but a null turn stays null.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats the row, 4 makes it a user's.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, 2).otherwise(1)
    return rows.where("fate != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def _with_faults(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, parts: int | None) -> DataFrame:
    """(conv, turn, role, text, nth, fault), dealt by conversation; nth: of the conversation's rows of this role and text; fault: blank, duplicate, truncated or null."""
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    rows = rows.repartition(parts, "conv") if parts else rows.repartition("conv")
    # rows dealt by conversation need no other exchange for this
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())))
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(trimmed == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault)


def best_edits(after: list[int], initial: str, fault: str | None, params: RepairParams) -> tuple[list[int], int]:
    """Of each state before a row, given the least costs after it: the least cost, and all best edits in one byte, two bits a state."""
    found = []
    for state in range(4):
        options = [(params.delete + after[state], _DELETE)]
        if fault not in ("blank", "duplicate"):
            stays = params.truncated if fault else 0
            if initial in _NEXT[state]:
                options.append((stays + after[_NEXT[state][initial]], _KEEP))
            options.append((params.rerole + stays + after[_ADDED[state]], _REROLE))
        found.append(min(options))
    for state in (2, 3, 0, 1):  # a turn added before the row; a second one may come before that
        found[state] = min(found[state], (params.insert + found[_ADDED[state]][0], _INSERT))
    return [c for c, _ in found], sum(edit << 2 * state for state, (_, edit) in enumerate(found))


def _backwards(params: RepairParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds `best` and `last` to rows that come from the last turn to the first."""
    ended = [0, 2 * params.insert, params.insert, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after = object(), ended
        for batch in batches:
            best, last = [], []
            for own, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "initial", "fault"))):
                last.append(own != conv)
                if own != conv:
                    conv, after = own, ended
                after, byte = best_edits(after, initial, fault, params)
                best.append(byte)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int16()), pa.array(last, pa.bool_())], names=[*batch.schema.names, "best", "last"])

    return run


@dataclass
class _Walk:
    """Where the forward walk through a conversation stands, and what it has seen."""

    state: int = 0
    cost: int = 0
    place: int = 0
    seen: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated"), 0))
    illegal: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    initial: str | None = None
    audit: bytearray = field(default_factory=bytearray)
    digest: object = field(default_factory=hashlib.sha256)

    def look(self, turn: int | None, initial: str, fault: str | None) -> None:
        if fault:
            self.seen[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in _LEGAL
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def edits(self, best: int, role: str, text: str, initial: str, fault: str | None, last: bool, params: RepairParams) -> Iterator[tuple[str, str | None, str]]:
        """(edit, role, text) of a row and of what is added before it, and after the last one; a deleted row's role is null."""
        while (edit := best >> 2 * self.state & 3) == _INSERT:
            yield self._added(params.insert, "I", "")
        if edit == _DELETE:
            self.cost += params.delete
            yield "D", None, text
        else:
            self.cost += params.truncated if fault else 0
            if edit == _KEEP:
                self.state = _NEXT[self.state][initial]
                yield "K", role, text
            else:
                yield self._added(params.rerole, "R", text)
        while last and self.state in (1, 2):
            yield self._added(params.insert, "I", "")

    def _added(self, cost: int, edit: str, text: str) -> tuple[str, str, str]:
        self.cost += cost
        self.state = _ADDED[self.state]
        return edit, _ROLE[self.state], text

    def write(self, edit: str, role: str | None, text: str) -> None:
        self.audit += edit.encode()
        if role is not None:
            self.digest.update(("\n" if self.place else "").encode() + f"{role}:{text}".encode())
            self.place += 1

    def report(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, *self.seen.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest()


def _steps(batches: Iterator[pa.RecordBatch], params: RepairParams) -> Iterator[tuple[object, int | None, _Walk, list, bool]]:
    """For each row from the first turn on: its conversation and turn, the walk so far, (edit, role, text) of what it becomes, whether it is the last."""
    walk, names = _Walk(), ("conv", "turn", "role", "text", "initial", "fault", "best", "last")
    for batch in batches:
        for conv, turn, role, text, initial, fault, best, last in zip(*(batch.column(c).to_pylist() for c in names)):
            walk.look(turn, initial, fault)
            yield conv, turn, walk, list(walk.edits(best, role, text, initial, fault, last, params)), last
            if last:
                walk = _Walk()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of at most 1,000 rows, or of about a million of what `size` counts."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= 1000 or total > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _walked(turns: DataFrame, params: RepairParams, names: tuple[str, str, str, str], parts: int | None) -> DataFrame:
    """Rows from the first turn to the last of each conversation, each with its best edits; sorted within partitions."""
    rows = _with_faults(turns, *names, parts).withColumn("initial", F.substring("role", 1, 1))
    tie = ["role", "text", "nth"]  # no two rows of a conversation are equal in all, so that both orders are each other's reverse
    back = rows.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), *[F.col(c).desc() for c in tie])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", best smallint, last boolean"
    edited = back.mapInArrow(_backwards(params), schema)
    return edited.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), *tie)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(turns: DataFrame, params: RepairParams = RepairParams(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row for each conversation: `conv_id`, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation are ordered by turn, null turns first, then by role and text; a null conversation is one like any other, a null
    role or text counts as one space, so such a text is blank. A row has its first fault only: blank (white space or nothing), duplicate (same role and
    text as an earlier row), truncated (doesn't end with a full stop, exclamation or question mark). gaps: turns missing between the
    least and the greatest. illegal: neighbours whose roles can't follow each other. A role without an initial of s, u or a can't be kept.
    cost and audit: the cheapest edits, of equal ones the least in ASCII order. repaired_sha256: digest of `role:text` lines.
    Other columns are dropped; an empty table gives no rows. `parts`: partitions, by default Spark's.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field("conv"), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def reports() -> Iterator[tuple]:
            for conv, _, walk, edits, last in _steps(chain([first], batches), params):
                for edit in edits:
                    walk.write(*edit)
                if last:
                    yield conv, *walk.report()

        yield from _batched(reports(), schema, lambda row: len(row[-2]))

    kinds = f"conv {dict(turns.dtypes)[conv_id]}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _walked(turns, params, (conv_id, turn, role, text), parts).mapInArrow(told, kinds).withColumnRenamed("conv", conv_id)


def repaired_turns(turns: DataFrame, params: RepairParams = RepairParams(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place from 0, role, text, edit (I, K or R), and the turn each came from (null if added).

    Rows, ties and nulls are as in `repair_report`. A conversation of which nothing stays has no rows.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field("conv"), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), first.schema.field("turn")])

        def rows() -> Iterator[tuple]:
            for conv, at, walk, edits, _ in _steps(chain([first], batches), params):
                for edit, as_role, as_text in edits:
                    if as_role is not None:
                        yield conv, walk.place, as_role, as_text, edit, None if edit == "I" else at
                        walk.place += 1

        yield from _batched(rows(), schema, lambda row: len(row[3]))

    kind, number = (dict(turns.dtypes)[c] for c in (conv_id, turn))
    found = _walked(turns, params, (conv_id, turn, role, text), parts).mapInArrow(told, f"conv {kind}, place bigint, role string, text string, edit string, turn {number}")
    return found.withColumnsRenamed({"conv": conv_id, "turn": turn})
