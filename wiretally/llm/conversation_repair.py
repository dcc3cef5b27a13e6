"""Repair of conversation structure by the cheapest edits.

Roles must spell ``(s?(ua)+)?`` by their initials. A Viterbi decoder walks each conversation's
rows in order with one survivor per state of that pattern. Survivors are leaves of a tree of
backpointers with reference counts: branches no survivor needs are freed at once, and as soon
as all survivors share an ancestor the edits down to it are final and leave the decoder. What
stays in memory is the part on which survivors still differ, not the conversation.

Ties go to the least string of edits. Survivors end with the edit of the same row, so none of their
unresolved suffixes is a prefix of another: their order never changes by what follows, and a
survivor's rank stands for its whole suffix in later comparisons.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import map_rows

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits; a truncated row that is not deleted costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: The state and role that a rerole or an insert leads to, from each state.
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
#: States that inserts can reach from each state, with how many.
REACH = (((START, 0), (USER, 1), (ASSISTANT, 2)), ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)), ((USER, 0), (ASSISTANT, 1)), ((ASSISTANT, 0), (USER, 1)))
#: States that a kept row leads to, by state and initial.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: DETOUR[p][q]: what it costs at most to do from state p all that can be done from state q.
DETOUR = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
#: Inserts that end a conversation in each state.
CLOSE = (0, 2, 1, 0)

EDITS = (
    "conv_id long, step long, edit string, fault string, turn long, old_role string, role string, text string, cost long"
)
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str | None


class Edit(NamedTuple):
    edit: str
    fault: str | None
    turn: int | None
    old_role: str | None
    role: str | None
    text: str | None
    cost: int


class Node:
    """A backpointer: the inserts before a row and that row's edit, reached from a state."""

    __slots__ = ("parent", "children", "state", "inserts", "edit", "row", "held")

    def __init__(self, parent: Node | None, state: int, inserts: int, edit: str, row: Row | None):
        self.parent, self.state, self.inserts, self.edit, self.row = parent, state, inserts, edit, row
        self.children: set[Node] = set()
        self.held = False
        if parent is not None:
            parent.children.add(self)

    @property
    def references(self) -> int:
        return len(self.children) + self.held

    def release(self) -> None:
        """Free this branch up to the first node that something else still needs."""
        node: Node | None = self
        while node is not None and not node.references:
            parent, node.parent = node.parent, None
            if parent is not None:
                parent.children.discard(node)
            node = parent

    def edits(self) -> Iterator[Edit]:
        state, inserts = self.state, self.inserts
        for _ in range(inserts):
            state, role = NEXT[state]
            yield Edit("I", None, None, None, role, "", INSERT)
        row = self.row
        if row is None:
            return
        extra = TRUNCATED if row.fault == "truncated" else 0
        if self.edit == "D":
            yield Edit("D", row.fault, row.turn, row.role, None, None, DELETE)
        elif self.edit == "K":
            yield Edit("K", row.fault, row.turn, row.role, row.role, row.text, extra)
        else:
            yield Edit("R", row.fault, row.turn, row.role, NEXT[state][1], row.text, REROLE + extra)


class Decoder:
    """Viterbi over one conversation. ``push`` and ``close`` yield edits once they are final."""

    def __init__(self):
        self.root = Node(None, START, 0, "", None)
        self.root.held = True
        self.alive: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}  # state: cost, rank, node

    def push(self, row: Row) -> Iterator[Edit]:
        must_go = row.fault in ("blank", "duplicate")
        extra, initial = TRUNCATED if row.fault == "truncated" else 0, row.role[:1]
        best: dict[int, tuple] = {}
        for before, (cost, rank, node) in self.alive.items():
            for state, inserts in REACH[before]:
                paid = cost + INSERT * inserts
                options = [("D", state, paid + DELETE)]
                if not must_go:
                    options.append(("R", NEXT[state][0], paid + REROLE + extra))
                    if (kept := KEEP.get((state, initial))) is not None:
                        options.append(("K", kept, paid + extra))
                for edit, after, total in options:
                    found = (total, rank, "I" * inserts + edit, before, node)
                    if after not in best or found[:3] < best[after][:3]:
                        best[after] = found
        cheapest = {q: b for q, b in best.items() if not any(o[0] + DETOUR[p][q] < b[0] for p, o in best.items())}
        order = sorted(cheapest, key=lambda q: cheapest[q][1:3])
        old = [node for _, _, node in self.alive.values()]
        alive = {}
        for rank, q in enumerate(order):
            cost, _, suffix, before, node = cheapest[q]
            leaf = Node(node, before, len(suffix) - 1, suffix[-1], row)
            leaf.held = True
            alive[q] = (cost, rank, leaf)
        self.alive = alive
        for node in old:
            node.held = False
            node.release()
        yield from self._coalesced()

    def _coalesced(self) -> Iterator[Edit]:
        """Edits down to the youngest ancestor that all survivors share."""
        while self.root.references == 1 and not self.root.held:
            (child,) = self.root.children
            yield from child.edits()
            child.parent = None
            self.root = child

    def unresolved(self) -> int:
        """Nodes in memory below the shared ancestor."""
        seen, todo = 0, list(self.root.children)
        while todo:
            node = todo.pop()
            seen += 1
            todo.extend(node.children)
        return seen

    def close(self) -> Iterator[Edit]:
        ends = ((cost + INSERT * CLOSE[q], rank, q, node) for q, (cost, rank, node) in self.alive.items())
        _, _, state, node = min(ends, key=lambda e: e[:2])
        last = Node(node, state, CLOSE[state], "", None)
        path = []
        while last is not self.root:
            path.append(last)
            last = last.parent
        for node in reversed(path):
            yield from node.edits()


def fault_of(text: str, repeated: bool) -> str | None:
    body = text.rstrip(WHITE)
    if not body:
        return "blank"
    if repeated:
        return "duplicate"
    return None if body[-1] in ENDS else "truncated"


def _edits(batches: Iterator[dict]) -> Iterator[list[tuple[int | None, int, Edit]]]:
    """Final edits (conversation, step, edit) of rows that come conversation by conversation."""
    decoder, conversation, step = None, None, 0
    for batch in batches:
        out = []
        for conv, turn, role, text, repeated in zip(*(batch[c] for c in ("conv_id", "turn", "role", "text", "repeated"))):
            if decoder is None or conv != conversation:
                if decoder is not None:
                    for edit in decoder.close():
                        out.append((conversation, step, edit))
                        step += 1
                decoder, conversation, step = Decoder(), conv, 0
            for edit in decoder.push(Row(turn, role, text, fault_of(text, repeated))):
                out.append((conversation, step, edit))
                step += 1
        yield out
    if decoder is not None:
        yield [(conversation, step + n, edit) for n, edit in enumerate(decoder.close())]


def _edit_rows(batches: Iterator[dict]) -> Iterator[dict]:
    names = [c.split()[0] for c in EDITS.split(", ")]
    for out in _edits(batches):
        columns = zip(*((conv, step, *edit) for conv, step, edit in out)) if out else [()] * len(names)
        yield {n: list(c) for n, c in zip(names, columns)}


class _Tally:
    """The summary of one conversation, from its edits in order."""

    def __init__(self, conversation: int | None):
        self.conversation, self.faults, self.illegal, self.cost = conversation, dict(blank=0, duplicate=0, truncated=0), 0, 0
        self.least = self.most = self.turn = None
        self.turns, self.initial, self.audit = 0, None, []
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, edit: Edit) -> None:
        self.cost += edit.cost
        self.audit.append(edit.edit)
        if edit.fault is not None:
            self.faults[edit.fault] += 1
        if edit.old_role is not None:
            initial = edit.old_role[:1]
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            if edit.turn is not None and edit.turn != self.turn:
                self.least, self.most, self.turn = self.least if self.turns else edit.turn, edit.turn, edit.turn
                self.turns += 1
        if edit.role is not None:
            self.digest.update(("\n" * (self.lines > 0) + f"{edit.role}:{edit.text}").encode())
            self.lines += 1

    def values(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conversation, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _summary_rows(batches: Iterator[dict]) -> Iterator[dict]:
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    tally = None
    for out in _edits(batches):
        done = []
        for conversation, step, edit in out:
            if step == 0:
                if tally is not None:
                    done.append(tally.values())
                tally = _Tally(conversation)
            tally.add(edit)
        yield {n: list(c) for n, c in zip(names, zip(*done) if done else [()] * len(names))}
    if tally is not None:
        yield {n: [v] for n, v in zip(names, tally.values())}


def _in_order(conversations: DataFrame) -> DataFrame:
    """Rows of each conversation together and in order, with whether role and text came before.

    One shuffle, by conversation; both orders are sorts within its partitions.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", F.md5(F.col("text").cast("binary"))).orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("repeated", F.row_number().over(same) > 1)
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "repeated")


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, one row each, in the order of ``step``.

    ``edit`` is K(eep), R(erole), D(elete) or I(nsert); ``role`` and ``text`` are those of the
    repaired row (null: deleted), ``turn`` and ``old_role`` those of the original (null: inserted),
    ``fault`` its first of blank, duplicate and truncated. Rows are taken by turn (nulls first;
    rows of one turn by role and text); repeated rows are duplicates. Null roles and texts count
    as one space; rows without a conversation are one conversation. An empty table gives no row,
    other columns are not read. A conversation streams through one task in sorted order; in memory
    is only what is not yet decided. A turn of any length is one row.
    """
    return map_rows(_in_order(conversations), _edit_rows, EDITS)


def summarise(conversations: DataFrame) -> DataFrame:
    """``repair`` folded to one row a conversation: faults, gaps in turns, cost, edits, digest."""
    return map_rows(_in_order(conversations), _summary_rows, SUMMARY)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn``: dropped, emptied, cut, repeated or of role user.

    Nulls in any column count as one space there; repeated rows are damaged alike.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    marked = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The summary of every conversation after ``damage``; zeros where no row is left."""
    found = summarise(damage(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    nothing = hashlib.sha256().hexdigest()
    columns = [c.split() for c in SUMMARY.split(", ")[1:]]
    fill = {"audit": "", "repaired_sha256": nothing}
    joined = every.join(found, every["id"].eqNullSafe(found["conv_id"]), "left")
    return joined.select(F.col("id").alias("conv_id"), *(F.coalesce(F.col(n), F.lit(fill.get(n, 0)).cast(t)).alias(n) for n, t in columns))
