"""Repair of conversations: the cheapest edits to a legal order of roles, by a streaming Viterbi.

A conversation's rows pass one after the other.  Each state of the role automaton keeps one survivor,
a node of a tree of back pointers whose nodes count their references.  Dead branches are freed at
once; as soon as all survivors share an ancestor, the edits up to it are final and leave the tree,
together with their rows.  So memory is bounded by the undecided suffix, not by the conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: States after a prefix: nothing yet, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> {role initial: next state}; an edit that makes a row makes the user or assistant row that
#: may stand there.
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: After an assistant row everything may follow that may follow these states, but for a system row
#: after nothing, which it must delete: a state that is dearer by more than this never wins.
BEHIND = {START: COST[DELETE], SYSTEM: 0}
LEGAL = {"su", "ua", "au"}
BLANK = r"[^\x20\x09-\x0D]"
DAMAGE = 20
BATCH_ROWS = 1024
BATCH_CHARS = 4_000_000


class Node:
    """An edit that led to a state; ``kids`` and ``held`` (survivors here) are its references."""

    __slots__ = ("up", "edit", "kids", "held")

    def __init__(self, up: Node | None, edit: str):
        self.up, self.edit, self.kids, self.held = up, edit, [], 0


class Viterbi:
    """Survivors of one conversation.  ``step`` takes a row, ``finish`` ends; both return the edits that
    are final by then.  Of equal cost the smallest string of edits wins.

    Two paths to a state after the same rows are never one the other's beginning unless one is
    dearer, so the smaller unresolved suffix stays the smaller one whatever follows.
    """

    def __init__(self):
        self.root = Node(None, "")
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.root.held = 1
        self._inserts(self.best)

    def _suffix(self, node: Node) -> str:
        out = []
        while node is not self.root:
            out.append(node.edit)
            node = node.up
        return "".join(reversed(out))

    def _offer(self, into: dict, state: int, cost: int, up: Node, edit: str) -> bool:
        """Make the path over ``up`` the state's survivor if it is better."""
        old = into.get(state)
        if old is not None:
            if cost > old[0]:
                return False
            if cost == old[0] and self._suffix(up) + edit >= self._suffix(old[1]):
                return False
        node = Node(up, edit)
        up.kids.append(node)
        node.held += 1
        into[state] = (cost, node)
        if old is not None:
            self._let_go(old[1])
        return True

    def _let_go(self, node: Node) -> None:
        node.held -= 1
        while node is not self.root and not node.held and not node.kids:
            up = node.up
            up.kids.remove(node)
            node = up

    def _inserts(self, into: dict) -> None:
        """Rows made at this place; each costs, so a path passes a state at most once."""
        moved = True
        while moved:
            moved = False
            for state, (cost, node) in list(into.items()):
                if into.get(state) == (cost, node):
                    moved |= self._offer(into, MADE[state], cost + COST[INSERT], node, INSERT)

    def _final(self) -> str:
        out = []
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.up = None
            out.append(self.root.edit)
        return "".join(out)

    def step(self, initial: str, faulty: bool, truncated: bool) -> str:
        """``faulty`` rows (blank or duplicate) must go; a truncated row that stays costs more."""
        new: dict[int, tuple[int, Node]] = {}
        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.best.items():
            self._offer(new, state, cost + COST[DELETE], node, DELETE)
            if faulty:
                continue
            if initial in MOVES[state]:
                self._offer(new, MOVES[state][initial], cost + COST[KEEP] + extra, node, KEEP)
            self._offer(new, MADE[state], cost + COST[REROLE] + extra, node, REROLE)
        self._inserts(new)
        for _, node in self.best.values():
            self._let_go(node)
        self.best = new
        for state, slack in BEHIND.items():
            if state in new and new[ASSISTANT][0] + slack < new[state][0]:
                self._let_go(new.pop(state)[1])
        return self._final()

    def finish(self) -> tuple[int, str]:
        """The cost, and the edits not yet told, of the cheapest legal end."""
        ends = [self.best[s] for s in ENDS if s in self.best]
        cost, node = min(ends, key=lambda end: (end[0], self._suffix(end[1])))
        return cost, self._suffix(node)


class Conversation:
    """One conversation on its way through: counts, the rows not yet decided, and what was made of the
    others, which ``emit`` hands on as (role, text, edit) rows."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.kinds = 0
        self.low = self.high = self.last_initial = None
        self.viterbi = Viterbi()
        self.waiting: deque[tuple[str, str]] = deque()
        self.state = START

    def add(self, turn, role: str, text: str, seen: bool, blank: bool, truncated: bool) -> Iterator[tuple]:
        initial = role[:1]
        duplicate = seen and not blank
        truncated = truncated and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.rows:
            self.illegal += self.last_initial + initial not in LEGAL
        self.rows, self.last_initial = self.rows + 1, initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.kinds = turn, self.kinds + 1
        self.waiting.append((role, text))
        return self.emit(self.viterbi.step(initial, blank or duplicate, truncated))

    def emit(self, edits: str) -> Iterator[tuple]:
        for edit in edits:
            if edit == INSERT:
                self.state = MADE[self.state]
                yield ROLE[self.state], "", edit
                continue
            role, text = self.waiting.popleft()
            if edit == DELETE:
                yield role, text, edit
                continue
            self.state = MOVES[self.state][role[:1]] if edit == KEEP else MADE[self.state]
            yield role if edit == KEEP else ROLE[self.state], text, edit

    def end(self) -> tuple[int, Iterator[tuple]]:
        cost, edits = self.viterbi.finish()
        return cost, self.emit(edits)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.kinds


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults put in by crc32 of ``conv_id:turn``, and
    ``gone``, true for dropped rows: 1 in 20 is dropped, emptied, stripped of ``.!?``, repeated, or
    given to the user.  A null role or text becomes one space, and so does a null in the hashed key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % DAMAGE
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
        (fault == 0).alias("gone"), F.when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("_", "times")


def _ordered(df: DataFrame) -> DataFrame:
    """Rows with their faults, each conversation whole in one partition and in the order of its turns.

    Rows are dealt by conversation once; the search for rows seen before and the stream both work
    within these partitions.
    """
    flags: dict[str, Column] = {
        "blank": ~F.col("text").rlike(BLANK),
        "truncated": ~F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?"),
    }
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    rows = df.select(
        "conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), gone.alias("gone")
    ).repartition("conv_id").withColumns(flags)
    before = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("seen", F.row_number().over(before) > 1)
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")


NAMES = ["conv_id", "turn", "role", "text", "gone", "blank", "truncated", "seen"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, list | None, int | None]]:
    """(conversation, final rows, None) as rows become final, and (conversation, last rows, cost) at its
    end."""
    now: Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, gone, blank, truncated, seen in zip(*(batch.column(c).to_pylist() for c in NAMES)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    cost, rows = now.end()
                    yield now, list(rows), cost
                now = Conversation(conv_id)
            if not gone:
                rows = list(now.add(turn, role, text, seen, blank, truncated))
                if rows:
                    yield now, rows, None
    if now is not None:
        cost, rows = now.end()
        yield now, list(rows), cost


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repaired(df: DataFrame) -> DataFrame:
    """Repaired conversations: conv_id, at (1, 2, ... in a conversation), role, text and edit (K kept, R
    given another role, I inserted) of every row that stays.

    ``df`` has conv_id, turn, role, text, and may have ``gone`` (rows that are not there, though their
    conversation is); other columns do not matter.  Rows go by turn, nulls first; rows of one turn by
    role and text.  A null conv_id is a conversation of its own.  Null roles and texts count as one
    space.  Rows whose role starts with no s, u or a (an empty one too) can only be given another role or deleted.
    Repeated rows are duplicates and go.  Texts of any length and conversations of any number of rows
    pass as a stream.  An empty table gives an empty one.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches):
        held, size, conv, at = [], 0, None, 0
        for conversation, rows, cost in _stream(batches):
            if conversation is not conv:
                conv, at = conversation, 0
            for role, text, edit in rows:
                if edit != DELETE:
                    at += 1
                    held.append((conv.conv_id, at, role, text, edit))
                    size += len(text)
            if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield _table(held, schema)
                held, size = [], 0
        if held:
            yield _table(held, schema)

    return _ordered(df).select(*NAMES).mapInArrow(run, "conv_id long, at long, role string, text string, edit string")


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(df: DataFrame) -> DataFrame:
    """One row per conversation: faults found, cost and edits of the cheapest repair, and the digest of
    the repaired ``role:text`` lines (see ``repaired`` for what counts as what).

    The digest runs along with the stream, so no conversation is ever held whole.  A conversation
    without rows has zeros, no edits and the digest of the empty string.
    """
    schema = pa.schema([
        (name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in AUDIT.split(", "))
    ])

    def run(batches):
        held, conv, digest, edits = [], None, None, []
        for conversation, rows, cost in _stream(batches):
            if conversation is not conv:
                conv, digest, edits, first = conversation, hashlib.sha256(), [], True
            for role, text, edit in rows:
                edits.append(edit)
                if edit != DELETE:
                    digest.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
                    first = False
            if cost is not None:
                held.append((
                    conv.conv_id, conv.gaps, conv.blank, conv.duplicate, conv.truncated, conv.illegal,
                    cost, "".join(edits), digest.hexdigest(),
                ))
                if len(held) >= BATCH_ROWS:
                    yield _table(held, schema)
                    held = []
        if held:
            yield _table(held, schema)

    return _ordered(df).select(*NAMES).mapInArrow(run, AUDIT)
