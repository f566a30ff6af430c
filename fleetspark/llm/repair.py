"""Repairing the structure of conversations: the cheapest edits after which roles alternate, by survivor-coalescence Viterbi.

A conversation is well formed when its roles are an optional system turn and then pairs of user and assistant. Four states
tell how far that pattern has come, so at most four best ways of editing the turns so far survive each turn. Survivors are leaves
of a tree of backpointers. A node that no survivor goes back to is freed, by its count of references, and as soon as all
survivors go back to one node, the edits up to it are final and are emitted.

Of ways that cost the same, the one whose edits are the least as text wins. Survivors are kept in the order of their complete
unresolved suffixes. Each ends in the edit of the last turn, so none is the beginning of another, and what follows cannot
change their order: the next turn compares the places in this order, then the new edits.
"""

import hashlib
import sys
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
# The state after a role's initial, and the role that comes next in each state.
_STEPS = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
_NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
# Inserts that complete the pattern at the end.
_ENDING = ("", "II", "I", "")

# What it costs at most to do from the first state whatever is done from the second, by inserts, or by a deletion of the
# system turn that the second keeps. A survivor that costs more than another and this can win no more, nor tie.
_FOLLOW = ((0, 0, INSERT, 0), (6, 0, INSERT, 6), (INSERT + DELETE, INSERT, 0, INSERT), (DELETE, 0, INSERT, 0))

_LONGEST = 2**63 - 1


class Move(NamedTuple):
    cost: int
    edits: str
    state: int


@cache
def moves(state: int, initial: str, must_go: bool, truncated: bool) -> tuple[Move, ...]:
    """The best way into each state over one turn: up to two inserts and the turn's own edit.

    Nothing is inserted before a deletion, as the same insert after it is as good and comes first as text.
    """
    best = {state: Move(DELETE, "D", state)}
    if must_go:
        return tuple(best.values())
    more, inserts, at = TRUNCATED * truncated, "", state
    while True:
        found = [Move(len(inserts) * INSERT + REROLE + more, inserts + "R", _NEXT[at][0])]
        if initial in _STEPS and at in _STEPS[initial]:
            found.append(Move(len(inserts) * INSERT + more, inserts + "K", _STEPS[initial][at]))
        for move in found:
            best[move.state] = min(best.get(move.state, move), move)
        if len(inserts) == 2:
            return tuple(best.values())
        inserts, at = inserts + "I", _NEXT[at][0]


class _Node:
    """The edits of one turn after those of `up`. `refs` counts the nodes and survivors that go back to it."""

    __slots__ = ("up", "edits", "refs")

    def __init__(self, up: "_Node | None", edits: str):
        self.up, self.edits, self.refs = up, edits, 0
        if up is not None:
            up.refs += 1


def _free(node: "_Node | None") -> None:
    """Frees a node that nothing goes back to any more, and what only it went back to."""
    while node is not None and node.refs == 0:
        node.up, above = None, node.up
        if above is not None:
            above.refs -= 1
        node = above


class _Survivor(NamedTuple):
    cost: int
    state: int
    node: _Node
    digest: object


def _told(digest, state: int, edits: str, role: str, text: str):
    """The digest of the repaired turns after these edits, which begin in `state`."""
    if edits == "D":
        return digest
    digest = digest.copy()
    for edit in edits:
        if edit == "K":
            digest.update(f"{role}:{text}")
            continue
        state, given = _NEXT[state]
        digest.update(f"{given}:{'' if edit == 'I' else text}")
    return digest


class _Digest:
    """A running sha256 of lines, joined by newlines."""

    __slots__ = ("_sum", "_fed")

    def __init__(self, own=None, fed: bool = False):
        self._sum, self._fed = hashlib.sha256() if own is None else own, fed

    def copy(self) -> "_Digest":
        return _Digest(self._sum.copy(), self._fed)

    def update(self, line: str) -> None:
        self._sum.update((f"\n{line}" if self._fed else line).encode())
        self._fed = True

    def hexdigest(self) -> str:
        return self._sum.hexdigest()


class Viterbi:
    """The survivors of one conversation. Feed it turns; `emitted` grows by the edits of turns that are settled."""

    def __init__(self) -> None:
        self._root = _Node(None, "")
        self._survivors = [_Survivor(0, START, self._root, _Digest())]
        self._root.refs = 1
        self.emitted: list[str] = []
        self.unresolved = 0

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """One more turn."""
        best: dict[int, tuple] = {}
        for place, s in enumerate(self._survivors):
            for move in moves(s.state, role[:1], must_go, truncated):
                key = (s.cost + move.cost, place, move.edits)
                if move.state not in best or key < best[move.state]:
                    best[move.state] = key
        least = [
            (state, key) for state, key in best.items()
            if not any(other[0] + _FOLLOW[q][state] < key[0] for q, other in best.items())
        ]
        least.sort(key=lambda x: x[1][1:])
        before, self._survivors = self._survivors, []
        for state, (cost, place, edits) in least:
            s = before[place]
            node = _Node(s.node, edits)
            node.refs = 1
            self._survivors.append(_Survivor(cost, state, node, _told(s.digest, s.state, edits, role, text)))
        for s in before:
            s.node.refs -= 1
            _free(s.node)
        self.unresolved += 1
        if self._root.refs == 1:
            self._emit()

    def _emit(self) -> None:
        """Emits the edits between the root and the last node that all survivors go back to."""
        line, node = [], self._survivors[0].node
        while node is not self._root:
            line.append(node)
            node = node.up
        while line and self._root.refs == 1:
            child = line.pop()
            self.emitted.append(child.edits)
            self.unresolved -= 1
            child.up, self._root = None, child

    def finish(self) -> tuple[int, str]:
        """The cost of the cheapest edits and the digest of what they leave; all edits are in `emitted` then."""
        ends = [(s.cost + INSERT * len(_ENDING[s.state]), place) for place, s in enumerate(self._survivors)]
        cost, place = min(ends)
        s = self._survivors[place]
        line, node = [], s.node
        while node is not self._root:
            line.append(node.edits)
            node = node.up
        self.emitted += [*reversed(line), _ENDING[s.state]]
        self.unresolved = 0
        return cost, _told(s.digest, s.state, _ENDING[s.state], "", "").hexdigest() if _ENDING[s.state] else s.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with faults put in by a hash of `conv_id:turn`: dropped (`present` is false), emptied, without sentence
    marks, twice, or as the user's. A null role or text is one space from here on, and so is a null in the hash.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("_kind"),
        (kind != 0).alias("present"),
    )
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", "present", twice.alias("_copy")).drop("_copy")


def _faults(turns: DataFrame) -> DataFrame:
    """The turns with their first `fault`: blank, duplicate (role and text seen earlier), truncated, or none.

    Both orders are made within the partitions of the conversations, by sorts that spill.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    earlier = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(~F.col("present"), None).when(blank, "blank").when(F.row_number().over(earlier) > 1, "duplicate")
        .when(~ended, "truncated")
    )
    dealt = turns.repartition("conv_id").withColumn("fault", fault)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return dealt.sortWithinPartitions(*order)


class _Conversation:
    """What is counted of one conversation as its turns pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.viterbi = conv_id, Viterbi()
        self._faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self._first = self._last = None
        self._turns = self._illegal = 0
        self._before: str | None = None

    def turn(self, number: int | None, role: str, text: str, fault: str | None) -> None:
        if number is not None and number != self._last:
            self._first = number if self._first is None else self._first
            self._last, self._turns = number, self._turns + 1
        if fault is not None:
            self._faults[fault] += 1
        if self._before is not None and self._before + role[:1] not in ("su", "ua", "au"):
            self._illegal += 1
        self._before = role[:1]
        self.viterbi.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = 0 if self._first is None else min(self._last - self._first + 1 - self._turns, _LONGEST)
        cost, digest = self.viterbi.finish()
        return (self.conv_id, gaps, *self._faults.values(), self._illegal, cost, "".join(self.viterbi.emitted), digest)


_RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, bool]]:
    """The conversation after each present turn, and whether it is over. One conversation is held at a time."""
    own: _Conversation | None = None
    names = ("conv_id", "turn", "role", "text", "present", "fault")
    for batch in batches:
        for conv_id, number, role, text, present, fault in zip(*[batch.column(n).to_pylist() for n in names]):
            if own is None or conv_id != own.conv_id:
                if own is not None:
                    yield own, True
                own = _Conversation(conv_id)
            if present:
                own.turn(number, role, text, fault)
                yield own, False
    if own is not None:
        yield own, True


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and letters of the cheapest edits, and a hash of the repaired turns.

    `turns` has conv_id, turn, role and text, and optionally `present`, false for a turn that only names its conversation.
    Turns are taken in ascending order, nulls first, those of equal number by role and text. Keep costs nothing, Rerole to user
    or assistant 3, Delete 4, Insert of an empty user or assistant turn 3. Blank and duplicate turns must go; a truncated one
    that stays adds 3. Afterwards the roles' initials are `(s?(ua)+)?`. Among the cheapest, the edits least as text count. A
    role that does not begin with s, u or a is never kept, an empty one neither.

    Nulls in role and text count as one space, a null conv_id is a conversation, and repeated rows are turns each, duplicates
    of the first. A conversation without present turns has zeros, no edits and the hash of nothing. An empty table gives an
    empty result; other columns are not read.

    Conversations are dealt by id and sorted on disk if need be; a task walks through them turn by turn. Texts are dropped as
    they pass, as each of the four survivors has its own running hash. In memory are the unresolved edits and the letters
    of one conversation. The hash is over the turns in order, so a conversation is one task's work, however long.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        letters = 0
        for own, over in _walked(batches):
            if over:
                out.append(own.row())
                letters += len(out[-1][7])
            if len(out) >= 10_000 or letters > 1 << 22:
                yield _batch(out)
                out, letters = [], 0
        if out:
            yield _batch(out)

    return _faults(_told_rows(turns)).mapInArrow(rows, _RESULT)


def _told_rows(turns: DataFrame) -> DataFrame:
    """The columns that are read, without nulls in role, text and present."""
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in turns.columns else F.lit(True)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    ids = (F.col(c).cast("long").alias(c) for c in ("conv_id", "turn"))
    return turns.select(*ids, role, text, present.alias("present"))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def edits(turns: DataFrame) -> DataFrame:
    """The edits themselves: conv_id, `place` (from 0, over the present turns in order) and `edits`, letters that end in the
    turn's own edit; what is inserted at the end has the place after the last. Rows leave a task as soon as they are settled,
    so not even the letters of a conversation gather. Order, ties and nulls as in `repaired`.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conversation, place = None, 0
        for own, over in _walked(batches):
            if own is not conversation:
                conversation, place = own, 0
            if over:
                own.row()
            settled, own.viterbi.emitted = own.viterbi.emitted, []
            out += [(own.conv_id, place + i, e) for i, e in enumerate(settled) if e]
            place += len(settled)
            if len(out) >= 10_000:
                yield _edit_rows(out)
                out = []
        if out:
            yield _edit_rows(out)

    return _faults(_told_rows(turns)).mapInArrow(rows, "conv_id long, place long, edits string")


def _edit_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "place", "edits"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after damage."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))
