"""Cheapest repair of conversation structure, streamed through sorted partitions.

Conversations are dealt by id, their rows sorted by turn, and each partition is
read once.  Four states say what the repaired conversation looks like so far;
cost and order of the states go from row to row, and from Arrow batch to Arrow
batch.  One byte per row and state tells how a state was reached.  Rows and
those bytes stay in memory for conversations of usual length and move to a file
of the task beyond ``HELD`` bytes, so a conversation of any length needs little
memory; only its list of edits, a byte per row, is held whole.

Inserts stand right before the edit of the row they precede.  After each row
the edit strings of all states then end in an edit of that row and hold as many
such edits, so none is the beginning of another, and one rank per state is all
that has to be known to find the least string among the cheapest.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm.common import ship

#: Bytes of rows, and of back pointers, kept in memory before they go to a file.
HELD = 4 << 20
#: Edits sent on at once.
SENT = 8192
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What has been said: nothing, a system turn, up to a user turn, up to an assistant turn.  The first and last may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"u": "user", "a": "assistant"}
_SPACE = " \t\n\x0b\f\r"

# -- edits of one row ---------------------------------------------------------------


def _after(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, None where it may not follow."""
    allowed = {
        NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}
    }
    return allowed[state].get(initial)


def _inserted(state: int, n: int) -> int:
    """The state after ``n`` inserted turns; which they are follows from the state."""
    for _ in range(n):
        state = ASSISTANT if state == USER else USER
    return state


def _choices(initial: str, must_go: bool, cut: bool) -> list[list[tuple[int, int, str, int]]]:
    """For each state after the row: (state before, cost, edits, code of the edits).

    Two inserts on end are enough: two more lead back to the same state.
    """
    out: list[list] = [[], [], [], []]
    late = TRUNCATED if cut else 0
    for state in range(4):
        for n in range(3):
            middle, cost, code = _inserted(state, n), INSERT * n, state | n << 2
            out[middle].append((state, cost + DELETE, "I" * n + "D", code))
            if must_go:
                continue
            if (to := _after(middle, initial)) is not None:
                out[to].append((state, cost + KEEP + late, "I" * n + "K", code | 1 << 4))
            for other in ROLES:
                if other != initial and (to := _after(middle, other)) is not None:
                    out[to].append((state, cost + REROLE + late, "I" * n + "R", code | 2 << 4))
    return out


CHOICES = {(i, m, c): _choices(i, m, c) for i in ("s", "u", "a", "") for m in (False, True) for c in (False, True)}
_NEVER = 255


class Tape:
    """Bytes that are appended, and read back in order or from their end; beyond ``HELD`` they are in a file."""

    def __init__(self) -> None:
        self.fresh, self.file, self.size = bytearray(), None, 0

    def add(self, data: bytes) -> None:
        self.fresh += data
        if len(self.fresh) > HELD:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.write(self.fresh)
            self.size += len(self.fresh)
            self.fresh = bytearray()

    def pieces(self, backwards: bool = False) -> Iterator[bytes]:
        starts = list(range(0, self.size, HELD))
        if backwards:
            yield bytes(self.fresh)
        for start in reversed(starts) if backwards else starts:
            self.file.seek(start)
            yield self.file.read(min(HELD, self.size - start))
        if not backwards:
            yield bytes(self.fresh)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Repair:
    """One conversation: rows are added in order, then its edits are read."""

    def __init__(self) -> None:
        self.costs, self.ranks = [0, None, None, None], [0, 0, 0, 0]
        self.back, self.saved, self.rows, self.held = Tape(), None, [], 0

    def add(self, row: tuple, initial: str, must_go: bool, cut: bool) -> None:
        """``row`` is given back with its edit."""
        self.rows.append(row)
        self.held += len(row[-1]) + 100
        if self.held > HELD:
            if self.saved is None:
                self.saved = tempfile.TemporaryFile()
            pickle.dump(self.rows, self.saved)
            self.rows, self.held = [], 0
        costs, ranks, best = self.costs, self.ranks, []
        for choices in CHOICES[initial if initial in ("s", "u", "a") else "", must_go, cut]:
            best.append(
                min(
                    ((costs[state] + cost, ranks[state], edits, code) for state, cost, edits, code in choices if costs[state] is not None),
                    default=None,
                )
            )
        self.back.add(bytes(_NEVER if b is None else b[3] for b in best))
        self.costs = [None if b is None else b[0] for b in best]
        order = sorted((b[1], b[2], state) for state, b in enumerate(best) if b is not None)
        for rank, (*_, state) in enumerate(order):
            self.ranks[state] = rank

    def _codes(self) -> tuple[bytearray, int]:
        """The code of each row's edit in the cheapest repair, and the inserts at the end."""
        ends = ((NOTHING, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0))
        *_, state, last = min(
            (self.costs[s] + INSERT * n, self.ranks[s], s, n) for s, n in ends if self.costs[s] is not None
        )
        codes, rest = bytearray(), b""
        for piece in self.back.pieces(backwards=True):
            piece += rest
            whole = len(piece) // 4
            odd = len(piece) - 4 * whole
            rest = piece[:odd]
            for at in range(len(piece) - 4, odd - 1, -4):
                code = piece[at + state]
                codes.append(code)
                state = code & 3
        codes.reverse()
        return codes, last

    def _held_rows(self) -> Iterator[tuple]:
        if self.saved is not None:
            end = self.saved.tell()
            self.saved.seek(0)
            while self.saved.tell() < end:
                yield from pickle.load(self.saved)
        yield from self.rows

    def edits(self) -> Iterator[tuple[str, str, tuple | None]]:
        """(edit, role after it, row); an inserted turn has no row, a deleted one no role."""
        codes, last = self._codes()
        state = NOTHING
        for code, row in zip(codes, self._held_rows(), strict=True):
            for _ in range(code >> 2 & 3):
                state = _inserted(state, 1)
                yield "I", ROLES["u" if state == USER else "a"], None
            if code >> 4 == 0:
                yield "D", None, row
            elif code >> 4 == 1:
                state = _after(state, row[1][:1])
                yield "K", row[1], row
            else:
                state = ASSISTANT if state == USER else USER
                yield "R", ROLES["u" if state == USER else "a"], row
        for _ in range(last):
            state = _inserted(state, 1)
            yield "I", ROLES["u" if state == USER else "a"], None
        self.back.close()
        if self.saved is not None:
            self.saved.close()


# -- tables -------------------------------------------------------------------------

_EDITS = "conv string, no_id boolean, step long, edit string, role string, text string, turn long, was string, fault string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults that depend on crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it stays as a row marked ``lost``), 1 empties its text, 2
    takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 sets its role to
    user.  Null roles and texts are one space, as are nulls in what is hashed.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("lost"), copies.alias("_copy")).drop("_copy")


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _repair_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _EDITS.split(", ")]
    now, repair, out = None, None, []

    def sent(key: tuple, some: Repair) -> Iterator[tuple]:
        # A conversation without a row left still has this one.
        yield (*key, -1, None, None, None, None, None, None)
        for step, (edit, role, row) in enumerate(some.edits()):
            turn, was, fault, text = row if row else (None, None, None, "")
            yield (*key, step, edit, role, text, turn, was, fault)

    def finished(key: tuple | None, some: Repair | None) -> Iterator[pd.DataFrame]:
        if some is not None:
            for row in sent(key, some):
                out.append(row)
                if len(out) >= SENT:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out.clear()

    for batch in batches:
        columns = [batch[c].tolist() for c in ("conv", "no_id", "lost", "at", "no_turn", "role", "text", "fault")]
        for conv, no_id, lost, at, no_turn, role, text, fault in zip(*columns, strict=True):
            if (conv, no_id) != now:
                yield from finished(now, repair)
                now, repair = (conv, no_id), Repair()
            if not lost:
                row = (None if no_turn else at, role, fault, text)
                repair.add(row, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    yield from finished(now, repair)
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation of ``rows`` (conv_id, turn, role, text, lost), in order.

    Columns: conv, the conv_id as text, and no_id, true where it is null (such
    rows are one conversation); step from 0, after one row with step -1 that
    every conversation has; edit D, I, K or R; role and text after it (a deleted
    row keeps its text and has no role); turn, was (its role) and fault (blank,
    duplicate, truncated or empty) of the row.  Rows marked ``lost`` only make
    their conversation known.

    Rows stand by turn, nulls first, then role, then text.  A row's first fault
    counts: blank, then duplicate (role and text came before), then truncated.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    dealt = rows.select(
        conv.alias("conv"), F.col("conv_id").isNull().alias("no_id"), F.coalesce("lost", F.lit(False)).alias("lost"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv", "no_id")
    same = Window.partitionBy("conv", "no_id", "lost", "role", "text").orderBy("turn")
    fault = (
        F.when(last == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    )
    ordered = (
        dealt.withColumn("fault", fault)
        .sortWithinPartitions("conv", "no_id", "turn", "role", "text")
        .select("conv", "no_id", "lost", F.coalesce("turn", F.lit(0)).alias("at"), F.col("turn").isNull().alias("no_turn"), "role", "text", "fault")
    )
    return ship(ordered).mapInPandas(_repair_rows, _EDITS)


_SUMMARY = (
    "conv string, no_id boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Summary:
    """Counts and digests of one conversation, from its edits in order."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.before = None
        self.audit, self.said, self.digest = bytearray(), False, hashlib.sha256()

    def add(self, edit: str, role: str | None, text: str, turn: int | None, was: str | None, fault: str | None) -> None:
        self.audit += edit.encode()
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit in "KR" and fault == "truncated":
            self.cost += TRUNCATED
        if edit != "D":
            self.digest.update(f"{chr(10) if self.said else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.said = True
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + was[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = was[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def _summed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    now, summary = None, None
    for batch in batches:
        out = []
        columns = [batch[c].tolist() for c in ("conv", "no_id", "step", "edit", "role", "text", "turn", "was", "fault")]
        for conv, no_id, step, edit, role, text, turn, was, fault in zip(*columns, strict=True):
            if step < 0:
                if summary is not None:
                    out.append((*now, *summary.row()))
                now, summary = (conv, no_id), Summary()
            else:
                summary.add(edit, role, text, None if turn is None or turn == "" else int(turn), was, fault)
        yield pd.DataFrame(out, columns=names)
    if summary is not None:
        yield pd.DataFrame([(*now, *summary.row())], columns=names)


def summaries(done: DataFrame) -> DataFrame:
    """One row per conversation of ``edits`` (as they come from it, in order).

    gaps (numbers missing between the least and largest turn), rows per fault,
    illegal neighbours, cost, audit (the edits' initials) and the SHA-256 of
    the repaired ``role:text`` lines.
    """
    # A turn as text: a null among whole numbers would make them floats on the way.
    return done.withColumn("turn", F.coalesce(F.col("turn").cast("string"), F.lit(""))).mapInPandas(_summed, _SUMMARY)
