"""Repair of the structure of conversations: an optional system turn, then user and assistant in turn.

Rows are dealt by conversation and sorted by turn. Each conversation comes twice in its task's stream: first as narrow
rows without text, over which a shortest-path automaton runs, then with the texts, to which the cheapest
edits are applied. The automaton keeps four states (nothing yet, after system, after user, after assistant) with
their costs and the order of their edit strings, so ties are decided without comparing strings; what it
has chosen for each row and state goes into four bytes a row. These back pointers leave memory for a file of
the task beyond a limit, and texts are hashed as they pass, so a conversation of any length needs little memory.

Whether role and text were seen earlier is told by a grouping with partial sums, whose keys go back to the rows by an
equi join on conversation, role, text and turn: no row has to wait for its whole conversation there.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import importable

BLANKS = " \t\n\x0b\f\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: States, and what each role initial leads to. The empty conversation and one that ends after an assistant are whole.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = {(EMPTY, "s"): SYSTEM} | {(s, "u"): USER for s in (EMPTY, SYSTEM, ASSISTANT)} | {(USER, "a"): ASSISTANT}
WHOLE = (EMPTY, ASSISTANT)
#: A state whose cost exceeds the least one by more can't win: from any state every end costs at most 5 more than
#: from any other (two inserts, or one insert and one deletion, bring the states together).
HOPELESS = 5
#: Role initials that the automaton tells apart; all others are alike.
ROLES = "sua"
#: What a row is. Blank and repeated rows must be deleted.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Bytes of back pointers that a conversation holds in memory.
HELD = 1 << 22
LEAD = 64

RESULT = (
    "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _insertions(state: int) -> list[tuple[int, str]]:
    """States that inserts reach from a state, with the roles inserted."""
    found, roles = [(state, "")], ""
    for _ in range(2):
        role = "a" if state == USER else "u"
        state, roles = NEXT[state, role], roles + role
        found.append((state, roles))
    return found


def _row_moves(state: int, role: str, fault: int) -> list[tuple[int, int, str, str]]:
    """(new state, cost, edits, roles of the rows written) of all ways to pass one row from a state."""
    moves = []
    for after, roles in _insertions(state):
        cost, edits = INSERT * len(roles), "I" * len(roles)
        moves.append((after, cost + DELETE, edits + "D", roles))
        if fault in (BLANK, DUPLICATE):
            continue
        cost += UNFINISHED if fault == TRUNCATED else 0
        if (after, role) in NEXT:
            moves.append((NEXT[after, role], cost + KEEP, edits + "K", roles + role))
        changed = "a" if after == USER else "u"
        moves.append((NEXT[after, changed], cost + REROLE, edits + "R", roles + changed))
    return moves


#: Every move has a number, so a back pointer is the state before and that number: below 4 * 16.
EDITS = sorted({(e, w) for s in range(STATES) for r in (*ROLES, "?") for f in range(4) for _, _, e, w in _row_moves(s, r, f)})
NUMBER = {move: i for i, move in enumerate(EDITS)}
NONE = 255
assert STATES * len(EDITS) < NONE


class Automaton:
    """Cheapest edits so far for each state; `step` is remembered for each situation that occurs.

    A situation is the states' costs above the least one and the order of their edit strings. Edit strings of
    different states always differ before either one ends, as all end with an edit of the same row: so their
    order is settled by the order of the strings before, or by the edits added to the same string.
    """

    def __init__(self) -> None:
        self.memory: dict = {}

    @staticmethod
    def begin() -> tuple:
        return ((0, 0), None, None, None)

    def step(self, situation: tuple, role: str, fault: int) -> tuple[tuple, int, bytes]:
        """New situation, what the least cost has grown by, and a back pointer for each state."""
        key = situation, role, fault
        if key not in self.memory:
            self.memory[key] = self._step(*key)
        return self.memory[key]

    @staticmethod
    def _step(situation: tuple, role: str, fault: int) -> tuple[tuple, int, bytes]:
        best: list = [None] * STATES
        for state, held in enumerate(situation):
            if held is None:
                continue
            cost, rank = held
            for after, more, edits, written in _row_moves(state, role, fault):
                offer = (cost + more, rank, edits, state, written)
                if best[after] is None or offer < best[after]:
                    best[after] = offer
        least = min(b[0] for b in best if b is not None)
        best = [b if b is not None and b[0] <= least + HOPELESS else None for b in best]
        strings = sorted((b[1], b[2]) for b in best if b is not None)
        now = tuple(None if b is None else (b[0] - least, strings.index((b[1], b[2]))) for b in best)
        pointers = bytes(NONE if b is None else b[3] * len(EDITS) + NUMBER[b[2], b[4]] for b in best)
        return now, least, pointers

    @staticmethod
    def end(situation: tuple) -> tuple[int, int, str]:
        """State that the cheapest whole conversation ends from, its cost above the least, and the roles inserted."""
        offers = []
        for state, held in enumerate(situation):
            if held is not None:
                for after, roles in _insertions(state):
                    if after in WHOLE:
                        offers.append((held[0] + INSERT * len(roles), held[1], "I" * len(roles), state, roles))
        cost, _, _, state, roles = min(offers)
        return state, cost, roles


class _Pointers:
    """Bytes that are added in order and read backwards, in memory up to a limit, then in a file of this task."""

    def __init__(self, held: int) -> None:
        self.held, self.memory, self.file = held, bytearray(), None

    def add(self, pointers: bytes) -> None:
        self.memory += pointers
        if len(self.memory) >= self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.file.write(self.memory)
            self.memory.clear()

    def backwards(self) -> Iterator[bytes]:
        """The pointers in stretches, last one first."""
        yield bytes(self.memory)
        if self.file is not None:
            left = self.file.seek(0, 2)
            while left:
                take = min(left, self.held // STATES * STATES)
                left -= take
                self.file.seek(left)
                yield self.file.read(take)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Conversation:
    """One conversation while it passes: counts and back pointers first, then the repaired text."""

    def __init__(self, conv_id, automaton: Automaton, held: int) -> None:
        self.conv_id, self.automaton, self.held = conv_id, automaton, held
        self.low = self.high = self.turn = None
        self.distinct = self.rows = self.illegal = self.cost = 0
        self.faults = [0] * 4
        self.before, self.previous = "", None
        self.situation, self.pointers, self.choices = Automaton.begin(), _Pointers(held), None
        self.hash, self.wrote = hashlib.sha256(), False

    def narrow(self, turn: int | None, initial: str, fault: int, first: bool, identity: tuple) -> None:
        """A row without text; `first`: at this turn role and text occur for the first time."""
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += self.turn != turn
            self.high = self.turn = turn
        if fault != BLANK and (not first or identity == self.previous):
            fault = DUPLICATE
        self.previous = identity
        self.faults[fault] += 1
        if self.rows:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.rows += 1
        self.situation, more, pointers = self.automaton.step(self.situation, initial if initial in ROLES and initial else "?", fault)
        self.cost += more
        self.pointers.add(pointers)

    def settle(self) -> None:
        """Trace the cheapest edits back, one byte a row, last row first; they are then read from behind."""
        if self.choices is not None:
            return
        state, more, self.tail = Automaton.end(self.situation)
        self.cost += more
        self.choices = _Pointers(self.held)
        for stretch in self.pointers.backwards():
            back = bytearray()
            for at in range(len(stretch) - STATES, -1, -STATES):
                state, number = divmod(stretch[at + state], len(EDITS))
                back.append(number)
            for at in range(0, len(back), self.held // STATES * STATES):
                self.choices.add(bytes(back[at : at + self.held // STATES * STATES]))
        self.pointers.close()
        self.forwards = self._forwards()
        self.audit: list[str] = []

    def _forwards(self) -> Iterator[int]:
        for stretch in self.choices.backwards():
            yield from reversed(stretch)

    def full(self, role: str, text: str) -> None:
        """A row with its text, in the same order as before."""
        self.settle()
        edits, written = EDITS[next(self.forwards)]
        self.audit.append(edits)
        inserted = edits.count("I")
        for r in written[:inserted]:
            self._write("user" if r == "u" else "assistant", "")
        if edits[-1] == "K":
            self._write(role, text)
        elif edits[-1] == "R":
            self._write("user" if written[-1] == "u" else "assistant", text)

    def _write(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.wrote else "").encode() + f"{role}:{text}".encode())
        self.wrote = True

    def result(self) -> tuple:
        self.settle()
        for r in self.tail:
            self._write("user" if r == "u" else "assistant", "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        audit = "".join(self.audit) + "I" * len(self.tail)
        self.choices.close()
        return (
            self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
            self.cost, audit, self.hash.hexdigest(),
        )


def _stream(held: int):
    """Function for mapInPandas that carries a conversation on from batch to batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, current = Automaton(), None
        names = [part.split()[0] for part in RESULT.split(", ")]
        for batch in batches:
            done = []
            columns = ("conv_id", "phase", "known", "turn", "role", "digest", "fault", "first", "text")
            for conv_id, phase, known, turn, role, digest, fault, first, text in zip(*(batch[c].tolist() for c in columns)):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.result())
                    current = _Conversation(conv_id, automaton, held)
                if phase == 1:
                    current.narrow(turn if known else None, role[:1], fault, first, (known, turn, role, digest))
                elif phase == 2:
                    current.full(role, text)
            if done:
                yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([current.result()], columns=names)

    return run


def damage_turns(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with the damage that the CRC-32 of `conv_id:turn` does to a row.

    0 drops the row (`gone` is true then), 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes it
    the user's. Nulls are one space, but for the id and the turn, which stay null in the result.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"))
    key = F.concat(shown("conv_id"), F.lit(":"), shown("turn"))
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, 2).otherwise(1)
    changed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("n"), (F.col("harm") == 0).alias("gone"))
    return changed.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("n")


def repair_turns(rows: DataFrame, held: int = HELD) -> DataFrame:
    """One row per conversation: faults of its rows, the cheapest edits and the repaired conversation's digest.

    `rows` has conv_id, turn, role, text, and `gone` for rows that only say that a conversation exists; other columns
    are not read. Rows are taken by turn (nulls first), then role, the first 64 characters of the text, and its digest.
    Rows equal in all of these are copies: the first stays, others are duplicates. Null roles and texts are one space. A
    null id is a conversation like others. An empty table gives no row.
    """
    spark = rows.sparkSession
    importable(spark)
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    full = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "gone",
        F.substring(text, 1, LEAD).alias("lead"), F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    last = F.substring(ended, -1, 1)
    fault = F.when(ended == "", BLANK).when(~last.isin(*STOPS), TRUNCATED).otherwise(FINE)
    narrow = full.withColumn("fault", fault).drop("text")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    there = narrow.filter(~F.col("gone"))
    firsts = there.filter(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("place"))
    firsts = firsts.select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("place.turn").alias("t")
    )
    same = (
        (there["role"] == firsts["r"]) & (there["digest"] == firsts["d"])
        & there["conv_id"].eqNullSafe(firsts["c"]) & there["turn"].eqNullSafe(firsts["t"])
    )
    marked = there.join(firsts, same, "left").withColumn("first", F.col("r").isNotNull()).drop("c", "r", "d", "t")
    empty = F.lit(None).cast("string")
    columns = ("conv_id", "phase", "known", "turn", "role", "lead", "digest", "fault", "first", "text")
    parts = [
        narrow.filter("gone").withColumns({"phase": F.lit(0), "first": F.lit(False), "text": empty}),
        marked.withColumns({"phase": F.lit(1), "text": empty}),
        full.filter(~F.col("gone")).withColumns({"phase": F.lit(2), "fault": F.lit(FINE), "first": F.lit(False)}),
    ]
    every = None
    for part in parts:
        # pandas would make numbers with nulls among them floating ones
        plain = {"conv_id": F.col("conv_id").cast("string"), "known": F.col("turn").isNotNull(), "turn": F.coalesce("turn", F.lit(0))}
        part = part.withColumns(plain).select(*columns)
        every = part if every is None else every.unionByName(part)
    dealt = every.repartition("conv_id").sortWithinPartitions(
        "conv_id", "phase", "known", "turn", "role", "lead", "digest"
    )
    found = dealt.mapInPandas(_stream(held), RESULT)
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
