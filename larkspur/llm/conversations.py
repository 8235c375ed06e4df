"""Conversation structure repair: the cheapest edits that make a conversation's turns follow the grammar ``(s?(ua)+)?``.

A conversation is a row of turns; each turn has the first letter of its role and at most one fault. Nodes of the lattice
are (turns dealt with, state of the grammar); edges keep, rerole, delete or insert a turn at a cost. Dijkstra's algorithm
walks the lattice, which is never built, in the order of (cost, audit), where the audit is the edits' initials so far,
and stops at the first accepting node at the end that it pops. Each state lets only one role in for an edit, so an audit
names one path, and the order is that of the whole results: cheapest first, then least in ASCII.

Texts aren't needed for that: turns go to their conversation's task as a code of a byte, once faults are told in Spark, and
equal code sequences are repaired once. A second pass streams the texts behind their conversation's audit, so that a
conversation of any size needs a byte a turn and its audit, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import give_back, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Kinds of roles by their initials, kinds of faults, and the states of the grammar: from each, the next by kind.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, CUT, BLANK, DUPLICATE = range(4)
NEXT = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
ACCEPTING = (0, 3)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Turns of which audits are plain strings, and of which repairs are remembered.
SHORT, REMEMBERED = 1000, 64

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AUDITS = f"conv_id bigint, audit string, {', '.join(f'{c} bigint' for c in FIGURES)}"
REPAIRED = f"{AUDITS}, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, role string, text string"


class Edits:
    """A long audit: the letters on the way from the root of a tree. Compares in logarithmic time by jumps to ancestors."""

    __slots__ = ("depth", "jump", "letter", "parent")

    def __init__(self, parent: Edits | None = None, letter: str = ""):
        self.parent, self.letter = parent, letter
        self.depth = parent.depth + 1 if parent else 0
        if not parent:
            self.parent = self.jump = self
        else:
            far = parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def __add__(self, letter: str) -> Edits:
        return Edits(self, letter)

    def above(self, depth: int) -> Edits:
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.parent
        return at

    def __lt__(self, other: Edits) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.above(depth), other.above(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, at = [], self
        while at.depth:
            out.append(at.letter)
            at = at.parent
        return "".join(reversed(out))


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of turns, each 4 * kind of role + kind of fault."""
    n = len(codes)
    settled = bytearray(len(NEXT) * (n + 1))
    heap = [(0, "" if n <= SHORT else Edits(), 0, 0)]
    while True:
        cost, audit, at, state = heappop(heap)
        if settled[len(NEXT) * at + state]:
            continue
        settled[len(NEXT) * at + state] = 1
        if at == n and state in ACCEPTING:
            return cost, str(audit)
        if at < n:
            kind, fault = divmod(codes[at], 4)
            heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if fault in (FINE, CUT):
                own = cost + TRUNCATED * (fault == CUT)
                if kind in NEXT[state]:
                    heappush(heap, (own + KEEP, audit + "K", at + 1, NEXT[state][kind]))
                for role in ROLES:
                    if role in NEXT[state]:
                        heappush(heap, (own + REROLE, audit + "R", at + 1, NEXT[state][role]))
        for role in ROLES:
            if role in NEXT[state]:
                heappush(heap, (cost + INSERT, audit + "I", at, NEXT[state][role]))


def judged(codes: bytes) -> tuple[int, int, int, int, int, str]:
    """Blank, duplicate, truncated turns, illegal neighbours, cost and audit."""
    faults, kinds = [c % 4 for c in codes], [c // 4 for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(kinds[:-1], kinds[1:]))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, *cheapest(codes)


remembered = lru_cache(maxsize=20_000)(judged)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with damage by a hash of conv_id and turn, for tests of the repair: conv_id, turn, role, text, gone.

    Nulls count as one blank. Of twenty turns one each goes (``gone``; it stays as a row), loses its text, loses its
    sentence ends, comes twice, or becomes the user's.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    tagged = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), filled("role").alias("role"), filled("text").alias("text"),
        (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).alias("hit"),
    )
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return tagged.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"),
        F.explode(times).alias("copy"),
    ).drop("copy")


def with_digest(rows: DataFrame) -> DataFrame:
    """rows with a digest of role and text, which also orders turns of one number."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, code) of turns; a conversation of which all is gone has one row of a null code.

    Duplicates are numbered within (conversation, digest), so that a long conversation's turns spread over tasks.
    """
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = with_digest(rows.where("not gone")).select("conv_id", "turn", "digest", kind.alias("kind"), ends.alias("ends"))
    fault = F.when(F.col("ends") == "", BLANK).when(seen > 1, DUPLICATE).when(~F.col("ends").isin(".", "!", "?"), CUT).otherwise(FINE)
    there = slim.withColumn("fault", fault).select("conv_id", "turn", "digest", (F.col("kind") * 4 + F.col("fault")).cast("int").alias("code"))
    gone = rows.where("gone").select("conv_id").distinct()
    return there.unionByName(gone.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("int").alias("code")))


class Gathered:
    """What is known of a conversation while its turns stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, []
        self.first: int | None = None
        self.last: int | None = None
        self.distinct = 0

    def add(self, codes: np.ndarray, turns: np.ndarray) -> None:
        """codes of some turns, and their numbers that aren't null, in order."""
        self.codes.append(codes.tobytes())
        if len(turns):
            if self.first is None:
                self.first = int(turns[0])
            self.distinct += int((turns[1:] != turns[:-1]).sum()) + (self.last is None or int(turns[0]) != self.last)
            self.last = int(turns[-1])

    def result(self) -> tuple:
        codes = b"".join(self.codes)
        gaps = min(self.last - self.first + 1 - self.distinct, (1 << 63) - 1) if self.first is not None else 0
        blank, duplicate, truncated, illegal, cost, audit = (remembered if len(codes) <= REMEMBERED else judged)(codes)
        return self.conv_id, audit, gaps, blank, duplicate, truncated, illegal, cost


def runs_of(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of equal values, nulls among them, start and stop."""
    raw, null = values.fill_null(0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
    if not len(raw):
        return
    edges = np.flatnonzero((raw[1:] != raw[:-1]) | (null[1:] != null[:-1])) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(raw)])


def audits(rows: DataFrame) -> DataFrame:
    """AUDITS of conversations (conv_id, turn, role, text, gone), taken by turn, nulls first, ties by a digest of role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Gathered | None = None
        for batch in batches:
            out: list[tuple] = []
            ids, code, turn = batch.column("conv_id"), batch.column("code"), batch.column("turn")
            there = code.is_valid().to_numpy(zero_copy_only=False)
            codes = code.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint8)
            dated, turns = turn.is_valid().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in runs_of(ids):
                key = ids[i].as_py()
                if now is None or now.conv_id != key:
                    if now is not None:
                        out.append(now.result())
                    now = Gathered(key)
                own = slice(i, j)
                now.add(codes[own][there[own]], turns[own][dated[own]])
            yield as_batch(out, AUDIT_TYPES)
        if now is not None:
            yield as_batch([now.result()], AUDIT_TYPES)
        give_back()

    return coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").select("conv_id", "turn", "code").mapInArrow(run, AUDITS)


AUDIT_TYPES = [("conv_id", pa.int64()), ("audit", pa.string()), *[(c, pa.int64()) for c in FIGURES]]
REPAIRED_TYPES = [*AUDIT_TYPES, ("repaired_sha256", pa.string())]
TURN_TYPES = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def as_batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, (_, kind) in zip(columns, types)], names=[name for name, _ in types])


class Follower:
    """Applies an audit to a conversation's turns as they stream by; ``emit`` gets the role and text of each turn that is left."""

    def __init__(self, head: tuple, emit: Callable[[str, str], None]):
        self.head, self.audit, self.emit = head, head[1], emit
        self.at = self.state = 0

    def enter(self, kind: int, role: str, text: str) -> None:
        self.state = NEXT[self.state][kind]
        self.emit(role, text)

    def edited(self) -> int:
        """The one kind of role that an edit may give in this state."""
        return next(kind for kind in ROLES if kind in NEXT[self.state])

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            kind = self.edited()
            self.enter(kind, ROLES[kind], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.enter("sua".index(role[0]), role, text)
        elif edit == "R":
            kind = self.edited()
            self.enter(kind, ROLES[kind], text)


def followed(rows: DataFrame, found: DataFrame, start: Callable[[tuple], tuple[Callable, Callable]], types: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Streams each conversation's turns behind its AUDITS row.

    start(head) gives what gets each turn that is left, and what is asked for rows once a batch or conversation is through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Follower | None = None
        rows_of: Callable[[bool], list[tuple]] | None = None
        for batch in batches:
            out: list[tuple] = []
            heads = batch.column("head").to_pylist()
            for key, head, role, text in zip(batch.column("conv_id").to_pylist(), heads, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if head is None:
                    now.turn(role, text)
                    continue
                if now is not None:
                    now.inserts()
                    out += rows_of(True)
                top = (key, text, *head)
                emit, rows_of = start(top)
                now = Follower(top, emit)
            if now is not None:
                out += rows_of(False)
            yield as_batch(out, types)
        if now is not None:
            now.inserts()
            yield as_batch(rows_of(True), types)
        give_back()

    heads = found.select(
        "conv_id", F.array(*FIGURES).alias("head"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"),
        F.col("audit").alias("text"),
    )
    turns = with_digest(rows.where("not gone")).select("conv_id", F.lit(None).cast("array<bigint>").alias("head"), "turn", "digest", "role", "text")
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "digest")
    return both.select("conv_id", "head", "role", "text").mapInArrow(run, schema)


def digest_of(head: tuple) -> tuple[Callable, Callable]:
    """Hashes the turns that are left, ``role:text`` joined by newlines."""
    hashed, first = hashlib.sha256(), True

    def emit(role: str, text: str) -> None:
        nonlocal first
        hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False

    return emit, lambda over: [(*head, hashed.hexdigest())] if over else []


def turns_of(head: tuple) -> tuple[Callable, Callable]:
    """Gives the turns that are left as rows, a batch at a time."""
    held: list[tuple] = []
    n = 0

    def emit(role: str, text: str) -> None:
        nonlocal n
        held.append((head[0], n, role, text))
        n += 1

    def rows(over: bool) -> list[tuple]:
        out = held.copy()
        held.clear()
        return out

    return emit, rows


def kept(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, none of them gone; null roles and texts are one blank."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), filled("role"), filled("text"), F.lit(False).alias("gone"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place, role, text. A conversation of which nothing is left has no rows."""
    whole = kept(rows)
    return followed(whole, materialize(audits(whole), "audits"), turns_of, TURN_TYPES, TURNS)


def repair_table(rows: DataFrame) -> DataFrame:
    """A row for each conversation of damage() or kept() rows: gaps, faults, cost, audit and the digest of what is repaired.

    Turns are taken by number, nulls first; turns of one number in the order of a digest of role and text. A turn's first fault
    counts: blank, duplicate (role and text seen earlier), truncated. gaps are the numbers that are missing between the
    least and the greatest, nulls apart. A null conv_id is a conversation like others; one of which all turns are gone has
    zeros, an empty audit and the digest of nothing. An empty table gives an empty result; further columns are left out.
    """
    found = materialize(audits(rows), "audits")
    return followed(rows, found, digest_of, REPAIRED_TYPES, REPAIRED).select("conv_id", *FIGURES, "audit", "repaired_sha256")
