"""Conversation structure repair: the cheapest edits that give a conversation a legal sequence of roles.

Legal role initials are ``(s?(ua)+)?``. The edits of a conversation of n rows are
the paths through a lattice of nodes (rows read, state of the grammar), which
is never laid out: Dijkstra's search makes a node's edges when the node is
popped, in the order of (cost, audit), and stops at the first popped node at
the end that the grammar accepts. An audit is a persistent path with jump
pointers, so a heap entry takes constant room and two audits are compared in
logarithmic time, however long the conversation.

A row travels as two records of one sorted shuffle: a light one (turn, role
initial, faults, digest) and a heavy one (role, text). The light records of a
conversation come first, so that its edits are known when the texts stream by;
a task holds some bytes for each row of one conversation and never its texts.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Costs of the edits, and the states of the grammar (0 nothing, 1 s, 2 u, 3 a) by role initial.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
#: The one role that can be inserted or given in each state.
ROLE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
SPACE = " \t\n\x0b\f\r"

_FIELDS = [("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
_DDL = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _FIELDS)


class Audit:
    """A string of edits that shares its beginning with others; compared as strings are."""

    __slots__ = ("letter", "parent", "depth", "jump")

    def __init__(self, letter: str = "", parent: Audit | None = None):
        self.letter, self.parent = letter, parent
        if parent is None:
            self.depth, self.jump = 0, self
            return
        self.depth, far = parent.depth + 1, parent.jump
        self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def _up(self, depth: int) -> Audit:
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.parent
        return x

    def __lt__(self, other: Audit) -> bool:
        a, b = self._up(other.depth), other._up(self.depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, x = [], self
        while x.parent is not None:
            out.append(x.letter)
            x = x.parent
        return "".join(reversed(out))


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) for rows of these role initials (one character each) and faults: ``b`` blank, ``d`` duplicate, ``t`` truncated, ``-`` none.

    K keeps a row, R gives it another role, D deletes it, I inserts one. In
    every state each letter leads to one node at most, so an audit names one path; of equal
    cost, two audits at one node never continue each other, so the least can be settled.
    """
    n, done = len(initials), set()
    heap = [(0, Audit(), 0, 0)]
    while True:
        cost, audit, i, q = heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and q in ACCEPT:
            return cost, str(audit)
        given = NEXT[q, ROLE[q]]
        steps = [(INSERT, "I", i, given)]
        if i < n:
            steps.append((DELETE, "D", i + 1, q))
            if faults[i] not in "bd":
                more = TRUNCATED * (faults[i] == "t")
                steps.append((RETYPE + more, "R", i + 1, given))
                if (q, initials[i]) in NEXT:
                    steps.append((more, "K", i + 1, NEXT[q, initials[i]]))
        for price, letter, j, p in steps:
            if (j, p) not in done:
                heappush(heap, (cost + price, Audit(letter, audit), j, p))


class _Conversation:
    """One conversation's light records, then its edits, then the digest of what they leave."""

    def __init__(self, conv: int | None):
        self.conv, self.seen, self.initials, self.faults = conv, set(), [], []
        self.low = self.high = self.prev = None
        self.turns = self.illegal = 0
        self.edits, self.state, self.sha, self.lines = None, 0, hashlib.sha256(), 0

    def light(self, turn, initial, blank, truncated, digest) -> None:
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.prev is not None and self.prev + initial not in LEGAL:
            self.illegal += 1
        self.faults.append("b" if blank else "d" if digest in self.seen else "t" if truncated else "-")
        self.seen.add(digest)
        self.initials.append(initial or " ")
        self.prev = initial

    def _line(self, role: str, text: bytes) -> None:
        self.sha.update((b"\n" if self.lines else b"") + role.encode() + b":")
        self.sha.update(text)
        self.lines += 1

    def _solve(self) -> None:
        self.seen = set()
        self.cost, self.audit = cheapest("".join(self.initials), "".join(self.faults))
        self.edits, self.at = self.audit, 0

    def _inserts(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._line(NAMES[ROLE[self.state]], b"")
            self.state = NEXT[self.state, ROLE[self.state]]
            self.at += 1

    def heavy(self, role: str, text: bytes) -> None:
        if self.edits is None:
            self._solve()
        self._inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            return
        kind = role[:1] if edit == "K" else ROLE[self.state]
        self._line(role if edit == "K" else NAMES[kind], text)
        self.state = NEXT[self.state, kind]

    def result(self) -> tuple:
        if self.edits is None:
            self._solve()
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *[self.faults.count(x) for x in "bdt"], self.illegal, self.cost, self.audit, self.sha.hexdigest())


def _rows(batches):
    now, out = None, []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*out), _FIELDS)], names=[n for n, _ in _FIELDS])
        out.clear()
        return batch

    for b in batches:
        for conv, phase, turn, initial, blank, truncated, digest, role, text in zip(*[c.to_pylist() for c in b.columns]):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(conv)
            if phase == 1:
                now.light(turn, initial, blank, truncated, digest)
            elif phase == 2:
                now.heavy(role, text)
        if len(out) >= 1000:
            yield flush()
    if now is not None:
        out.append(now.result())
    if out:
        yield flush()


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with one fault in about a quarter of them, drawn by crc32 of ``conv:turn``.

    ``copies`` is 0 for a dropped row and 2 for a repeated one. Nulls of role and
    text, and of the ids in the draw, count as one space.
    """
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20
    out = conversations.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), fault.alias("fault"))
    return out.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired conversation, for each ``conv_id`` of (conv_id, turn, role, text, copies).

    A null id is a conversation of its own. Rows go by turn, nulls first; rows of one
    turn by a digest of role and text, so repeated rows stand together. Null roles
    and texts count as one space; an empty or blank text is the fault ``blank``; a role
    whose initial is not s, u or a cannot be kept. A conversation whose rows all
    have no copies gives zeros and the digest of nothing. Texts of any length stream
    through. No rows give no result. Other columns are not read.

    A conversation is one unit: its audit and its digest are sequential results. Tasks
    hold many conversations and, of one, a few bytes a row.
    """
    common.small_batches(rows.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.col("copies").cast("int").alias("copies"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    marked = plain.select("*", digest.alias("digest"), F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?") & (end != "")).alias("truncated"))
    lone = F.when(F.col("copies") == 0, F.array(F.lit(0))).otherwise(F.array_repeat(F.lit(1), F.col("copies")))
    record = marked.select("*", F.explode(F.concat(lone, F.array_repeat(F.lit(2), F.col("copies")))).alias("phase"))
    light = F.col("phase") == 1
    # the digest orders both records of a row; only the light one is asked for it
    sent = record.select("conv_id", "phase", "turn", *[F.when(light, F.col(c)).alias(c) for c in ("initial", "blank", "truncated")], "digest", *[F.when(F.col("phase") == 2, c).alias(n) for c, n in ((F.col("role"), "role"), (F.col("text").cast("binary"), "text"))])
    dealt = sent.repartition(common.buckets(rows, 64 << 20), "conv_id").sortWithinPartitions("conv_id", "phase", "turn", "digest")
    return dealt.mapInArrow(_rows, _DDL)
