"""Conversation repair: the cheapest edits that give a conversation a well-formed structure.

Roles have to read ``(s?(ua)+)?`` by their initials. Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert of an
empty user or assistant turn 2; a truncated row that stays adds 1; blank and duplicate rows have to go. Among the cheapest
edits the ASCII-least audit (the edits' initials in order) wins.

A run of rows is searched depth first by branch and bound: an explicit stack, a suffix lower bound for every node (row,
state), the incumbent (cost, audit), and a table of the least cost that has reached a node. Prefixes come in ASCII order of
their edits, so one that reaches a node at no lower cost is dominated. Search ends when no open prefix can beat
the incumbent, which proves it optimal.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation that holds a third of all rows lies in many tasks.
Each task cuts it into segments of bounded size and solves a segment for every pair of states at its ends; the cheapest
chain of segments is then the conversation's repair. Only the digest of a repaired text is sequential: the task that
computes it streams the rows. Duplicates are found by digests, so texts are shuffled twice: to count equal rows
before anything else, and into their order.
"""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: States by what came last: nothing, s, u, a. What may follow, and in which states a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
RENAME, REMOVE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows and characters of a segment at most (one row at least).
ROWS, CHARS = 512, 2_000_000
SPACE = " \t\n\x0b\x0c\r"
PREFIX = 32


def edits(rows: list, i: int, state: int):
    """(initials, next row, next state, cost) of every edit at a node; a row is (initial, truncated) or a number of rows that have to go."""
    yield "I", i, NEXT[state], INSERT
    if i == len(rows):
        return
    if isinstance(rows[i], int):
        yield "D" * rows[i], i + 1, state, REMOVE * rows[i]
        return
    initial, truncated = rows[i]
    yield "D", i + 1, state, REMOVE
    yield "R", i + 1, NEXT[state], RENAME + TRUNCATED * truncated
    if (state, initial) in FOLLOWS:
        yield "K", i + 1, FOLLOWS[state, initial], TRUNCATED * truncated


def suffix_bounds(rows: list, ends) -> list[list[float]]:
    """For every row and state: no completion that ends in ``ends`` costs less."""
    bounds = [[math.inf] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        here = bounds[i]
        for s in STATES:
            ahead = [c + bounds[j][t] for _, j, t, c in edits(rows, i, s) if j > i]
            here[s] = min(ahead, default=0 if s in ends else math.inf)
        for _ in STATES:  # inserts stay at the row
            for s in STATES:
                here[s] = min(here[s], INSERT + here[NEXT[s]])
    return bounds


def cheapest(rows: list, start: int, ends, bounds=None) -> tuple[int, str] | None:
    """(cost, audit) of the best edits of ``rows`` from ``start`` to one of ``ends``, by branch and bound."""
    bounds = bounds or suffix_bounds(rows, ends)
    incumbent, reached, path = None, {}, []
    stack = [(0, start, 0, 0, "")]
    while stack:
        i, state, cost, depth, edit = stack.pop()
        if cost + bounds[i][state] > (incumbent[0] if incumbent else math.inf) or bounds[i][state] == math.inf:
            continue
        if reached.get((i, state), math.inf) <= cost:
            continue  # dominated: an ASCII-smaller prefix has reached this node at no higher cost
        reached[i, state] = cost
        path[depth:] = [edit]
        if i == len(rows) and state in ends:
            found = cost, "".join(path)
            incumbent = min(incumbent, found) if incumbent else found
        options = [(cost + c + bounds[j][t], e, j, t, cost + c) for e, j, t, c in edits(rows, i, state)]
        for _, e, j, t, c in sorted(options, reverse=True):  # the most promising is popped first, ties by their initials
            stack.append((j, t, c, depth + 1, e))
    return incumbent


class Rewriter:
    """The digest of a repaired conversation, whose rows come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, START, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * bool(self.lines) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self._line(NAMES[self.state], "")

    def add(self, role: str, text: str, copies: int) -> None:
        self._inserts()
        edit = self.audit[self.at]
        if edit != "D":
            self.state = FOLLOWS[self.state, role[:1]] if edit == "K" else NEXT[self.state]
            self._line(role if edit == "K" else NAMES[self.state], text)
        self.at += copies  # only the first copy of a row can stay

    def close(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


class Counts:
    """What is counted over rows in order, and how two neighbouring runs add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "first", "last")

    def __init__(self, values=(0, 0, 0, 0, None, None, 0, None, None)):
        for k, v in zip(self.FIELDS, values):
            setattr(self, k, v)

    def values(self) -> tuple:
        return tuple(getattr(self, k) for k in self.FIELDS)

    def add(self, more: Counts) -> None:
        for k in ("blank", "duplicate", "truncated"):
            setattr(self, k, getattr(self, k) + getattr(more, k))
        self.illegal += more.illegal + (None not in (self.last, more.first) and (self.last, more.first) not in LEGAL)
        self.turns += more.turns - (self.high is not None and self.high == more.low)
        self.low = more.low if self.low is None else self.low
        self.high = self.high if more.high is None else more.high
        self.first = more.first if self.first is None else self.first
        self.last = self.last if more.last is None else more.last

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)


class Segment:
    """Rows of one conversation in order."""

    def __init__(self):
        self.counts, self.rows, self.lines, self.chars = Counts(), [], [], 0

    def add(self, turn, role: str, text: str, copies: int, fault: str, seen: bool) -> None:
        initial = role[:1]
        one = Counts((0, 0, 0, (copies - 1), turn, turn, int(turn is not None), initial, initial))
        if fault == "blank":
            one.blank, gone = copies, copies
        else:
            one.duplicate, gone = copies - (not seen), copies - (not seen)
            one.truncated = int(not seen and fault == "truncated")
        self.counts.add(one)
        if gone < copies:
            self.rows.append((initial, fault == "truncated"))
        if gone:
            self.rows.append(gone)
        self.lines.append((role, text, copies))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.lines) >= ROWS or self.chars >= CHARS

    def result(self, conv) -> dict:
        """Of a segment that is a whole conversation."""
        cost, audit = cheapest(self.rows, START, ENDS)
        text = Rewriter(audit)
        for line in self.lines:
            text.add(*line)
        return _result(conv, self.counts, cost, text)

    def paths(self) -> list:
        """[start, end, cost, audit] for every pair of states."""
        out = []
        for end in STATES:
            bounds = suffix_bounds(self.rows, (end,))
            for start in STATES:
                best = cheapest(self.rows, start, (end,), bounds)
                if best:
                    out.append([start, end, *best])
        return out


def chained(best: dict, paths: list) -> dict:
    """The best (cost, audit) by state after one more segment."""
    out = {}
    for start, end, cost, audit in paths:
        if start in best:
            way = best[start][0] + cost, best[start][1] + audit
            out[end] = min(out.get(end, way), way)
    return out


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
#: Results (kind 0), and of conversations that may go on in other tasks their segments (1) and rows (2), in order.
_PASS = pa.schema([("kind", pa.int32()), *_RESULT, ("task", pa.int64()), ("seq", pa.int64()), ("segment", pa.string()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())])
PASS = f"kind int, {RESULT}, task long, seq long, segment string, role string, text string, copies long"


def _result(conv, counts: Counts, cost: int, text: Rewriter) -> dict:
    out = {k: getattr(counts, k) for k in ("blank", "duplicate", "truncated", "illegal")}
    return out | {"conv_id": conv, "gaps": counts.gaps(), "cost": cost, "audit": text.audit, "repaired_sha256": text.close()}


def _batches(rows, schema: pa.Schema, most: int = 2_000_000, count: int = 5_000):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("text") or "") + len(r.get("segment") or "") + len(r.get("audit") or "") + 64
        if size > most or len(held) >= count:
            yield from pa.Table.from_pylist(held, schema=schema).to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_pylist(held, schema=schema).to_batches()


def _first_pass(batches):
    """Over rows in their order: results of conversations that lie in this task, segments and rows of the others.

    A task's first and last conversation may go on in its neighbours, and one longer than a segment isn't held.
    """
    task, seq = TaskContext.get().partitionId(), 0

    def opened(conv, segment):
        nonlocal seq
        yield {"kind": 1, "conv_id": conv, "task": task, "seq": seq, "segment": json.dumps([segment.counts.values(), segment.paths()])}
        for role, text, copies in segment.lines:
            seq += 1
            yield {"kind": 2, "conv_id": conv, "task": task, "seq": seq, "role": role, "text": text, "copies": copies}

    def rows():
        current, segment, whole, seen = None, None, False, False
        for b in batches:
            for conv, what, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in b.columns)):
                if segment is None or conv != current:
                    if segment is not None:
                        if whole:
                            yield segment.result(current) | {"kind": 0}
                        else:
                            yield from opened(current, segment)
                    whole, current, segment = segment is not None, conv, Segment()
                elif segment.full():
                    yield from opened(current, segment)
                    whole, segment = False, Segment()
                if what == 1:
                    seen = True
                elif what == 2:
                    segment.add(turn, role, text, copies, fault, seen)
                    seen = False
        if segment is not None:
            yield from opened(current, segment)

    yield from _batches(rows(), _PASS)


class Chain:
    """A conversation in segments: first these, then its rows."""

    def __init__(self):
        self.counts, self.best, self.text, self.cost = Counts(), {START: (0, "")}, None, 0

    def segment(self, counts: list, paths: list) -> None:
        self.counts.add(Counts(counts))
        self.best = chained(self.best, paths)

    def rewriter(self) -> Rewriter:
        if self.text is None:
            self.cost, audit = min(self.best[s] for s in ENDS if s in self.best)
            self.text = Rewriter(audit)
        return self.text

    def result(self, conv) -> dict:
        text = self.rewriter()
        return _result(conv, self.counts, self.cost, text)


def _second_pass(batches):
    """Over the segments and then the rows of each conversation, in order: its result."""

    def rows():
        current, chain = None, None
        for b in batches:
            for conv, kind, segment, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if chain is None or conv != current:
                    if chain is not None:
                        yield chain.result(current)
                    current, chain = conv, Chain()
                if kind == 1:
                    chain.segment(*json.loads(segment))
                else:
                    chain.rewriter().add(role, text, copies)
        if chain is not None:
            yield chain.result(current)

    yield from _batches(rows(), _RESULT)


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: counts, cost, audit and repaired_sha256 of its ``rows``.

    ``rows`` (conv_id, turn, role, text, copies): a row stands for that many adjacent equal ones. Rows are taken by turn,
    nulls first; equal turns by role, then by the first 32 characters, then by a digest. Rows without conv_id are one conversation.
    A null role or text counts as one space. Without rows: zeros, an empty audit, the digest of nothing. A gap
    count beyond a long is its end.
    """
    ship(rows.sparkSession)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.col("copies").cast("long"))
    # equal rows first become one row, so that none of them is too frequent for a task
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)).withColumn("prefix", F.substring("text", 1, PREFIX))
    rows = cut(rows, "conversation_rows")
    key = ["conv_id", "turn", "role", "prefix", "digest"]
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    earliest = rows.groupBy("conv_id", "digest").agg(F.min(at).alias("earliest"), F.count("*").alias("turns")).where("turns > 1")
    r, e = rows.select(*key).alias("r"), earliest.alias("e")
    again = r.join(e, F.col("r.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("r.digest") == F.col("e.digest"))).where(F.struct(F.col("r.turn").isNotNull(), F.col("r.turn")) != F.col("earliest"))
    nothing = lambda kind: F.lit(None).cast(kind)
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "").otherwise("truncated")
    seconds = again.select(*[F.col(f"r.{k}") for k in key], F.lit(1).alias("what"), nothing("string").alias("text"), nothing("long").alias("copies"), nothing("string").alias("fault"))
    heads = conversations.select(F.col("conv_id").cast("long")).distinct().select(
        "conv_id", nothing("long").alias("turn"), *[nothing("string").alias(k) for k in key[2:]], F.lit(0).alias("what"), nothing("string").alias("text"), nothing("long").alias("copies"), nothing("string").alias("fault")
    )
    # a conversation's head, then before each row that repeats an earlier one a note of that, then the row
    every = heads.unionByName(seconds).unionByName(rows.select(*key, F.lit(2).alias("what"), "text", "copies", fault.alias("fault")))
    ordered = every.repartitionByRange(*key).sortWithinPartitions(*key, "what").select("conv_id", "what", "turn", "role", "text", "copies", "fault")
    solved = cut(ordered.mapInArrow(_first_pass, PASS), "conversations")
    columns = _RESULT.names
    parts = solved.where("kind > 0").repartition("conv_id").sortWithinPartitions("conv_id", "kind", "task", "seq")
    rest = parts.select("conv_id", "kind", "segment", "role", "text", "copies").mapInArrow(_second_pass, RESULT)
    return solved.where("kind = 0").select(*columns).unionByName(rest)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32 of ``conv_id:turn`` (null: one space) modulo 20: rows of (conv_id, turn, role, text, copies)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damage(rows), rows)
