"""Conversation structure repair by A* on the edit lattice.

A node is (rows consumed, state of the role grammar); an edge keeps, reroles or
deletes the next row, or inserts an empty turn. Role initials of the result match
(s?(ua)+)?. The queue is keyed (cost + heuristic, audit), the audit being the
initials of the edits so far: D, I, K, R. The heuristic is the sum over the rows to
come of what no repair avoids, 4 for a row that must go and 3 for a truncated one.
It never overestimates and falls by no more than an edge costs, so the first pop of
a node has its least cost, and of equal ones its ASCII-least audit.

A long conversation is searched in parts of PART rows, from the best ways to each
state at the part's beginning to those at its end; ways that another state's beats
whatever follows are dropped, and what the rest have in common is settled. Audits that end at one row are never beginnings of each other, so
the order of those at the part's beginning decides ties. Memory is thus that of a few
parts and 16 bytes a row for the texts seen, not that of the conversation.

Spark deals the rows by conversation and sorts them; a task goes through one after another.

Defined cases: null roles and texts are one space; rows come by turn (nulls first),
then role, then text; a row without conversation id is a conversation of its own, so
such rows never meet in one task; a repeated row is a duplicate; a role other than the
three can't be kept; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

#: Costs of edits, and white space.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: The grammar (s?(ua)+)?: state 0 at the beginning, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}  # what rerole and insert can give
ACCEPTS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: By (p, q), what it costs at most to do from state p whatever can be done from q: inserts, and deleting a kept s.
INSTEAD = {(0, 1): 0, (0, 2): 3, (0, 3): 0, (1, 0): 6, (1, 2): 3, (1, 3): 6, (2, 0): 7, (2, 1): 3, (2, 3): 3, (3, 0): 4, (3, 1): 0, (3, 2): 3}
FINE, CUT, GONE = 0, 1, 2
PART = 512


def edits(state: int, initial: str, kind: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of each way to consume a row."""
    out = [("D", DELETE, state)]
    if kind != GONE:
        more = CUT_OFF if kind == CUT else 0
        if (state, initial) in NEXT:
            out.append(("K", more, NEXT[state, initial]))
        out.append(("R", REROLE + more, NEXT[state, WANTED[state]]))
    return out


def search(starts: dict[int, tuple[int, int]], rows: list[tuple[str, int]], last: bool) -> dict[int, tuple[int, int, str]]:
    """The best ways through rows (initial, kind), from states with (cost, rank of the audit so far).

    To each state after the last row as state: (cost, state begun in, audit); if last, only the best one that is accepted.
    """
    n, rest = len(rows), [0]
    for _, kind in reversed(rows):
        rest.append(rest[-1] + (0, CUT_OFF, DELETE)[kind])
    rest.reverse()
    queue = [(cost + rest[0], rank, "", 0, state, state, cost) for state, (cost, rank) in starts.items()]
    heapq.heapify(queue)
    known, out = set(), {}
    while queue:
        _, rank, audit, i, state, begun, cost = heapq.heappop(queue)
        if (i, state) in known:
            continue
        known.add((i, state))
        if i == n:
            if not last:
                out[state] = (cost, begun, audit)
                continue
            if state in ACCEPTS:
                return {state: (cost, begun, audit)}
        else:
            for letter, more, to in edits(state, *rows[i]):
                if (i + 1, to) not in known:
                    heapq.heappush(queue, (cost + more + rest[i + 1], rank, audit + letter, i + 1, to, begun, cost + more))
        to = NEXT[state, WANTED[state]]
        if (i, to) not in known:
            heapq.heappush(queue, (cost + INSERT + rest[i], rank, audit + "I", i, to, begun, cost + INSERT))
    return out


class Conversation:
    """Takes the rows of one conversation in order, and repairs it as far as that is settled."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.low = self.high = self.turn = None
        self.turns = 0
        self.part: list[tuple[str, int]] = []
        self.held: list[tuple[str, str]] = []  # rows whose edits aren't settled
        self.ways: dict[int, tuple[int, list[tuple[int, str]]]] = {0: (0, [])}  # by state: cost, (state begun in, audit) of each part that isn't settled
        self.audit: list[str] = []
        self.sha, self.first, self.state = hashlib.sha256(), True, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn  # they come in order
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = role[:1]
        said, kind = text.strip(BLANKS), FINE
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if not said:
            kind, name = GONE, "blank"
        elif key in self.seen:
            kind, name = GONE, "duplicate"
        elif said[-1] not in ".!?":
            kind, name = CUT, "truncated"
        if kind != FINE:
            self.counts[name] += 1
        self.seen.add(key)
        self.part.append((role[:1], kind))
        self.held.append((role, text))
        if len(self.part) >= PART:
            self.settle(False)

    def settle(self, last: bool) -> None:
        order = sorted(self.ways, key=lambda s: "".join(a for _, a in self.ways[s][1]))
        found = search({s: (self.ways[s][0], order.index(s)) for s in order}, self.part, last)
        found = {q: w for q, w in found.items() if not any(p != q and found[p][0] + INSTEAD[p, q] < w[0] for p in found)}  # no best repair goes there
        self.ways = {s: (cost, [*self.ways[begun][1], (begun, audit)]) for s, (cost, begun, audit) in found.items()}
        self.part = []
        while (parts := [w[1] for w in self.ways.values()])[0] and all(p[0] == parts[0][0] for p in parts):
            self.apply(parts[0][0][1])
            for p in parts:
                p.pop(0)

    def apply(self, audit: str) -> None:
        """Writes the settled edits of the rows held longest."""
        self.audit.append(audit)
        at = 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else self.held[at]
            at += letter != "I"
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else WANTED[self.state]
            self.state = NEXT[self.state, initial]
            self.sha.update((("" if self.first else "\n") + (role if letter == "K" else ROLES[initial]) + ":" + text).encode())
            self.first = False
        del self.held[:at]

    def result(self) -> dict:
        self.settle(True)
        ((cost, _),) = self.ways.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """conv_col, the counts of faults, cost, audit and repaired_sha256 of every conversation.

    Rows whose absent_col is true only say that their conversation exists.
    """
    spark = df.sparkSession
    small_batches(spark)
    absent = F.coalesce(F.col(f"`{absent_col}`"), F.lit(False)) if absent_col else F.lit(False)
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.monotonically_increasing_id().alias("loose"), F.col(f"`{turn_col}`").cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), absent.alias("absent")
    )
    rows = rows.withColumn("loose", F.when(F.col("conv").isNull(), F.col("loose")))
    order = ["conv", "loose", "turn", "role", "text"]
    rows = rows.repartition("conv", "loose").sortWithinPartitions(*order)
    kind = rows.schema["conv"].dataType
    fields = [T.StructField("conv", kind), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, talk, out, schema = None, None, [], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field("conv", batch.schema.field("conv").type), *[pa.field(c, pa.int64()) for c in COUNTS], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
            for conv, loose, turn, role, text, gone in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if talk is None or (conv, loose) != now:
                    if talk is not None:
                        out.append({"conv": now[0], **talk.result()})
                    now, talk = (conv, loose), Conversation()
                if not gone:
                    talk.add(turn, role, text)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if talk is not None:
            yield pa.RecordBatch.from_pylist([*out, {"conv": now[0], **talk.result()}], schema)

    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("conv", conv_col)


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, absent) with the faults that a checksum of conv_id and turn deals out."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault == 0).alias("absent"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"))
    return rows.drop("time")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent_col="absent")


QUERIES = {"op11_chat_repair": op11_chat_repair}
ORACLE_SQL: dict[str, str] = {}  # DuckDB has no crc32
