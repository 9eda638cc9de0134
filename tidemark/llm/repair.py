"""Repairs the structure of conversations: the cheapest edits that give a legal order of roles, without faulty turns.

Edits form a lattice of nodes (turn, state of the grammar `(s?(ua)+)?` over role initials). Dijkstra's algorithm walks it
with the key (cost, audit), where the audit is the edits' initials so far, and stops at the first accepting end node that
leaves the heap. Of two audits of equal cost at one turn none begins with the other (the cost follows from the audit, and
what is longer has more insertions), so the order of audits stays as it is when edits are added: the walk is exact.

Rows are dealt out by ranges of (conversation, turn), so a conversation that holds most rows is spread over tasks. Each task
cuts its rows into pieces. A piece that is a whole conversation is done by one walk. A piece of a longer one, or one at the
edge of a range, is walked from each state of the grammar to all states; pieces are then joined in order, which needs their
walks only, and keeps no more of the audits than what the best ways to the states don't have in common. Texts stay with the pieces.

Decisions: a null role or text is one space. Turns ascend, null first; rows of one turn ascend by role, then text. Equal
rows of a turn are counted before the exchange: all but the first are duplicates. A null conversation id is one conversation.
An empty text is blank. A role is judged by its first letter, so an empty one is never legal. An empty table gives an empty one.
Extra columns don't pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import cut

#: Rows of a piece at most, and bytes of its texts from which on it ends.
PIECE_ROWS, PIECE_BYTES = 1024, 4 << 20
RETYPE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a. A letter leads on; ACCEPTS ends.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: A character that isn't white space, and the end of a text that is whole.
WORD, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

Way = tuple[int, str]  # cost and audit
Kind = tuple[str, int]  # initial, or "!" if the row must go, with "." for a truncated text; how many times the row is there


def moves(state: int, kind: Kind) -> Iterator[tuple[int, int, str]]:
    """(cost, next state, initials) of the edits that take a row away; those times that follow the first are deleted."""
    what, times = kind
    again, rest = DELETE * (times - 1), "D" * (times - 1)
    yield DELETE + again, state, "D" + rest
    if what[0] == "!":
        return
    more = again + (UNFINISHED if what[-1] == "." else 0)
    if (to := MOVES.get(what[0], {}).get(state)) is not None:
        yield more, to, "K" + rest
    for letter in "ua":
        if (to := MOVES[letter].get(state)) is not None:
            yield RETYPE + more, to, "R" + rest


def walk(kinds: list[Kind], start: int, wanted: tuple[int, ...], whole: bool) -> dict[int, Way]:
    """The best ways from a state before the rows to the wanted states after them; whole: only the first of these that is found."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(kinds) and state in wanted:
            found[state] = cost, audit
            if whole or len(found) == len(wanted):
                break
        for letter in "ua":
            if (to := MOVES[letter].get(state)) is not None and (at, to) not in done:
                heappush(heap, (cost + INSERT, audit + "I", at, to))
        if at < len(kinds):
            for more, to, initials in moves(state, kinds[at]):
                if (at + 1, to) not in done:
                    heappush(heap, (cost + more, audit + initials, at + 1, to))
    return found


def edited(rows: list[dict], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) that an audit makes of rows (role, text, kind, times) from a state of the grammar on, and the state after them."""
    out, edits, left = [], iter(audit), iter(rows)
    for edit in edits:
        letter, row = "a" if state == USER else "u", None
        if edit != "I":
            row = next(left)
            for _ in range(row["times"] - 1):
                next(edits)
            if edit == "D":
                continue
            letter = row["kind"][0] if edit == "K" else letter
        out.append((row["role"] if edit == "K" else NAMES[letter], row["text"] if row else ""))
        state = MOVES[letter][state]
    return out, state


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, times, fault): equal rows of a turn are one with their number; fault is that of the first, the others are duplicates of it.

    rows: (conv, turn, role, text, times), texts and roles without nulls. A row of 0 times only keeps its conversation.
    """
    one = cut(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times")))
    full = F.col("text").rlike(WORD) & (F.col("times") > 0)
    one = one.withColumn("full", full).withColumn("said", F.when(full, F.xxhash64("role", "text"))).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    # what a conversation says in several turns: few texts, which are compared
    twice = one.where("full").groupBy("conv", "role", "text").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    twice = cut(twice.select("conv", "role", "text", "first", F.xxhash64("role", "text").alias("said")))
    x, y = one.alias("x"), twice.alias("y")
    same = F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x.said") == F.col("y.said")) & (F.col("x.role") == F.col("y.role")) & (F.col("x.text") == F.col("y.text"))
    later = F.coalesce(F.col("x.place") > F.col("y.first"), F.lit(False))
    fault = F.when(~F.col("x.full"), "blank").when(later, "duplicate").when(~F.col("x.text").rlike(ENDED), "truncated")
    return x.join(y, same, "left").select("x.conv", "x.turn", "x.role", "x.text", "x.times", fault.alias("fault"))


TURN_ROWS = "array<struct<role:string,text:string,kind:string,times:long>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECE = (
    "part int, no long, whole boolean, taken long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, "
    f"ways array<struct<start:int,end:int,cost:long,audit:string>>, turn_rows {TURN_ROWS}"
)
EDITS = "part int, no long, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _schema(rows: DataFrame, ddl: str) -> tuple[StructType, pa.Schema]:
    """conv as in rows, then the columns of ddl: for Spark and for Arrow."""
    kind = StructType([rows.schema["conv"], *StructType.fromDDL(ddl).fields])
    return kind, to_arrow_schema(kind)


def _piece(rows: list[dict], whole: bool) -> dict:
    """What a piece is: its counts, what it needs to be joined to others, its walks and its rows."""
    own = [r for r in rows if r["times"]]
    out = {"whole": whole, "taken": sum(r["times"] for r in own)} | dict.fromkeys(COUNTS, 0)
    before = None
    for r in own:
        fault, role = r["fault"], r["role"][:1]
        r["kind"] = ("!" if fault in ("blank", "duplicate") else role or "-") + ("." if fault == "truncated" else "")
        out["blank"] += r["times"] if fault == "blank" else 0
        out["duplicate"] += 0 if fault == "blank" else r["times"] - (fault != "duplicate")
        out["truncated"] += fault == "truncated"
        out["illegal"] += r["times"] - 1 + _illegal(before, role)
        before = role
    known = [r["turn"] for r in own if r["turn"] is not None]
    kinds = [(r["kind"], r["times"]) for r in own]
    starts, ends = ((START,), ACCEPTS) if whole else ((START, SYSTEM, USER, ASSISTANT),) * 2
    return out | {
        "first": own[0]["role"][:1] if own else None, "last": before, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
        "ways": [{"start": s, "end": e, "cost": w[0], "audit": w[1]} for s in starts for e, w in walk(kinds, s, ends, whole).items()], "turn_rows": own,
    }


def _illegal(before: str | None, role: str) -> bool:
    return before is not None and before + role not in ("su", "ua", "au")


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The pieces (conv, ...) of conversations, in order by (part, no)."""
    order = ["conv", "turn", "role", "text"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "times", "fault")
    kind, schema = _schema(rows, PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        # rows of the piece and its bytes; whether the conversation may have begun before it
        held, size, edge, out, weight = [], 0, True, [], 0

        def close(ends: bool) -> None:
            nonlocal no, held, size, edge, weight
            out.append(_piece(held, ends and not edge) | {"conv": held[0]["conv"], "part": part, "no": no})
            no, held, size, edge, weight = no + 1, [], 0, not ends, weight + size + 256

        for b in batches:
            for r in b.to_pylist():
                if held and r["conv"] != held[-1]["conv"]:
                    close(True)
                elif len(held) >= piece_rows or size >= piece_bytes:
                    close(False)
                if weight > piece_bytes:
                    yield _batch(out, schema)
                    out, weight = [], 0
                size += len(r["text"])
                held.append(r)
        if held:
            edge = True  # its conversation may go on in the next range
            close(True)
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(run, kind)


class Joining:
    """Joins a conversation's pieces in order: the best ways to the states, of which only what they don't have in common is held apart."""

    def __init__(self, conv):
        self.conv, self.best, self.settled, self.seen = conv, {START: (0, "")}, [], []
        self.counts, self.turns, self.low, self.high, self.last = dict.fromkeys(COUNTS, 0), 0, None, None, None

    def add(self, p: dict) -> None:
        for c in COUNTS:
            self.counts[c] += p[c]
        if p["taken"]:
            self.counts["illegal"] += _illegal(self.last, p["first"])
            self.last = p["last"]
        if p["turns"]:
            self.turns += p["turns"] - (p["low"] == self.high)
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]
        now = {}
        for w in p["ways"]:
            if (so_far := self.best.get(w["start"])) is not None:
                way = so_far[0] + w["cost"], so_far[1] + w["audit"]
                if w["end"] not in now or way < now[w["end"]]:
                    now[w["end"]] = way
        common = commonprefix([a for _, a in now.values()])
        self.settled.append(common)
        self.best = {s: (c, a[len(common) :]) for s, (c, a) in now.items()}
        self.seen.append((p["part"], p["no"], p["taken"]))

    def done(self) -> Iterator[dict]:
        """Of each piece its edits; the last has the conversation's counts."""
        cost, rest = min(self.best[s] for s in ACCEPTS if s in self.best)
        audit, at, state = "".join(self.settled) + rest, 0, START
        nothing = dict.fromkeys(("gaps", *COUNTS, "cost", "audit"))
        for k, (part, no, taken) in enumerate(self.seen):
            end, last = at, k + 1 == len(self.seen)
            while taken:  # insertions before a row belong to its piece
                taken -= audit[end] != "I"
                end += 1
            end = len(audit) if last else end
            row = {"conv": self.conv, "part": part, "no": no, "edits": audit[at:end]} | nothing
            if last:
                gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
                row |= self.counts | {"gaps": gaps, "cost": cost, "audit": audit}
            yield row
            at = end


def _joined(open_: DataFrame) -> DataFrame:
    """(conv, part, no, edits, ...) of pieces that aren't whole conversations. Their texts don't come along."""
    light = open_.drop("turn_rows", "whole").repartition("conv").sortWithinPartitions("conv", "part", "no")
    kind, schema = _schema(open_, EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for p in b.to_pylist():
                if now is None or now.conv != p["conv"]:
                    if now is not None:
                        yield _batch(list(now.done()), schema)
                    now = Joining(p["conv"])
                now.add(p)
        if now is not None:
            yield _batch(list(now.done()), schema)

    return light.mapInArrow(run, kind)


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Pieces of conversations with their edits: (conv, part, no, whole, edits, turn_rows, gaps, blank, duplicate, truncated, illegal, cost, audit).

    rows: (conv, turn, role, text, times). A conversation's counts, cost and audit stand on its last piece and are null on
    the others. repaired_turns and digests read the repaired conversations from it.
    """
    found = cut(pieces(faults(rows), piece_rows, piece_bytes))
    way = F.element_at("ways", 1)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    columns = ["conv", "part", "no", "whole", "edits", "turn_rows", "gaps", *COUNTS, "cost", "audit"]
    whole = found.where("whole").withColumns({"gaps": gaps, "cost": way["cost"], "audit": way["audit"], "edits": way["audit"]})
    parts = found.where("not whole")
    texts, edits = parts.select("conv", "part", "no", "whole", "turn_rows"), cut(_joined(parts))
    same = F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.no") == F.col("y.no"))
    rest = texts.alias("x").join(edits.alias("y"), same).select(*(f"{'x' if c in texts.columns else 'y'}.{c}" for c in columns))
    return whole.select(*columns).unionByName(rest)


def _in_order(repaired: DataFrame) -> list[DataFrame]:
    """Whole conversations as they lie, and the pieces of others in order."""
    return [repaired.where("whole"), repaired.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "no")]


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """(conv, place, role, text): the repaired conversations, places from 0."""
    kind, schema = _schema(repaired, "place long, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, place = object(), START, 0
        for b in batches:
            for p in range(b.num_rows):  # piece by piece, as texts may be long
                r = b.slice(p, 1).to_pylist()[0]
                if r["conv"] != key:
                    key, state, place = r["conv"], START, 0
                out, state = edited(r["turn_rows"], r["edits"], state)
                yield _batch([{"conv": key, "place": place + k, "role": role, "text": text} for k, (role, text) in enumerate(out)], schema)
                place += len(out)

    one, more = (x.select("conv", "part", "no", "edits", "turn_rows").mapInArrow(run, kind) for x in _in_order(repaired))
    return one.unionByName(more)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation; the hash is that of its `role:text`, joined by newlines."""
    counts = ["gaps", *COUNTS, "cost", "audit"]
    kind, schema = _schema(repaired, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place, sha = START, 0, hashlib.sha256()
        for b in batches:
            out = []
            for p in range(b.num_rows):
                r = b.slice(p, 1).to_pylist()[0]
                turns, state = edited(r["turn_rows"], r["edits"], state)
                for role, text in turns:
                    sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    place += 1
                if r["cost"] is not None:  # the last of its conversation
                    out.append({c: r[c] for c in ("conv", *counts)} | {"repaired_sha256": sha.hexdigest()})
                    state, place, sha = START, 0, hashlib.sha256()
            if out:
                yield _batch(out, schema)

    one, more = (x.select("conv", "part", "no", "edits", "turn_rows", *counts).mapInArrow(run, kind) for x in _in_order(repaired))
    return one.unionByName(more)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times): rows with the faults that the hash of `conv:turn` says, by its remainder by 20.

    0 drops the row (0 times), 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 doubles it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(how <= 1, "").when(how == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    role = F.when(how == 0, "").when(how == 4, "user").otherwise(space(role_col))
    times = F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long")
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
