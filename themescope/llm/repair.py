"""Repair of conversation structure by divide and conquer (Hirschberg).

A repaired conversation is empty, or an optional system turn and then pairs of a user and
an assistant turn.  Every row is kept, given another role or deleted, and empty turns are
inserted; the cheapest edits win, of equally cheap ones those whose initials, written in
order, come first in ASCII.

While rows are read, a repaired conversation is in one of four states: nothing yet, after
the system turn, after a user, after an assistant turn.  Costs up to the middle (forward
vector) and from the middle on (backward vector) meet there; the state with the least sum,
and of those the one with the least audit so far, is where the optimal repair crosses, and
both halves are solved in the same way.  Only vectors of four numbers are kept.

The same meeting works above rows.  Conversations are range-partitioned by turn, so a very
long one is spread over partitions; its slice in each of them is reduced to a table of four
by four costs, the slices' tables are solved like rows, and each slice is then rebuilt
between the two states found for it.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import table, written

# --- fixed values: costs and initials of the edits ----------------------------
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1                                            # for an undeleted truncated row
# ------------------------------------------------------------------------------
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: State after a user or assistant turn put into each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Classes of rows (by the first letter of the role) and their faults.
CLASSES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
SOUND, LOST, CUT = 0, 4, 8                               # LOST: blank or duplicate, must go
Table = tuple                                            # [state in][state out] -> (cost, order of its audit) or None


@lru_cache(None)
def row_table(code: int) -> Table:
    """Best edit of a row of this class and fault: (cost, audit), insertions before it included."""
    kind, fault = code % 4, code - code % 4
    out = []
    for at in range(4):
        best: list = [None] * 4
        state, inserted = at, ""
        for _ in range(3):                               # more insertions come back to a state already seen
            ways = [(DELETE, "D", state)]
            if fault != LOST:
                extra = TRUNCATED if fault == CUT else 0
                ways.append((REROLE + extra, "R", NEXT[state]))
                if kind == CLASSES["s"] and state == START:
                    ways.append((KEEP + extra, "K", SYSTEM))
                if kind in (CLASSES["u"], CLASSES["a"]) and NEXT[state] == (USER if kind == CLASSES["u"] else ASSISTANT):
                    ways.append((KEEP + extra, "K", NEXT[state]))
            for cost, edit, to in ways:
                way = (cost + INSERT * len(inserted), inserted + edit)
                best[to] = min(best[to], way) if best[to] else way
            state, inserted = NEXT[state], inserted + "I"
        out.append(tuple(best))
    return tuple(out)


#: Insertions that finish a conversation, by the state it is left in.
ENDING = ("", "II", "I", "")


def forward(tables, lo: int, hi: int, start: int) -> list:
    """For each state after tables lo .. hi-1: (cost, rank of the least audit among the four), or None.

    Audits of a stretch hold one edit of each row, the last one at their end, so none is
    the beginning of another: the order of two is settled by where they first differ."""
    at: list = [None] * 4
    at[start] = (0, 0)
    for k in range(lo, hi):
        new: list = [None] * 4
        for state, known in enumerate(at):
            if known:
                for to, way in enumerate(tables[k][state]):
                    if way:
                        found = (known[0] + way[0], known[1], way[1])
                        if new[to] is None or found < new[to]:
                            new[to] = found
        order = sorted((x[1], x[2], to) for to, x in enumerate(new) if x)
        rank = {to: r for r, (_, _, to) in enumerate(order)}
        at = [x and (x[0], rank[to]) for to, x in enumerate(new)]
    return at


def backward(tables, lo: int, hi: int, end: int) -> list:
    """For each state before table lo: least cost to be in ``end`` after table hi-1, or None."""
    at: list = [None] * 4
    at[end] = 0
    for k in range(hi - 1, lo - 1, -1):
        at = [min((way[0] + at[to] for to, way in enumerate(row) if way and at[to] is not None), default=None) for row in tables[k]]
    return at


def crossings(tables, start: int, end: int) -> list[int]:
    """State after each table on the best way from ``start`` to ``end``."""
    out = [end] * len(tables)
    todo = [(0, len(tables), start, end)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        first, second = forward(tables, lo, mid, a), backward(tables, mid, hi, b)
        _, _, state = min((f[0] + s, f[1], state) for state, (f, s) in enumerate(zip(first, second)) if f and s is not None)
        out[mid - 1] = state
        todo += [(lo, mid, a, state), (mid, hi, state, b)]
    return out


def last_state(tables) -> int:
    """The state in which the best repair of a whole conversation leaves its last row."""
    ends = forward(tables, 0, len(tables), START)
    return min((f[0] + INSERT * len(ENDING[state]), f[1], state) for state, f in enumerate(ends) if f)[2]


@lru_cache(1 << 14)
def slice_table(codes: bytes) -> Table:
    """A slice as one table: (cost, rank) for every pair of states."""
    tables = [row_table(c) for c in codes]
    return tuple(tuple(forward(tables, 0, len(tables), a)) for a in range(4))


@lru_cache(1 << 14)
def slice_edits(codes: bytes, start: int, end: int) -> tuple[int, tuple]:
    """(cost, edits) of a slice between two states; an edit is (audit, lines of the turns
    inserted before the row, role of the row: None if deleted, empty if kept)."""
    tables = [row_table(c) for c in codes]
    states = [start, *crossings(tables, start, end)]
    cost, edits = 0, []
    for t, a, b in zip(tables, states, states[1:]):
        way, audit = t[a][b]
        cost += way
        state = a
        for _ in audit[:-1]:
            state = NEXT[state]
        edits.append((audit, inserted(a, len(audit) - 1), {"D": None, "K": ""}.get(audit[-1], ROLES[NEXT[state]])))
    return cost, tuple(edits)


def inserted(state: int, count: int) -> str:
    """Lines of empty turns put in from a state on."""
    lines = ""
    for _ in range(count):
        state = NEXT[state]
        lines += ROLES[state] + ":\n"
    return lines


# --- rows ------------------------------------------------------------------------

_SEEN = r"[^\x20\x09-\x0D]"


def sliced(rows: DataFrame) -> DataFrame:
    """Slices of conversations: (conv_id, part, codes, rows, statistics).

    ``rows``: (conv_id, turn, role, text).  The order of a conversation is turn (nulls
    first), role, text; equal rows are spread over partitions by a salt."""
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                    F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("salt"))
    r = (r.repartitionByRange("conv_id", "turn", "role", "text", "salt").sortWithinPartitions("conv_id", "turn", "role", "text", "salt")
         .withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()).drop("salt"))
    r = written(r.withColumn("key", F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256)), "repair-rows")
    first = r.groupBy("conv_id", "key").agg(F.min("seq").alias("first")).withColumnRenamed("conv_id", "c").withColumnRenamed("key", "k")
    r = r.join(first, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("k") == F.col("key"))).drop("c", "k", "key")
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    kind = F.lit(OTHER)
    for letter, number in CLASSES.items():
        kind = F.when(initial == letter, F.lit(number)).otherwise(kind)
    fault = (F.when(~F.col("text").rlike(_SEEN), "blank").when(F.col("seq") > F.col("first"), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))
    r = r.withColumn("fault", fault).withColumn("initial", initial).withColumn("code", kind + F.when(
        F.col("fault").isin("blank", "duplicate"), LOST).when(F.col("fault") == "truncated", CUT).otherwise(SOUND))
    at = F.array_sort(F.collect_list(F.struct("seq", "turn", "role", "text", "code", "initial")))
    s = r.groupBy("conv_id", "part").agg(at.alias("rows"), *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in (
        "blank", "duplicate", "truncated")], F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    pairs = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows") - 1),
                       lambda a, b: F.concat(a["initial"], b["initial"]))
    return s.withColumn("illegal", F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")) \
        .withColumn("codes", F.transform("rows", lambda x: x["code"]))


def _tables(batches):
    """(conv_id, part, codes) -> the slice's sixteen costs and ranks."""
    for batch in batches:
        cost, rank = [], []
        for codes in batch.column(2).to_pylist():
            t = [x or (-1, -1) for row in slice_table(bytes(codes)) for x in row]
            cost.append([x[0] for x in t])
            rank.append([x[1] for x in t])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cost, pa.list_(pa.int64())),
                                          pa.array(rank, pa.list_(pa.int32()))], ["conv_id", "part", "cost", "rank"])


def _meet(batches):
    """Slices of one conversation after another (in order) -> the states before and after each."""
    def solved(conv, parts, tables):
        end = last_state(tables)
        states = [START, *crossings(tables, START, end)]
        for part, a, b in zip(parts, states, states[1:]):
            yield {"conv_id": conv, "part": part, "start": a, "end": b, "last": part == parts[-1]}

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())])
    none, conv, parts, tables, out = object(), None, [], [], []
    conv = none
    for batch in batches:
        for r in batch.to_pylist():
            if r["conv_id"] != conv:
                if parts:
                    out += solved(conv, parts, tables)
                conv, parts, tables = r["conv_id"], [], []
            parts.append(r["part"])
            ways = [None if c < 0 else (c, k) for c, k in zip(r["cost"], r["rank"])]
            tables.append(tuple(tuple(ways[4 * a:4 * a + 4]) for a in range(4)))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if parts:
        out += solved(conv, parts, tables)
    yield pa.RecordBatch.from_pylist(out, schema)


def _rebuild(batches):
    """(conv_id, part, codes, start, end, last) -> cost, edits of the rows, what follows the last one."""
    edit = pa.struct([("audit", pa.string()), ("before", pa.string()), ("role", pa.string())])
    for batch in batches:
        costs, edits, tails, lines = [], [], [], []
        for codes, start, end, last in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
            cost, found = slice_edits(bytes(codes), start, end)
            tail = ENDING[end] if last else ""
            costs.append(cost + INSERT * len(tail))
            edits.append([dict(zip(("audit", "before", "role"), e)) for e in found])
            tails.append(tail)
            lines.append(inserted(end, len(tail)))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(costs, pa.int64()), pa.array(edits, pa.list_(edit)),
            pa.array(tails, pa.string()), pa.array(lines, pa.string())], ["conv_id", "part", "cost", "edits", "tail", "tail_lines"])


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of every
    conversation of ``rows`` (conv_id, turn, role, text); ``lines``: the repaired turns
    ``role:text``, each with a line feed after it.

    A row's first fault counts: blank, duplicate (role and text stood earlier in the
    conversation) or truncated (the last character that is no white space is not ``.!?``).
    Null roles and texts are one space; null conversations are one conversation; null turns
    come first and count in no gap; rows of one turn are taken by role and text, equal rows
    are duplicates; roles that start with other letters than s, u and a must be changed or
    deleted; an empty table has no conversations; extra columns are ignored.
    """
    s = written(sliced(rows.withColumn("conv_id", F.col("conv_id").cast("long"))), "repair-slices")
    codes = s.select("conv_id", "part", "codes")
    tables = codes.mapInArrow(_tables, "conv_id long, part int, cost array<long>, rank array<int>")
    states = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        _meet, "conv_id long, part int, start int, end int, last boolean").withColumnsRenamed({"conv_id": "c", "part": "p"})
    own = F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("part"))
    made = codes.join(states, own).select("conv_id", "part", "codes", "start", "end", "last").mapInArrow(
        _rebuild, "conv_id long, part int, cost long, edits array<struct<audit string, before string, role string>>, tail string, tail_lines string"
    ).withColumnsRenamed({"conv_id": "c", "part": "p"})
    line = F.zip_with("rows", "edits", lambda x, e: F.concat(e["before"], F.when(e["role"].isNull(), F.lit("")).otherwise(
        F.concat(F.when(e["role"] == "", x["role"]).otherwise(e["role"]), F.lit(":"), x["text"], F.lit("\n")))))
    j = s.join(made, own).select(
        "conv_id", "part", "blank", "duplicate", "truncated", "illegal", "cost", "low", "high", "turns",
        F.concat(F.array_join(F.transform("edits", lambda e: e["audit"]), ""), "tail").alias("audit"),
        F.concat(F.array_join(line, ""), "tail_lines").alias("lines"),
        F.struct("part", F.element_at("rows", 1)["turn"].alias("turn"), F.element_at("rows", 1)["initial"].alias("initial"),
                 F.element_at("rows", -1)["turn"].alias("last_turn"), F.element_at("rows", -1)["initial"].alias("last_initial")).alias("edge"))
    g = j.groupBy("conv_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")],
        F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list("edge")).alias("edges"),
        F.array_sort(F.collect_list(F.struct("part", "audit", "lines"))).alias("pieces"))
    # Where a conversation is cut: turns on both sides count once, and roles meet.
    cuts = F.zip_with(F.slice("edges", 1, F.size("edges") - 1), F.slice("edges", 2, F.size("edges") - 1), lambda a, b: F.struct(
        (a["last_turn"] == b["turn"]).alias("same"), F.concat(a["last_initial"], b["initial"]).alias("pair")))
    g = g.withColumn("cuts", cuts)
    turns = F.col("turns") - F.size(F.filter("cuts", lambda c: F.coalesce(c["same"], F.lit(False))))
    return g.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - turns, F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated",
        (F.col("illegal") + F.size(F.filter("cuts", lambda c: ~c["pair"].isin("su", "ua", "au")))).cast("long").alias("illegal"), "cost",
        F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"),
        F.array_join(F.transform("pieces", lambda p: p["lines"]), "").alias("lines"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user by the crc of ``conv_id:turn``."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    d = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                             F.coalesce("text", F.lit(" ")).alias("text"), d.alias("d"))
    return c.where("d <> 0").select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repaired(damaged(rows)).withColumnRenamed("conv_id", "c")
    j = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    text = F.coalesce("lines", F.lit(""))
    text = F.substring(text, F.lit(1), F.char_length(text) - 1)
    return j.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("repaired_sha256"))
