"""Conversations audited and repaired with the cheapest edits, by a dynamic program that keeps backward costs only at checkpoints.

A repaired conversation has role initials ``(s?(ua)+)?``. Four states read it: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and
3 may end. The cost of the rest, from each state, is a vector of four numbers that is carried backward over the rows. It is
stored only at every sqrt(n)-th row; walking forward, each stretch of vectors is computed again from its checkpoint, and at
each step the ASCII-least edit is taken whose cost is tight. Equal letters lead to one state, so this gives the least audit.

Rows are dealt by ranges of (conversation, turn), so that one conversation with a third of all rows lies over many tasks. One that lies whole
in a task and in one block is settled there. Others go on as blocks of bounded rows and bytes: rows seen before are found
by their digests, each block gives the 4 x 4 matrix of its costs, the matrices give the vector at each block's end (the
checkpoints), and a walk over the blocks in order, one in memory at a time, recomputes each from its checkpoint. The digest
of a whole conversation is one sequential SHA-256, so that last walk is one task's for one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.common import staged

#: Faults of a row. A row with one of MUST_GO has to be deleted.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
MUST_GO = (BLANK, DUPLICATE)
REROLE, DELETE, INSERT = 2, 3, 2
FAR = 1 << 40
SPACE = " \t\n\r\x0b\x0c"
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
#: State after a user or an assistant turn is added in each state, and that turn's role.
ADDED = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
AT_END = (0, 2 * INSERT, INSERT, 0)
NO_ROWS = hashlib.sha256(b"").hexdigest()
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def kept_state(state: int, initial: str) -> int | None:
    """State after a row of this initial is kept, None where it cannot be."""
    if state == 0 and initial == "s":
        return 1
    to, role = ADDED[state]
    return to if initial == role[0] else None


def backward(row: tuple[str, int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row (initial, fault) from those after it; turns may be inserted before the row."""
    initial, fault = row
    cost = [DELETE + x for x in after]
    if fault not in MUST_GO:
        extra = 1 if fault == TRUNCATED else 0
        for q in range(4):
            cost[q] = min(cost[q], REROLE + extra + after[ADDED[q][0]])
            to = kept_state(q, initial)
            if to is not None:
                cost[q] = min(cost[q], extra + after[to])
    two, three = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + two), min(cost[1], INSERT + two), two, three


def block_matrix(rows: list[tuple[str, int]]) -> list[int]:
    """Cheapest cost from each state before the rows to each state after them, as 16 numbers."""
    out = [[0] * 4 for _ in range(4)]
    for r in range(4):
        vector = tuple(0 if q == r else FAR for q in range(4))
        for row in reversed(rows):
            vector = backward(row, vector)
        for q in range(4):
            out[q][r] = min(vector[q], FAR)
    return [x for line in out for x in line]


def walk(rows: list[tuple[str, int]], state: int, end: tuple[int, ...]) -> Iterator[tuple[str, int, str | None]]:
    """(edit, row, new role) of the ASCII-least cheapest edits of the rows, from a state, with the costs after them.

    The last item is ('', final state, None).
    """
    n = len(rows)
    step = isqrt(n) + 1
    checkpoints = {}
    vector = end
    for i in range(n, -1, -1):
        if i < n:
            vector = backward(rows[i], vector)
        if i % step == 0 or i == n:
            checkpoints[i] = vector
    for start in range(0, n, step):
        stop = min(start + step, n)
        stretch = [checkpoints[stop]]
        for i in range(stop - 1, start - 1, -1):
            stretch.append(backward(rows[i], stretch[-1]))
        stretch.reverse()
        for i in range(start, stop):
            here, after = stretch[i - start], stretch[i - start + 1]
            while True:
                left = here[state]
                if DELETE + after[state] == left:
                    yield "D", i, None
                    break
                to, role = ADDED[state]
                if INSERT + here[to] == left:
                    yield "I", -1, role
                    state = to
                    continue
                initial, fault = rows[i]
                kept = kept_state(state, initial)
                if kept is not None and left == after[kept] + (fault == TRUNCATED):
                    yield "K", i, None
                    state = kept
                else:
                    yield "R", i, role
                    state = to
                break
    yield "", state, None


def closing(state: int) -> Iterator[tuple[str, str]]:
    """The inserts that end a conversation."""
    while state not in (0, 3):
        state, role = ADDED[state]
        yield "I", role


class Audit:
    """The report of one conversation, its rows given in order, block by block."""

    def __init__(self) -> None:
        self.counts, self.illegal, self.cost = [0, 0, 0, 0], 0, 0
        self.low = self.high = self.last_turn = self.last_initial = None
        self.turns, self.state, self.any = 0, 0, False
        self.edits: list[str] = []
        self.digest = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def add(self, turns: list, roles: list[str], texts: list[str], faults: Iterable[int], end: tuple[int, ...]) -> None:
        rows = [(r[:1], x) for r, x in zip(roles, faults, strict=True)]
        for (initial, fault), turn in zip(rows, turns, strict=True):
            self.counts[fault] += 1
            if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_initial = initial
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.turns += turn != self.last_turn
                self.last_turn = turn
        for edit, i, role in walk(rows, self.state, end):
            if not edit:
                self.state = i
                break
            self.edits.append(edit)
            if edit == "I":
                self.cost += INSERT
                self._line(role, "")
            elif edit == "D":
                self.cost += DELETE
            else:
                self.cost += (edit == "R") * REROLE + (rows[i][1] == TRUNCATED)
                self._line(role or roles[i], texts[i])

    def report(self) -> dict:
        for edit, role in closing(self.state):
            self.edits.append(edit)
            self.cost += INSERT
            self._line(role, "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED],
                "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.edits), "repaired_sha256": self.digest.hexdigest()}


def fault_of(text: str) -> int:
    """BLANK, TRUNCATED or SOUND by the last character that is no white space."""
    body = text.rstrip(SPACE)
    return BLANK if not body else SOUND if body[-1] in ".!?" else TRUNCATED


def _digest(role: str, text: str) -> bytes:
    r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()


def _blocks(schema: pa.Schema, block_rows: int, block_bytes: int):
    """A task's sorted rows: settled conversations, and blocks of those that may go on elsewhere or are long."""
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        open_: dict = {}
        part = seq = -1
        first = True

        def fresh(conv) -> dict:
            return {"conv": conv, "turns": [], "roles": [], "texts": [], "faults": bytearray(), "hashes": [], "bytes": 0, "seen": set(), "cut": False}

        def block() -> None:
            nonlocal seq
            seq += 1
            out.append({"conv_id": open_["conv"], "part": part, "seq": seq, **{k: open_[k] for k in ("turns", "roles", "texts", "hashes")}, "faults": bytes(open_["faults"])})
            open_.update(fresh(open_["conv"]) | {"seen": open_["seen"], "cut": True})

        def close(whole: bool) -> None:
            if not whole or open_["cut"]:
                block()
                return
            a = Audit()
            a.add(open_["turns"], open_["roles"], open_["texts"], open_["faults"], AT_END)
            out.append({"conv_id": open_["conv"], **a.report()})

        def given() -> pa.RecordBatch:
            b = pa.record_batch([pa.array([r.get(c) for r in out], schema.field(c).type) for c in names], schema=schema)
            out.clear()
            return b

        held = 0
        for batch in batches:
            convs, turns, roles, texts, copies, parts = (batch.column(j).to_pylist() for j in range(6))
            for conv, turn, role, text, n, at in zip(convs, turns, roles, texts, copies, parts, strict=True):
                part = at
                if not open_ or conv != open_["conv"]:
                    if open_:
                        close(not first)
                        first = False
                    open_ = fresh(conv)
                for _ in range(n):
                    if len(open_["roles"]) >= block_rows or open_["bytes"] >= block_bytes:
                        block()
                    fault = fault_of(text)
                    mark = b"" if fault == BLANK else _digest(role, text)
                    if mark and mark in open_["seen"]:
                        fault, mark = DUPLICATE, b""
                    if mark:
                        open_["seen"].add(mark)
                    open_["turns"].append(turn)
                    open_["roles"].append(role)
                    open_["texts"].append(text)
                    open_["faults"].append(fault)
                    open_["hashes"].append(mark)
                    open_["bytes"] += len(text)
                    held += len(text) + 200
                if held > 4 << 20:
                    yield given()
                    held = 0
        if open_:
            close(False)
        if out:
            yield given()

    return run


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        found = [block_matrix([(r[:1], x) for r, x in zip(row["roles"], row["faults"], strict=True)]) for row in rows]
        yield pa.record_batch([*b.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names[:3], "matrix"])


def _checkpoints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each block, from the last block of each conversation backward: sorted rows (conv_id, part, seq, matrix)."""
    conv, vector, started = None, AT_END, False
    for b in batches:
        ends = []
        for c, m in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if not started or c != conv:
                conv, vector, started = c, AT_END, True
            ends.append(list(vector))
            vector = tuple(min(m[4 * q + r] + vector[r] for r in range(4)) for q in range(4))
        yield pa.record_batch([b.column(1), b.column(2), pa.array(ends, pa.list_(pa.int64()))], names=["part", "seq", "end"])


def _forward(schema: pa.Schema):
    """Reports of conversations from their blocks in order, each with the costs after it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit = None, None

        def given() -> pa.RecordBatch:
            row = {"conv_id": conv, **audit.report()}
            return pa.record_batch([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if audit is None or row["conv_id"] != conv:
                    if audit is not None:
                        yield given()
                    conv, audit = row["conv_id"], Audit()
                faults = bytearray(row["faults"])
                for place in row["again"] or ():
                    faults[place] = DUPLICATE
                audit.add(row["turns"], row["roles"], row["texts"], faults, tuple(row["end"]))
        if audit is not None:
            yield given()

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after the planted damage, by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (copies 0), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it (copies 2), 4 makes its role user.
    A null role or text is one space, as is a null id or turn in the crc.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))), F.lit(20))
    given = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return given.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def report(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for rows of (conv_id, turn, role, text, copies).

    Without ``copies`` each row counts once; a row of 0 copies only names its conversation, which may have no rows at all: zeros,
    empty audit, the digest of nothing. Rows go by turn (null first), those of one turn by role, then by the text's hash;
    rows that are equal in all are duplicates. A null conv_id is a conversation like any other; a null role or text is one
    space. Other columns are ignored. No rows give none. A block holds ``block_rows`` rows or ``block_bytes`` characters
    and the row that passes them; results do not depend on it.
    """
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1))
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = turns.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), F.col("copies").cast("int").alias("copies"))
    id_field, turn_field = given.schema["conv_id"], given.schema["turn"]
    # The last key parts rows that are equal in all, so that no number of them makes a range that cannot be cut.
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "nth"]
    dealt = given.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "text", "copies", F.spark_partition_id().alias("part"))

    report_fields = T._parse_datatype_string(REPORT).fields
    strings = T.ArrayType(T.StringType())
    block_fields = [
        T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("turns", T.ArrayType(turn_field.dataType)),
        T.StructField("roles", strings), T.StructField("texts", strings), T.StructField("faults", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.BinaryType()))]
    settled_schema = T.StructType([id_field, *block_fields, *report_fields])
    both = staged(dealt.mapInArrow(_blocks(_arrow(settled_schema), block_rows, block_bytes), settled_schema), "conversation-blocks")
    columns = ["conv_id", *[f.name for f in report_fields]]
    settled = both.where("seq is null").select(columns)

    # A digest seen in an earlier block of its conversation marks a duplicate. Within one task a digest stands once.
    blocks = both.where("seq is not null").select("conv_id", *[f.name for f in block_fields])
    marks = blocks.select("conv_id", "part", "seq", F.posexplode("hashes").alias("place", "hash")).where(F.octet_length("hash") > 0)
    first = marks.groupBy("conv_id", "hash").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), "first")
    again = marks.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h"))).where(F.struct("part", "seq") != F.col("first"))
    again = again.groupBy("part", "seq").agg(F.collect_list("place").alias("again"))  # within one block
    marked = staged(blocks.drop("hashes").join(again, ["part", "seq"], "left"), "conversation-marked")

    is_again = lambda f, i: F.when(F.array_contains(F.coalesce("again", F.array().cast("array<int>")), i), F.lit(DUPLICATE)).otherwise(f)
    codes = F.transform(F.sequence(F.lit(0), F.octet_length("faults") - 1), lambda i: is_again(F.conv(F.hex(F.substr("faults", i + 1, F.lit(1))), 16, 10).cast("int"), i))
    light = marked.select("conv_id", "part", "seq", F.transform("roles", lambda r: F.left(r, F.lit(1))).alias("roles"),
                          F.when(F.octet_length("faults") > 0, codes).otherwise(F.array().cast("array<int>")).alias("faults"))
    matrix_schema = T.StructType([id_field, *block_fields[:2], T.StructField("matrix", T.ArrayType(T.LongType()))])
    matrices = light.mapInArrow(_matrices, matrix_schema)
    ends = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(_checkpoints, "part int, seq int, end array<long>")
    walked = marked.join(ends, ["part", "seq"]).select("conv_id", "part", "seq", "turns", "roles", "texts", "faults", "again", "end")
    forward_schema = T.StructType([id_field, *report_fields])
    opened = walked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_forward(_arrow(forward_schema)), forward_schema)
    return settled.unionByName(opened)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
