"""Conversation structure repair by weighted finite-state composition.

The rows of a conversation are an input acceptor, the edits (keep, rerole, delete, insert) a transducer, and the roles of a
well-formed conversation, `(s?(ua)+)?` in initials, an acceptor. Their composition has a state for each place between
rows and each grammar state; it is made lazily, place by place from the end, and its shortest path is taken over
the semiring of (cost, label string) pairs: the least cost, then the ASCII-least string of edits. Labels fix the path
from a state on, so equally cheap paths between two states are never prefixes of each other, and the least string of a whole
is made of least strings of its parts. So a block of rows is a matrix over the grammar's states, blocks are made apart, and
products of matrices join them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.texts import BLANK_CHARS
from flowlens.plans.shared import cut, lookup_join

#: Grammar states: START (accepts), after a system row, after a user's, after an assistant's (accepts).
START, SYSTEM, USER, ASSISTANT = range(4)
ARCS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: What edits cost; a truncated row that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Rows of a conversation that are taken at once; longer conversations are taken in blocks.
BLOCK = 4096
#: Faults of a row.
FINE, BLANK, DUPLICATE, CUT_SHORT = range(4)
ENDS = ".!?"

Path = tuple[int, str]
Vector = list[Path | None]


def row_step(after: Vector, initial: str, fault: int) -> Vector:
    """Best paths from each state before a row, inserts left out, from those after it."""
    lost = fault in (BLANK, DUPLICATE)
    extra = TRUNCATED if fault == CUT_SHORT else 0
    out: Vector = []
    for state in range(4):
        here = after[state]
        ways = [(here[0] + DELETE, "D" + here[1])] if here else []
        if not lost:
            for role, to in ARCS[state].items():
                there = after[to]
                if not there:
                    continue
                if role == initial:
                    ways.append((there[0] + extra, "K" + there[1]))
                if role in NAMES:
                    ways.append((there[0] + REROLE + extra, "R" + there[1]))
        out.append(min(ways) if ways else None)
    return out


def with_inserts(v: Vector) -> Vector:
    """Best paths that may insert rows first. An insert adds cost, so three rounds reach every state."""
    for _ in range(3):
        before = list(v)
        for state in range(4):
            for role, to in ARCS[state].items():
                there = before[to]
                if role in NAMES and there:
                    way = (there[0] + INSERT, "I" + there[1])
                    own = v[state]
                    v[state] = way if own is None or way < own else own
    return v


def final_vector() -> Vector:
    return with_inserts([(0, "") if s in ACCEPTS else None for s in range(4)])


def best_edits(rows: list[tuple[str, int]]) -> Path:
    """(cost, edits) of a whole conversation of (role initial, fault) rows."""
    v = final_vector()
    for initial, fault in reversed(rows):
        v = with_inserts(row_step(v, initial, fault))
    return v[START]


def block_matrix(rows: list[tuple[str, int]]) -> list[list[Path | None]]:
    """Best paths through a block of rows, from each state before it to each state after; inserts after it are the next block's."""
    columns = []
    for to in range(4):
        v: Vector = [(0, "") if s == to else None for s in range(4)]
        for initial, fault in reversed(rows):
            v = with_inserts(row_step(v, initial, fault))
        columns.append(v)
    return [[columns[to][state] for to in range(4)] for state in range(4)]


def _less(a: tuple, b: tuple) -> bool:
    """Whether chained strings (first, rest) of path a come before those of b; costs first."""
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y = a[1], b[1]
    left, right = x[0], y[0]
    while True:
        n = min(len(left), len(right))
        if left[:n] != right[:n]:
            return left[:n] < right[:n]
        left, right = left[n:], right[n:]
        while not left and x[1] is not None:
            x = x[1]
            left = x[0]
        while not right and y[1] is not None:
            y = y[1]
            right = y[0]
        if not left or not right or (x is y and left == right):
            return not left and bool(right)


def joined(blocks: list[list[list[Path | None]]]) -> Path:
    """(cost, edits) of a conversation from the matrices of its blocks in order; strings are chained, not copied."""
    v: list[tuple | None] = [None if p is None else (p[0], (p[1], None)) for p in final_vector()]
    for m in reversed(blocks):
        out: list[tuple | None] = []
        for state in range(4):
            best = None
            for to in range(4):
                step, there = m[state][to], v[to]
                if step is None or there is None:
                    continue
                way = (step[0] + there[0], (step[1], there[1]))
                if best is None or _less(way, best):
                    best = way
            out.append(best)
        v = out
    cost, chain = v[START]
    parts = []
    while chain:
        parts.append(chain[0])
        chain = chain[1]
    return cost, "".join(parts)


class Writer:
    """Hashes the repaired rows as edits are applied one after another: memory does not grow with them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.sha = audit, 0, START, True, hashlib.sha256()
        # the grammar's roles alternate, and only a kept row can be the system's: an odd number of rows has it first
        self.system = (len(audit) - audit.count("D")) % 2 == 1

    def _put(self, role: str, text: str) -> None:
        self.sha.update((b"" if self.first else b"\n") + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
        self.first = False

    def _next(self) -> str:
        if self.state == START and self.system:
            self.state = SYSTEM
            return "s"
        role = "a" if self.state == USER else "u"
        self.state = ARCS[self.state][role]
        return role

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(NAMES[self._next()], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._next()
            self._put(role, text)
        elif edit == "R":
            self._put(NAMES[self._next()], text)

    def end(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


class Figures:
    """Counts over a run of rows of one conversation in order, that join with those of the next run."""

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.head = self.tail = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT_SHORT
        if self.n:
            self.illegal += self.tail + initial not in LEGAL
        else:
            self.head = initial
        self.tail = initial
        self.n += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, other: Figures) -> None:
        if not other.n:
            return
        if self.n:
            self.illegal += self.tail + other.head not in LEGAL
        else:
            self.head = other.head
        self.turns += other.turns - (other.low is not None and other.low == self.high)
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high
        self.tail = other.tail
        for c in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + getattr(other, c))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def row(self) -> dict:
        return {"n": self.n, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "turns": self.turns, "low": self.low, "high": self.high, "head": self.head, "tail": self.tail}

    @classmethod
    def of(cls, row: dict) -> Figures:
        made = cls()
        for c in made.row():
            setattr(made, c, row[c])
        return made


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of `conv_id:turn`, and `here`: false for a dropped row, which still names
    its conversation. Null roles and texts are one space, and so is a null id or turn in what is hashed."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(code.isin(0, 1), "").when(code == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    times = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (code != 0).alias("here"), times).drop("_copy")


#: Order of the rows of a conversation: by turn; rows of one turn by role, the text's first characters, its hash.
ORDER = ["conv_id", "turn", "role", "_head", "_hash", "_uid"]
_FIGURES = "n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string"
PARTS = f"conv_id long, whole boolean, part long, seq long, {_FIGURES}, cost long, audit string, repaired_sha256 string, costs array<long>, labels array<string>"


def _faults(rows: DataFrame) -> DataFrame:
    """rows with their first fault; a duplicate is told by its hash within the conversation and role."""
    stripped = F.rtrim(F.translate(F.col("text"), BLANK_CHARS[1:], " " * (len(BLANK_CHARS) - 1)))
    own = F.when(stripped == "", BLANK).when(~F.substring(stripped, -1, 1).isin(*ENDS), CUT_SHORT).otherwise(FINE)
    keyed = cut(rows.select("*", F.substring("text", 1, 200).alias("_head"), F.sha2("text", 256).alias("_hash"), F.monotonically_increasing_id().alias("_uid"), own.alias("_own")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("named"), "turn", F.col("_uid"))
    told = keyed.where(F.col("here") & (F.col("_own") != BLANK))
    firsts = told.groupBy("conv_id", "role", "_hash").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    firsts = cut(firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_hash").alias("_h"), F.col("first._uid").alias("_first")), "firsts")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_hash") == F.col("_h"))
    marked = lookup_join(keyed, firsts, same, "left")
    fault = F.when(F.col("_own") == BLANK, BLANK).when(F.col("_first").isNotNull() & (F.col("_first") != F.col("_uid")), DUPLICATE).otherwise(F.col("_own"))
    return marked.withColumn("fault", fault.cast("int")).select("conv_id", "turn", "role", "text", "here", "_head", "_hash", "_uid", "fault")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("whole", pa.bool_()), ("part", pa.int64()), ("seq", pa.int64()), *[(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")],
    ("head", pa.string()), ("tail", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
])


def _repair_range(block: int):
    """For mapInArrow over rows in order: a row for each conversation that lies within the range and one block, with its digest; for
    others a row for each block with its matrix. The first and the last of a range may go on in its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, out = 0, [], []
        conv, part, begun, first = None, 0, False, True

        def block_row() -> dict:
            figures = Figures()
            for turn, role, _, fault in held:
                figures.add(turn, role[:1], fault)
            cells = [p for line in block_matrix([(role[:1], fault) for _, role, _, fault in held]) for p in line]
            return {"conv_id": conv, "whole": False, "part": part, "seq": seq, **figures.row(), "costs": [None if p is None else p[0] for p in cells], "labels": [None if p is None else p[1] for p in cells]}

        def whole_row() -> dict:
            figures = Figures()
            for turn, role, _, fault in held:
                figures.add(turn, role[:1], fault)
            cost, audit = best_edits([(role[:1], fault) for _, role, _, fault in held])
            writer = Writer(audit)
            for _, role, text, _ in held:
                writer.row(role, text)
            return {"conv_id": conv, "whole": True, "part": part, "seq": seq, **figures.row(), "cost": cost, "audit": audit, "repaired_sha256": writer.end()}

        size, in_blocks = 0, False
        for row in _runs(batches, ("conv_id", "turn", "role", "text", "here", "fault", "part")):
            if not begun or row[0] != conv:
                if begun:
                    out.append(block_row() if first or in_blocks else whole_row())
                    seq, first = seq + 1, False
                    held.clear()
                conv, part, begun, in_blocks, size = row[0], row[6], True, False, 0
            if not row[4]:
                continue
            held.append((row[1], row[2], row[3], row[5]))
            size += len(row[3])
            if len(held) == block or size > 1 << 26:  # a long conversation goes on as blocks
                out.append(block_row())
                seq, in_blocks, size = seq + 1, True, 0
                held.clear()
            if len(out) >= 2000:
                yield _batch(out, _SCHEMA)
                out = []
        if begun:
            out.append(block_row())
        if out:
            yield _batch(out, _SCHEMA)

    return run


def _join_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """One row for a conversation made of blocks: its figures, cost and edits; the digest is still open."""
    rows = table.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    total = Figures()
    matrices = []
    for r in rows:
        total.join(Figures.of(r))
        if r["n"]:
            cells = [None if c is None else (c, s) for c, s in zip(r["costs"], r["labels"], strict=True)]
            matrices.append([cells[4 * s : 4 * s + 4] for s in range(4)])
    cost, audit = joined(matrices)
    return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "whole": False, "part": 0, "seq": 0, **total.row(), "cost": cost, "audit": audit}], _SCHEMA)


def _write_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest) from rows in order, each conversation begun by a row with its edits; text is streamed."""
    writer, conv, out = None, None, []
    for conv_id, audit, role, text in _runs(batches, ("conv_id", "audit", "role", "text")):
        if audit is not None:
            if writer:
                out.append({"_d": conv, "repaired_sha256": writer.end()})
            writer, conv = Writer(audit), conv_id
        else:
            writer.row(role, text)
    if writer:
        out.append({"_d": conv, "repaired_sha256": writer.end()})
    yield _batch(out, pa.schema([("_d", pa.int64()), ("repaired_sha256", pa.string())]))


def repair(rows: DataFrame, here: str | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    rows: (conv_id long, turn long, role, text); where the column `here` is false a row only names its conversation. Null
    roles and texts are one space; rows without a conv_id are one conversation; rows without a turn come first. Rows of
    one turn are taken by role, the first 200 characters and the SHA-256 of their text, equal rows side by side. An empty role has
    no initial: its row is never kept as it is. A conversation without rows has zeros, no edits and the digest of nothing. An
    empty table gives no rows; other columns are not read. Texts are read whole.

    Rows are dealt once, by ranges of their order. A conversation inside a range is repaired there; one that goes over a
    border or is longer than a block becomes matrices of its blocks, which are multiplied, so its rows are never held at
    once, only its edits, which the result holds too. The digest, which SHA-256 defines from first byte to last, is made
    of its rows as a stream.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    marked = _faults(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"), (F.col(here) if here else F.lit(True)).alias("here")))
    ordered = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ordered = ordered.select("conv_id", "turn", "role", "text", "here", "fault", F.spark_partition_id().cast("long").alias("part"))
    made = cut(ordered.mapInArrow(_repair_range(block), PARTS), "repaired")
    figures = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    long = cut(made.where("not whole").groupBy("conv_id").applyInArrow(_join_blocks, PARTS).select("conv_id", gaps, *figures), "longones")
    named = long.select(F.col("conv_id").alias("_c"))
    theirs = lookup_join(marked.where("here"), named, F.col("conv_id").eqNullSafe(F.col("_c")), "inner").drop("_c")
    none = F.lit(None).cast("string")
    heads = long.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in marked.dtypes if c in ORDER[1:] and c != "role"], none.alias("role"), none.alias("text"), "audit", F.lit(0).alias("_k"))
    stream = theirs.select("conv_id", *ORDER[1:], "text", none.alias("audit"), F.lit(1).alias("_k")).unionByName(heads)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "_k", *ORDER[1:])
    digests = stream.select("conv_id", "audit", "role", "text").mapInArrow(_write_long, "_d long, repaired_sha256 string")
    whole = made.where("whole").select("conv_id", gaps, *figures, "repaired_sha256")
    return whole.unionByName(long.join(digests, F.col("conv_id").eqNullSafe(F.col("_d"))).select("conv_id", "gaps", *figures, "repaired_sha256"))
