"""Repair of conversations to ``(system)? (user assistant)*`` at least cost, by block tables.

A row is one of nine symbols: to be deleted, or the kind of its role, whole or cut short. The cost
of repairing what is left of a conversation depends on the last role kept only (nothing, system,
user, assistant), so it is a vector of four numbers; less its minimum it is one of a small set of
vectors. For each block of four symbols and each vector behind the block a table holds the vector
before it and what is added (the Four-Russians method). Conversations go through the table from
the end, block by block; the vectors at the borders are kept, and the trace, which goes forward
and takes the least letter among the cheapest edits, works out those inside a block when it gets
there.

A conversation may hold a third of all rows: rows are dealt by ranges of conversation and turn, so
it lies in many tasks, as chunks. A chunk is a map of vectors (and, traced, of roles), and maps
compose; what passes through one task is a narrow row a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from fraudspark.llm.common import small_batches
from fraudspark.sources.staging import stage

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KINDS = "sua"
GONE, SYMBOLS, BLOCK = 0, 9, 4
#: The role that must come next, and the state it gives.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 20
BLANKS = "\t\n\x0b\x0c\r "
#: Rows and characters of a chunk.
CHUNK_ROWS, CHUNK_CHARS = 2048, 200_000
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 64


def _kept(state: int, symbol: int) -> int:
    """The state after keeping a row, or -1."""
    kind = (symbol - 1) % 4
    if kind == 0:
        return SYSTEM if state == NOTHING else -1
    if kind == 1:
        return USER if state != USER else -1
    return ASSISTANT if kind == 2 and state == USER else -1


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost from each state with a symbol to come, given the costs behind it."""
    out = [DELETE + c for c in after]
    if symbol != GONE:
        cut = CUT if symbol > 4 else 0
        for q in range(4):
            out[q] = min(out[q], REROLE + cut + after[NEXT[q]])
            if (to := _kept(q, symbol)) >= 0:
                out[q] = min(out[q], KEEP + cut + after[to])
    user, assistant = out[USER], out[ASSISTANT]
    out[USER], out[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    for q in (NOTHING, SYSTEM):
        out[q] = min(out[q], INSERT + out[USER])
    return tuple(out)


def _edit(state: int, symbol: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The letters up to and with the edit of a symbol, the least of the cheapest, and the state
    they lead to."""
    letters, before, cut = "", _before(symbol, after), CUT if symbol > 4 else 0
    while True:
        if before[state] == DELETE + after[state]:
            return letters + "D", state
        if before[state] == INSERT + before[NEXT[state]]:
            letters, state = letters + "I", NEXT[state]
            continue
        to = _kept(state, symbol)
        if to >= 0 and before[state] == KEEP + cut + after[to]:
            return letters + "K", to
        return letters + "R", NEXT[state]


class Tables:
    """Normalised vectors, the steps of single symbols and of blocks, and the edits."""

    END = (0, 2 * INSERT, INSERT, 0)
    TAIL = ("", "II", "I", "")

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [self.END]
        number = {self.END: 0}
        to, add, edits = [], [], []
        for v in self.vectors:
            rows = [_before(s, v) for s in range(SYMBOLS)]
            for r in rows:
                plain = tuple(c - min(r) for c in r)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
            to.append([number[tuple(c - min(r) for c in r)] for r in rows])
            add.append([min(r) for r in rows])
            edits.append([[_edit(q, s, v) for q in range(4)] for s in range(SYMBOLS)])
        self.edits = edits
        step_to, step_add = np.array(to).T, np.array(add).T
        self.step = step_to.tolist()
        self.to, self.add = step_to, step_add
        for _ in range(block - 1):  # one more symbol in front
            at = np.arange(SYMBOLS)[:, None, None]
            whole_to, whole_add = step_to[at, self.to], self.add + step_add[at, self.to]
            self.to = whole_to.reshape(-1, len(self.vectors))
            self.add = whole_add.reshape(-1, len(self.vectors))
        self.single_to, self.single_add = step_to, step_add
        self.place = SYMBOLS ** np.arange(block - 1, -1, -1)

    def blocks(self, symbols: bytes) -> tuple[list[int], int]:
        """Codes of the whole blocks, and how many symbols are left before them."""
        s = np.frombuffer(symbols, np.uint8)
        rest = len(s) % self.block
        return (s[rest:].reshape(-1, self.block) @ self.place).tolist(), rest

    def map_of(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind the symbols, the vector before them and what is added."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        codes, rest = self.blocks(symbols)
        for c in reversed(codes):
            cost += self.add[c][at]
            at = self.to[c][at]
        for s in reversed(symbols[:rest]):
            cost += self.single_add[s][at]
            at = self.single_to[s][at]
        return at, cost

    def borders(self, symbols: bytes, last: int) -> tuple[list[int], list[int], int]:
        """Vectors behind the leading rest and behind each block, last first; how many symbols the
        rest has; and what all adds up to, less the vector in front."""
        codes, rest = self.blocks(symbols)
        at, cost, out = last, 0, [last]
        for c in reversed(codes):
            cost += int(self.add[c, at])
            at = int(self.to[c, at])
            out.append(at)
        front = at
        for s in reversed(symbols[:rest]):
            cost += int(self.single_add[s, front])
            front = self.step[s][front]
        return out, [front], cost

    def trace(self, symbols: bytes, last: int, state: int) -> tuple[list[str], int]:
        """Letters of each symbol, and the state behind all."""
        behind, _, _ = self.borders(symbols, last)
        rest = len(symbols) % self.block
        out: list[str] = []
        lo = 0
        for hi in ([rest] if rest else []) + list(range(rest + self.block, len(symbols) + 1, self.block)):
            at = behind[(len(symbols) - hi) // self.block]
            inner = [at]
            for s in reversed(symbols[lo + 1 : hi]):  # the block's own vectors, from its end
                at = self.step[s][at]
                inner.append(at)
            for s, v in zip(symbols[lo:hi], reversed(inner), strict=True):
                letters, state = self.edits[v][s][state]
                out.append(letters)
            lo = hi
        return out, state


_tables: dict[int, Tables] = {}


def tables(block: int = BLOCK) -> Tables:
    if block not in _tables:
        _tables[block] = Tables(block)
    return _tables[block]


@dataclass
class Faults:
    """Symbols and counts of a chunk."""

    symbols: bytes
    blank: int
    duplicate: int
    truncated: int
    illegal: int


def faults(roles: list[str], texts: list[str], seen_before: set[int]) -> Faults:
    """Each row's first fault. ``seen_before``: places whose role and text stand in an earlier
    chunk."""
    seen: set[tuple[str, str]] = set()
    out, counts = bytearray(), [0, 0, 0]
    for i, row in enumerate(zip(roles, texts, strict=True)):
        role, text = row
        end = text.rstrip(BLANKS)
        if not end:
            counts[0] += 1
            out.append(GONE)
        elif row in seen or i in seen_before:
            counts[1] += 1
            out.append(GONE)
        else:
            cut = end[-1] not in ".!?"
            counts[2] += cut
            kind = KINDS.find(role[0]) if role else -1
            out.append(1 + (kind if kind >= 0 else 3) + 4 * cut)
        seen.add(row)
    illegal = sum(not lawful(a, b) for a, b in zip(roles, roles[1:]))  # noqa: B905
    return Faults(bytes(out), *counts, illegal)


def lawful(before: str, role: str) -> bool:
    return before[:1] + role[:1] in ("su", "ua", "au")


def mended(
    letters: list[str], state: int, roles: list[str], texts: list[str], tail: str
) -> list[tuple[str, str]]:
    """The rows that the edits give, from a state on."""
    out = []
    for step, role, text in zip(letters, roles, texts, strict=True):
        for c in step:
            if c == "D":
                continue
            if c == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                out.append((role, text))
            else:
                state = NEXT[state]
                out.append((ROLE[state], text if c == "R" else ""))
    for _ in tail:
        state = NEXT[state]
        out.append((ROLE[state], ""))
    return out


def _turns(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


_MESSAGES = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))
_MESSAGES_ARROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_STATS = "blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns_known long"


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _batches(rows: Iterator[tuple], kinds: StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    types, held = to_arrow_schema(kinds).types, []
    for r in rows:
        held.append(r)
        if len(held) >= OUT_ROWS:
            yield _batch(held, types, kinds.names)
            held = []
    if held:
        yield _batch(held, types, kinds.names)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in columns], strict=True)


def _chunks(rows: DataFrame, chunk_rows: int, chunk_chars: int) -> DataFrame:
    """Rows of sorted partitions as chunks. ``open``: the conversation may go on in another one."""
    fields = [f for f in rows.schema.fields if f.name in ("key", "conv")]
    schema = StructType(
        [*fields, StructField("chunk", LongType()), StructField("open", LongType())]
        + [StructField("turns", ArrayType(LongType()))]
        + [StructField(n, ArrayType(StringType())) for n in ("roles", "texts")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq, kind = TaskContext.get().partitionId() << 33, 0, None
        key = conv = None
        first, whole = True, True  # of the partition; of the conversation
        turns, roles, texts, chars = [], [], [], 0

        ready: list[tuple] = []

        def close(more: bool) -> None:
            nonlocal turns, roles, texts, chars, seq
            ready.append((key, conv, base + seq, int(more), turns, roles, texts))
            seq += 1
            turns, roles, texts, chars = [], [], [], 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), kind, pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.list_(pa.string())] * 2
            out = _batch(ready, kinds, schema.names)
            ready.clear()
            return out

        for b in batches:
            kind = b.column("conv").type
            columns = [b.column(c).to_pylist() for c in ("key", "conv", "turn", "role", "text")]
            for k, c, turn, role, text in zip(*columns, strict=True):
                if k != key and key is not None:
                    close(first or not whole)
                    first, whole = False, True
                elif len(roles) >= chunk_rows or chars >= chunk_chars:
                    whole = False
                    close(True)
                key, conv = k, c
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                chars += len(text) + 16
                if len(ready) >= OUT_ROWS:
                    yield flush()
        if key is not None:
            close(True)
            yield flush()

    return rows.mapInArrow(run, schema)


def _mapped(df: DataFrame, columns: list[str], schema, row: Callable[..., list[tuple]]) -> DataFrame:
    """``row`` over each row of some columns gives rows of the schema; batches are small, a row is
    a chunk."""
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((out for values in _rows(batches, columns) for out in row(*values)), kinds)

    return df.select(*columns).mapInArrow(run, kinds)


def _folded(df: DataFrame, columns: list[str], schema, newest_first: bool, fold: Callable) -> DataFrame:
    """Narrow chunk rows of a conversation in order, in one stream: ``fold(columns)`` is a
    generator of output rows over an iterator of input rows."""
    order = F.col("chunk").desc() if newest_first else F.col("chunk")
    rows = df.select(*columns).repartition("key").sortWithinPartitions("key", order)
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(fold(_rows(batches, columns)), kinds)

    return rows.mapInArrow(run, kinds)


def _repeats(chunks: DataFrame) -> DataFrame:
    """Chunks with the places of rows that stand in an earlier chunk of their conversation. Each
    chunk sends each of its own texts once."""

    def digests(key, chunk, roles, texts):
        first = {}
        for i, (r, t) in enumerate(zip(roles, texts, strict=True)):
            h = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
            first.setdefault(h, []).append(i)
        return [(key, chunk, h, places) for h, places in first.items()]

    marks = _mapped(
        chunks, ["key", "chunk", "roles", "texts"], "key string, chunk long, digest binary, places array<int>", digests
    )
    marks = stage(marks, "conversation-texts")
    first = marks.groupBy("key", "digest").agg(F.min("chunk").alias("first"), F.count("*").alias("c")).where("c > 1")
    later = marks.join(first.drop("c"), ["key", "digest"]).where("chunk > first")
    places = later.groupBy("chunk").agg(F.flatten(F.collect_list("places")).alias("seen"))
    return chunks.join(places, "chunk", "left")


def _open_chunks(chunks: DataFrame, block: int) -> DataFrame:
    """Chunks of conversations that lie in several, mended: maps are composed from the end, then
    roles from the front, and each chunk is traced by itself."""

    def symbols(key, chunk, turns, roles, texts, seen):
        f = faults(roles, texts, set(seen or ()))
        at, cost = tables(block).map_of(f.symbols)
        ends = (roles[0], roles[-1])
        stats = (f.blank, f.duplicate, f.truncated, f.illegal, *_turns(turns))
        return [(key, chunk, f.symbols, at.tolist(), cost.tolist(), *ends, *stats)]

    kinds = "key string, chunk long, symbols binary, maps array<int>, costs array<long>, first_role string, last_role string, "
    narrow = stage(
        _mapped(
            _repeats(chunks), ["key", "chunk", "turns", "roles", "texts", "seen"], kinds + _STATS, symbols
        ),
        "conversation-maps",
    )

    def from_the_end(rows):
        open_key, vector = None, 0
        for key, chunk, maps, costs in rows:
            if key != open_key:
                open_key, vector = key, 0
            yield chunk, vector, maps[vector], costs[vector]
            vector = maps[vector]

    vectors = _folded(
        narrow, ["key", "chunk", "maps", "costs"], "chunk long, behind int, front int, cost long", True, from_the_end
    )
    placed = stage(narrow.drop("maps", "costs").join(vectors, "chunk"), "conversation-vectors")

    def exits(key, chunk, symbols_, behind):
        t = tables(block)
        return [(key, chunk, [t.trace(symbols_, behind, q)[1] for q in range(4)])]

    traced = _mapped(placed, ["key", "chunk", "symbols", "behind"], "key string, chunk long, exits array<int>", exits)

    def from_the_front(rows):
        """Entry state of each chunk, and whether it is its conversation's last."""
        held = None
        state = NOTHING
        for key, chunk, out in rows:
            if held is not None:
                yield (held[1], key != held[0], held[2])
            if held is None or key != held[0]:
                state = NOTHING
            held = (key, chunk, state)
            state = out[state]
        if held is not None:
            yield (held[1], True, held[2])

    entries = _folded(traced, ["key", "chunk", "exits"], "chunk long, last boolean, entry int", False, from_the_front)
    facts = placed.drop("key").join(entries, "chunk")
    return chunks.drop("open", "turns").join(facts, "chunk")


def key_of(rows: DataFrame, conv_col: str) -> Column:
    """A text that tells conversations apart, null among them."""
    conv = rows[conv_col]
    return F.when(conv.isNull(), "0").otherwise(F.concat(F.lit("1"), conv.cast("string")))


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk_rows: int = CHUNK_ROWS,
    chunk_chars: int = CHUNK_CHARS,
    block: int = BLOCK,
) -> DataFrame:
    """Chunks of repaired conversations: ``key`` (of the conversation), ``conv``, ``chunk`` (their order), whether the chunk is
    the conversation's ``only`` one, counts of faults and turns, ``cost``, ``audit`` (letters of the
    edits) and ``messages`` (role and text).

    A conversation's rows are taken by turn, null first, then role, the first 64 characters of the
    text and a hash of it; equal rows stay rows of their own. Null role and text are one space, a
    null conversation is one of its own. A row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated. Blank and duplicate rows are deleted (4), others may be kept
    (0), given the role user or assistant (3) or deleted (4); user and assistant rows without text
    may be put in (3); a truncated row that stays adds 3. Roles count by their first letter; an
    empty role has none of the three. Of the cheapest edits the ASCII-least letters are taken. No
    rows give none; other columns are not read. A conversation may be longer than a task: it is
    repaired chunk by chunk with the same result.
    """
    small_batches(conversations.sparkSession)
    c = conversations
    null = F.lit(" ")
    rows = c.select(
        key_of(c, conv_col).alias("key"),
        c[conv_col].alias("conv"),
        c[turn_col].cast("long").alias("turn"),
        F.coalesce(c[role_col].cast("string"), null).alias("role"),
        F.coalesce(c[text_col].cast("string"), null).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [
        F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text"), F.col("tie")
    ]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = stage(_chunks(ranged, chunk_rows, chunk_chars), "conversation-chunks")
    keys = [f for f in chunks.schema.fields if f.name in ("key", "conv")]
    schema = StructType(
        [*keys, StructField("chunk", LongType())]
        + c.sparkSession.createDataFrame(
            [], f"only boolean, first_role string, last_role string, {_STATS}, cost long, audit string"
        ).schema.fields
        + [StructField("messages", _MESSAGES)]
    )

    def whole(key, conv, chunk, turns, roles, texts):
        t = tables(block)
        f = faults(roles, texts, set())
        letters, state = t.trace(f.symbols, 0, NOTHING)
        _, front, cost = t.borders(f.symbols, 0)
        cost += t.vectors[front[0]][NOTHING]
        tail = t.TAIL[state]
        stats = (f.blank, f.duplicate, f.truncated, f.illegal, *_turns(turns))
        messages = mended(letters, NOTHING, roles, texts, tail)
        return [(key, conv, chunk, True, roles[0], roles[-1], *stats, cost, "".join(letters) + tail, _dicts(messages))]

    def part(key, conv, chunk, roles, texts, symbols_, behind, front, cost, last, entry, first_role, last_role, *stats):
        t = tables(block)
        letters, state = t.trace(symbols_, behind, entry)
        tail = t.TAIL[state] if last else ""
        # what the chunk itself costs on the path taken
        cost += t.vectors[front][entry] - (0 if last else t.vectors[behind][state])
        messages = mended(letters, entry, roles, texts, tail)
        return [(key, conv, chunk, False, first_role, last_role, *stats, cost, "".join(letters) + tail, _dicts(messages))]

    names = ["key", "conv", "chunk", "turns", "roles", "texts"]
    closed = _mapped(chunks.where("open = 0"), names, schema, whole)
    facts = ["key", "conv", "chunk", "roles", "texts", "symbols", "behind", "front", "cost", "last", "entry"]
    stats = [s.split()[0] for s in _STATS.split(", ")]
    opened = _mapped(
        _open_chunks(chunks.where("open = 1"), block), [*facts, "first_role", "last_role", *stats], schema, part
    )
    return closed.unionByName(opened)


def _dicts(messages: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": r, "text": t} for r, t in messages]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summaries(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`: ``key``, ``conv``, counts, the whole audit
    and the digest of the messages (``role:text``, joined by line ends). Conversations in one chunk
    are summed up where they lie; the chunks of others pass through a task in order, which holds
    the audit and no texts."""
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns_known"), F.lit(0))
    short = repaired.where("only").select(
        "key",
        "conv",
        gaps.cast("long").alias("gaps"),
        *_COUNTS[1:],
        "audit",
        F.sha2(F.array_join(said, "\n").cast("binary"), 256).alias("repaired_sha256"),
    )

    def fold(rows):
        held = None
        for key, conv, ends, turns, counts, audit, messages in rows:
            if held is not None and key != held.key:
                yield held.row()
                held = None
            held = held or _Whole(key, conv)
            held.add(ends, turns, counts, audit, messages)
        if held is not None:
            yield held.row()

    parts = repaired.where("NOT only").select(
        "key",
        "conv",
        "chunk",
        F.array("first_role", "last_role").alias("ends"),
        F.array("first_turn", "last_turn", "turns_known").alias("turns"),
        F.array(*_COUNTS[1:]).alias("counts"),
        "audit",
        said.alias("said"),
    )
    columns = ["key", "conv", "ends", "turns", "counts", "audit", "said"]
    return short.unionByName(_folded(parts, columns, short.schema, False, fold))


class _Whole:
    """What the chunks of a conversation add up to."""

    def __init__(self, key: str, conv: object):
        self.key, self.conv = key, conv
        self.first = self.last = self.role = None
        self.known, self.counts, self.audit, self.begun = 0, [0] * 5, [], False
        self.digest = hashlib.sha256()

    def add(self, ends, turns, counts, audit, said) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.role is not None:
            self.counts[3] += not lawful(self.role, ends[0])
        self.role = ends[1]
        if turns[0] is not None:
            self.known += turns[2] - (turns[0] == self.last)
            self.first = turns[0] if self.first is None else self.first
            self.last = turns[1]
        self.audit.append(audit)
        for s in said:
            self.digest.update((b"\n" if self.begun else b"") + s.encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.known
        return (self.key, self.conv, gaps, *self.counts, "".join(self.audit), self.digest.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn: of 20 classes, 0 is
    dropped, 1 loses its text, 2 its sentence ends, 3 stands twice, 4 is said by the user."""
    c = conversations
    space = F.lit(" ")
    name = lambda n: F.coalesce(c[n].cast("string"), space)
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = c.select(
        c["conv_id"],
        c["turn"],
        F.when(kind == 4, "user").otherwise(name("role")).alias("role"),
        text.alias("text"),
        times.alias("times"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy"))


def repaired_conversations(conversations: DataFrame, **settings) -> DataFrame:
    """Every conversation with what its damaged rows lack and their cheapest repair."""
    found = summaries(repair(damaged(conversations), **settings)).drop("conv")
    all_ = conversations.select(key_of(conversations, "conv_id").alias("key"), conversations["conv_id"]).distinct()
    return all_.join(found, "key", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
