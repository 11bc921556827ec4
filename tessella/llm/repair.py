"""Conversation structure repair at least cost, by Four-Russians block tables.

Rows of a conversation are kept, given another role, deleted, or empty turns inserted, until the first
letters of their roles read as an optional s and then one or more ua, or nothing. What is left to pay
from each state of that pattern is a vector of four costs. Less its minimum it takes few values, so the
step over a row is a table from (vector, symbol) to (vector, minimum), and the step over every block of
``BLOCK`` symbols is computed once, as a larger table. A conversation is read block by block from its
end by lookup; only the vectors at the borders are kept. The trace goes forward: each block is expanded
backward from its right border, and of the edits that lead to the least cost it takes the first by
letter, so that equal costs give the least audit string.

Rows are dealt in ranges of (conversation, turn), so that one conversation may lie in many tasks. A part
of it is summed up by what it does to every vector and state; two scans over these summaries tell each
part the vector at its right and the state at its left, and the parts are traced on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, fresh_path, write_and_forget

# What the edits cost, and what a cut-off row costs that stays.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
BLOCK = 4
CHUNK_ROWS, CHUNK_CHARS = 2048, 2 << 20
SPACES = " \t\n\x0b\x0c\r"

# States: nothing yet, after system, after user, after assistant. What the next inserted or re-roled turn is, by state.
WANTED = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
# Symbols: 0 must go; otherwise 1 + 2 * (first letter: s, u, a, another) + (1 if cut off).
LETTERS = {"s": 0, "u": 1, "a": 2}
SYMBOLS = 9


def keeps(state: int, symbol: int) -> int | None:
    """The state after keeping the row as it is, if the pattern allows that."""
    letter = (symbol - 1) // 2
    if symbol == 0 or letter == 3:
        return None
    return {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((state, letter))


def choices(state: int, symbol: int | None, after: tuple, here: list) -> list[tuple[int, str, int]]:
    """``(cost to go, edit, next state)`` in order of the edits' letters; ``symbol`` None stands for the end."""
    out = []
    if symbol is not None:
        out.append((DELETE + after[state], "D", state))
    out.append((INSERT + here[WANTED[state]], "I", WANTED[state]))
    if symbol:
        cut = CUT * ((symbol - 1) % 2)
        kept = keeps(state, symbol)
        if kept is not None:
            out.append((cut + after[kept], "K", kept))
        out.append((REROLE + cut + after[WANTED[state]], "R", WANTED[state]))
    return out


def costs(symbol: int | None, after: tuple) -> tuple:
    """The vector before a row from the one after it."""
    here = [0 if s in (0, 3) and symbol is None else 1 << 20 for s in range(4)]
    for _ in range(4):  # inserts feed each other
        here = [min(here[s], *(c for c, _, _ in choices(s, symbol, after, here))) for s in range(4)]
    return tuple(here)


class Tables:
    """The vectors that occur, and the tables over them."""

    def __init__(self, block: int = BLOCK):
        end = costs(None, (1 << 20,) * 4)
        self.vectors = [tuple(c - min(end) for c in end)]
        number, step, least, todo = {self.vectors[0]: 0}, [], [], 0
        while todo < len(self.vectors):
            rows = [costs(s, self.vectors[todo]) for s in range(SYMBOLS)]
            low = [min(r) for r in rows]
            for r, m in zip(rows, low):
                v = tuple(c - m for c in r)
                if v not in number:
                    number[v] = len(self.vectors)
                    self.vectors.append(v)
            step.append([number[tuple(c - m for c in r)] for r, m in zip(rows, low)])
            least.append(low)
            todo += 1
        n = len(self.vectors)
        self.step, self.least = np.array(step, np.int16), np.array(least, np.int64)
        self.moves = [[[self._move(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in range(n)]
        self.ends = [self._move(None, None, q) for q in range(4)]
        exits = np.array([[[m[1] for m in by_state] for by_state in row] for row in self.moves], np.int8)
        self.exit_one = exits
        # Blocks: symbol k of a block has weight 9 ** k; the last symbol acts first on vectors and last on states.
        self.block, self.next, self.sums, self.exits = block, self.step, self.least, exits
        for _ in range(block - 1):
            behind = self.next  # vectors right of one more symbol put before
            self.sums = (self.sums[:, :, None] + self.least[behind]).reshape(n, -1)
            through = np.take_along_axis(np.repeat(self.exits[:, :, None], SYMBOLS, 2), exits[behind].astype(np.int64), 3)
            self.exits = through.reshape(n, -1, 4)
            self.next = self.step[behind].reshape(n, -1)
        self.weights = np.array([SYMBOLS ** (block - 1 - k) for k in range(block)], np.int64)[::-1]

    def _move(self, right: int | None, symbol: int | None, state: int) -> tuple[str, int]:
        """The edits up to and with a row (or to the end) from a state, and the state after them."""
        after = self.vectors[right] if right is not None else (1 << 20,) * 4
        here, edits = list(costs(symbol, after)), ""
        while not (symbol is None and state in (0, 3)):
            _, edit, state = next(c for c in choices(state, symbol, after, here) if c[0] == here[state])
            edits += edit
            if edit != "I":
                break
        return edits, state

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols before the first whole block, and the codes of the blocks."""
        head = len(symbols) % self.block
        return symbols[:head], symbols[head:].reshape(-1, self.block).astype(np.int64) @ self.weights

    def summary(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector at the right: the vector at the left, and the state at the right by that at the left."""
        head, codes = self.codes(symbols)
        v = np.arange(len(self.vectors))
        rights = []
        for c in codes[::-1].tolist():
            rights.append(v)
            v = self.next[v, c]
        for s in head[::-1].tolist():
            rights.append(v)
            v = self.step[v, s]
        state = np.tile(np.arange(4), (len(self.vectors), 1))
        for s in head.tolist():
            state = np.take_along_axis(self.exit_one[rights.pop(), s], state, 1)
        for c in codes.tolist():
            state = np.take_along_axis(self.exits[rights.pop(), c], state, 1)
        return v, state

    def trace(self, symbols: np.ndarray, right: int = 0, state: int = 0) -> tuple[list[str], int, int]:
        """The edits up to and with each row, the state after them, and the least cost; what the right vector stands for counts above its minimum."""
        head, codes = self.codes(symbols)
        borders, total, v = [], 0, right
        for c in codes[::-1].tolist():
            borders.append(v)
            total += int(self.sums[v, c])
            v = int(self.next[v, c])
        at, rest = len(head), [(head.tolist(), v)]
        rest += [(symbols[at + k * self.block : at + (k + 1) * self.block].tolist(), borders[-1 - k]) for k in range(len(codes))]
        for s in head[::-1].tolist():
            total += int(self.least[v, s])
            v = int(self.step[v, s])
        cost, edits = total + self.vectors[v][state], []
        for block, border in rest:
            inside = [border]
            for s in block[:0:-1]:  # backward from the right border
                inside.append(int(self.step[inside[-1], s]))
            for s, r in zip(block, reversed(inside)):
                piece, state = self.moves[r][s][state]
                edits.append(piece)
        return edits, state, cost


_tables: list[Tables] = []


def tables() -> Tables:
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


def damage(chats: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` chooses, and how often each is there (``copies``, 0: only names its conversation).

    Nulls count as one space, in the key as well; a null turn stays null beside it.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = chats.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("_f"))
    text = F.when(F.col("_f").isin(0, 1), "").when(F.col("_f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 0, "").when(F.col("_f") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_f") == 0, 0).when(F.col("_f") == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, whether they are blank or cut off, and whether an earlier turn has said the same."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    name = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256))  # texts are shuffled once to be counted and once to be put in order, not for this
    said = rows.where("copies > 0").where(last != "").groupBy(F.col("conv_id").alias("_c"), name.alias("_s")).agg(F.min(F.struct("turn")).alias("_first"), F.max(F.struct("turn")).alias("_last"))
    said = said.where(~F.col("_first")["turn"].eqNullSafe(F.col("_last")["turn"])).drop("_last")
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    once = once.select("*", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), name.alias("said"))
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_s"))  # texts are not shuffled for this
    again = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first")["turn"])
    return once.join(said, on, "left").select("conv_id", "turn", "role", "text", "copies", "blank", "cut", again.alias("again"))


STATS = "first_turn long, last_turn long, n_turns long, first_letter string, last_letter string, illegal long, blank long, duplicate long, truncated long"
TURNS = "turns array<struct<role:string,text:string>>"
PIECE = "part int, seq int, whole boolean, rows long, audit string, state int, cost long, " + TURNS
STAT_NAMES = [c.split()[0] for c in STATS.split(", ")]
LEGAL = {"su", "ua", "au"}


class _Chunk:
    """Rows of one conversation that lie together in a task."""

    def __init__(self, conv):
        self.conv, self.symbols, self.roles, self.texts, self.chars = conv, bytearray(), [], [], 0
        self.first_turn = self.last_turn = self.first_letter = self.last_letter = None
        self.n_turns = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role: str, text: str, blank: bool, cut: bool, again: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        letter = role[:1]
        if self.first_letter is None:
            self.first_letter = letter
        else:
            self.illegal += self.last_letter + letter not in LEGAL
        self.last_letter = letter
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not blank and not again
        goes = blank or again
        self.symbols.append(0 if goes else 1 + 2 * LETTERS.get(letter, 3) + cut)
        self.roles.append(role)
        self.texts.append("" if goes else text)
        self.chars += 0 if goes else len(text)

    def stats(self) -> list:
        return [getattr(self, k) for k in STAT_NAMES]


def _turns(edits: list[str], state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The turns that the edits leave, from the state before them."""
    out = []
    for piece, role, text in zip(edits, roles, texts):
        for e in piece:
            if e == "D":
                continue
            if e == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                out.append({"role": role, "text": text})
            else:
                state = WANTED[state]
                out.append({"role": ROLE[state], "text": text if e == "R" else ""})
    return out


def _closing(state: int) -> tuple[str, int, list[dict]]:
    """What is inserted at the end of a conversation: edits, cost, turns."""
    edits, _ = tables().ends[state]
    turns = []
    for _e in edits:
        state = WANTED[state]
        turns.append({"role": ROLE[state], "text": ""})
    return edits, INSERT * len(edits), turns


def _gather(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tables(), TaskContext.get().partitionId()
        out: list[list] = []
        seq, held, chunk, alone, begun, size = 0, None, None, False, False, 0

        def put(chunk: _Chunk, whole: bool) -> None:
            nonlocal seq, size
            symbols = np.frombuffer(bytes(chunk.symbols), np.uint8)
            row = [chunk.conv, part, seq, whole, len(symbols)]
            if whole:
                edits, state, cost = t.trace(symbols)
                more, _, closing = _closing(state)
                row += ["".join(edits) + more, None, cost, _turns(edits, 0, chunk.roles, chunk.texts) + closing, *chunk.stats(), None, None, None]
            else:
                left, state = t.summary(symbols)
                said = [{"role": r, "text": x} for r, x in zip(chunk.roles, chunk.texts)]
                row += [None, None, None, said, *chunk.stats(), bytes(chunk.symbols), left.astype(np.uint8).tobytes(), state.astype(np.uint8).tobytes()]
            out.append(row)
            size += chunk.chars + 100 * len(symbols)
            seq += 1

        def ready() -> pa.RecordBatch:
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
            return batch

        for batch in batches:
            for conv, turn, role, text, copies, blank, cut, again in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if chunk is None or conv != held:
                    if chunk is not None:
                        put(chunk, alone)
                    chunk, held, alone, begun = _Chunk(conv), conv, begun, True  # a task's first conversation may have begun before
                for k in range(copies):
                    if len(chunk.symbols) >= CHUNK_ROWS or chunk.chars >= CHUNK_CHARS:
                        put(chunk, False)
                        chunk, alone = _Chunk(conv), False
                    chunk.add(turn, role, text, blank, cut, again or k > 0)
                if size >= 4 << 20 or len(out) >= 2000:
                    yield ready()
        if chunk is not None:
            put(chunk, False)  # and its last one may go on
        if out:
            yield ready()

    return run


def _scan(backward: bool, schema: pa.Schema):
    """Over the parts of a conversation in order: from its end the vector at each part's right, from its start the state at its left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, begun = None, 0, False
        for batch in batches:
            got = []
            for conv, left, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "left", "states"))):
                if not begun or conv != held:
                    held, now, begun = conv, 0, True
                got.append(now)
                if backward:
                    now = left[now]
                else:
                    now = state[now]
            if backward:
                states = [s[4 * r : 4 * r + 4] for r, s in zip(got, batch.column("states").to_pylist())]
                cols = [batch.column("conv_id"), batch.column("part"), batch.column("seq"), pa.array(got, pa.int32()), pa.array([b""] * len(got), pa.binary()), pa.array(states, pa.binary())]
            else:
                cols = [batch.column("conv_id"), batch.column("part"), batch.column("seq"), batch.column("right"), pa.array(got, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _traced(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                symbols = np.frombuffer(r["symbols"], np.uint8)
                roles, texts = [x["role"] for x in r["turns"]], [x["text"] for x in r["turns"]]
                edits, state, _ = t.trace(symbols, r["right"], r["entry"])
                paid = sum({"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[e] for p in edits for e in p)
                paid += CUT * sum(1 for p, s in zip(edits, symbols.tolist()) if s and (s - 1) % 2 and p[-1] != "D")
                rows.append({**r, "audit": "".join(edits), "state": state, "cost": paid, "turns": _turns(edits, r["entry"], roles, texts)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Pieces of repaired conversations: ``conv_id, part, seq, whole, rows, audit, state, cost, turns`` and counts of faults.

    Most conversations are one piece, marked ``whole``. The pieces of others follow each other by part
    and seq; ``conversations`` ends them and puts them together. ``turns`` are the repaired role and
    text of each turn. Rows are in order of turn (null first), then role and text; equal rows follow each
    other, so all but the first of them are duplicates. ``copies_col`` tells how often a row is there;
    a row that is there 0 times only names its conversation. A null role or text counts as one space.
    A row whose role is empty or starts with another letter than s, u or a can't be kept as it is.
    Null ids form one conversation. An empty table gives an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.lit(1) if copies_col is None else F.col(copies_col)
    marked = _marked(rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), copies.alias("copies")))
    kind = dict(marked.dtypes)["conv_id"]
    dealt = marked.repartitionByRange("conv_id", "turn", F.left("role", F.lit(8)), F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select("conv_id", "turn", "role", "text", "copies", "blank", "cut", "again")
    arrow = lambda ddl: _arrow_schema(spark, ddl)
    full = f"conv_id {kind}, {PIECE}, {STATS}, symbols binary, left binary, states binary"
    pieces = write_and_forget(dealt.mapInArrow(_gather(arrow(full)), full), fresh_path(spark, "chats"))
    open_ = pieces.where("NOT whole")
    small = open_.select("conv_id", "part", "seq", "left", "states").repartition("conv_id")
    back = f"conv_id {kind}, part int, seq int, right int, left binary, states binary"
    rights = small.sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(_scan(True, arrow(back)), back)
    front = f"conv_id {kind}, part int, seq int, right int, entry int"
    entries = rights.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_scan(False, arrow(front)), front)
    out = f"conv_id {kind}, {PIECE}, {STATS}"
    traced = open_.drop("left", "states").join(entries.drop("conv_id"), ["part", "seq"]).mapInArrow(_traced(arrow(out)), out)
    return pieces.where("whole").select(*traced.columns).unionByName(traced)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def conversations(pieces: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row per conversation.

    Whole pieces are read where they lie. The others are streamed in order, one piece at a time; a
    conversation's audit string and hash are the only things that gather.
    """
    kind = dict(pieces.dtypes)["conv_id"]
    ddl = f"conv_id {kind}, {RESULT}"
    run = _put_together(_arrow_schema(pieces.sparkSession, ddl))
    parts = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return pieces.where("whole").mapInArrow(run, ddl).unionByName(parts.mapInArrow(run, ddl))


class _Whole:
    def __init__(self, conv):
        self.conv, self.first, self.last, self.n, self.letter = conv, None, None, 0, None
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit, self.hash, self.lines, self.state = [], hashlib.sha256(), 0, None

    def say(self, turns: list[dict]) -> None:
        for x in turns:
            self.hash.update((("\n" if self.lines else "") + x["role"] + ":" + x["text"]).encode())
            self.lines += 1

    def add(self, r: dict) -> None:
        for k in self.sums:
            self.sums[k] += r[k] or 0
        if r["first_turn"] is not None:
            self.n += r["n_turns"] - (r["first_turn"] == self.last)
            self.first = r["first_turn"] if self.first is None else self.first
            self.last = r["last_turn"]
        if r["first_letter"] is not None:
            if self.letter is not None:
                self.sums["illegal"] += self.letter + r["first_letter"] not in LEGAL
            self.letter = r["last_letter"]
        self.audit.append(r["audit"])
        self.say(r["turns"])
        self.state = None if r["whole"] else r["state"]

    def row(self) -> dict:
        if self.state is not None:
            edits, cost, turns = _closing(self.state)
            self.audit.append(edits)
            self.sums["cost"] += cost
            self.say(turns)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.n
        return {"conv_id": self.conv, "gaps": gaps, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _put_together(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now.conv != r["conv_id"] or r["whole"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Whole(r["conv_id"])
                now.add(r)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return run
