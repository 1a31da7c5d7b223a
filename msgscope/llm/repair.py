"""Conversation structure repair by a run-length min-plus program (operator 12).

A conversation's roles should read ``(s?(ua)+)?`` by their first letters.  The
edits are Keep (0; 1 for a truncated row), Rerole to user or assistant (2, and 1
for a truncated row), Delete (3, the only edit of a blank or duplicate row) and
Insert of an empty user or assistant row (2) anywhere.  The automaton has four
states - nothing yet, system only, user last, assistant last - and every edit
letter leads from a state to one other state, so an edit string fixes the result.

Rows become role/fault symbols, and equal neighbours are collapsed into runs.
What it costs to go on from each state is carried backwards over the runs: a run
of n rows applies the binary powers of its symbol's min-plus matrix (computed
once a worker) that add up to n.  Then the choices are unrolled forwards, in a
run by halves: of the edits that keep the total, the least letter.

Rows of one conversation are sorted on disk by Spark and streamed twice within
their task, first without texts (symbols), then with texts (result), so memory
holds the runs and the edit letters of one conversation, never its texts.  One
conversation is read by one task, since its repaired text is hashed in order.

Rows come by turn (nulls first), rows of one turn by role and then by a hash of
the text.  Null role or text counts as one space.  Rows without a conv_id are one
conversation.  Repeated rows are duplicates.  A conversation none of whose rows
are left by ``damage`` has zeros, an empty edit string and the hash of the empty
string; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
DELETE, RETOLD, INSERT, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
#: States: nothing yet, system only, user last, assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What has to come next if it is made up, and where it leads.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost of ending in each state: the rows still to insert.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbol of a row that must go; any other row is 1 + 2 * class + truncated.
GONE = 0
CLASS = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}

# -------------------------------------------------------------------- program


def kept(symbol: int, state: int) -> int | None:
    """The state after keeping the row, if that may be."""
    if symbol == GONE:
        return None
    own = (symbol - 1) // 2
    if own == 0:
        return SYSTEM if state == START else None
    return own + 1 if own in (1, 2) and NEXT[state] == own + 1 else None


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _row_matrix(symbol: int) -> tuple:
    """Cost from state to state over one row: insertions before it, then its edit."""
    more = TRUNCATED if symbol != GONE and (symbol - 1) % 2 else 0
    edit = [[FAR] * 4 for _ in range(4)]
    inserts = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        edit[s][s] = DELETE
        if symbol != GONE:
            edit[s][NEXT[s]] = min(edit[s][NEXT[s]], RETOLD + more)
            k = kept(symbol, s)
            if k is not None:
                edit[s][k] = min(edit[s][k], more)
        inserts[s][s] = 0
        once, twice = NEXT[s], NEXT[NEXT[s]]
        inserts[s][once] = min(inserts[s][once], INSERT)
        inserts[s][twice] = min(inserts[s][twice], 2 * INSERT)
    return _times(tuple(map(tuple, inserts)), tuple(map(tuple, edit)))


@lru_cache(maxsize=None)  # symbols times the binary digits of a run's length
def power(symbol: int, k: int) -> tuple:
    """The matrix of 2**k rows with that symbol."""
    if k == 0:
        return _row_matrix(symbol)
    half = power(symbol, k - 1)
    return _times(half, half)


@lru_cache(maxsize=1 << 16)
def before(symbol: int, n: int, after: tuple) -> tuple[tuple, int]:
    """Costs to go before a run of n rows from those after it, less their least,
    and that least."""
    v, k = after, 0
    while n >> k:
        if n >> k & 1:
            m = power(symbol, k)
            v = tuple(min(m[i][j] + v[j] for j in range(4)) for i in range(4))
        k += 1
    least = min(v)
    return tuple(x - least for x in v), least


@lru_cache(maxsize=1 << 16)
def _choice(symbol: int, after: tuple, state: int) -> tuple[str, int]:
    """The least letters for one row in that state, up to its own edit, and the
    state after it."""
    m, more = power(symbol, 0), TRUNCATED if symbol != GONE and (symbol - 1) % 2 else 0
    go = [min(m[i][j] + after[j] for j in range(4)) for i in range(4)]
    letters = ""
    while True:
        if DELETE + after[state] == go[state]:
            return letters + "D", state
        if INSERT + go[NEXT[state]] == go[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        k = kept(symbol, state)
        if k is not None and more + after[k] == go[state]:
            return letters + "K", k
        return letters + "R", NEXT[state]


def _unroll(symbol: int, n: int, after: tuple, state: int) -> tuple[str, int]:
    """The letters of a run of n rows, by halves."""
    if n == 1:
        return _choice(symbol, after, state)
    if n <= 64:
        return _unroll_short(symbol, n, after, state)
    return _halves(symbol, n, after, state)


def _halves(symbol: int, n: int, after: tuple, state: int) -> tuple[str, int]:
    half = n // 2
    a, state = _unroll(symbol, half, before(symbol, n - half, after)[0], state)
    b, state = _unroll(symbol, n - half, after, state)
    return a + b, state


_unroll_short = lru_cache(maxsize=1 << 14)(_halves)


class Runs:
    """Symbols in order, equal neighbours together."""

    def __init__(self):
        self.symbols, self.lengths = bytearray(), array("q")

    def add(self, symbol: int, n: int = 1) -> None:
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += n
        else:
            self.symbols.append(symbol)
            self.lengths.append(n)

    def solve(self) -> tuple[int, str]:
        """(least cost, the least letters of that cost)."""
        v, cost, after = END, 0, []
        for symbol, n in zip(reversed(self.symbols), reversed(self.lengths)):
            after.append(v)
            v, least = before(symbol, n, v)
            cost += least
        state, letters = START, []
        for symbol, n in zip(self.symbols, self.lengths):
            some, state = _unroll(symbol, n, after.pop(), state)
            letters.append(some)
        letters.append("I" * (END[state] // INSERT))
        return cost + v[START], "".join(letters)


# --------------------------------------------------------------------- stream


class Conversation:
    """Symbols and counts of one conversation, then its repaired rows."""

    def __init__(self):
        self.runs = Runs()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.high = 0, None, None
        self.role = None
        self.cost, self.audit, self.at, self.state = 0, None, 0, START

    def see(self, turn: int | None, role: str, blank: bool, again: bool, truncated: bool, copies: int) -> None:
        """A row without its text, ``copies`` times."""
        if copies and turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += self.high is None or turn > self.high
            self.high = turn
        for copy in range(copies):
            if self.role is not None:
                self.illegal += self.role + role not in LEGAL
            self.role = role
            if blank:
                self.blank += 1
            elif again or copy:
                self.duplicate += 1
            else:
                self.truncated += truncated
                self.runs.add(1 + 2 * CLASS.get(role, 3) + truncated)
                continue
            self.runs.add(GONE)

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = self.runs.solve()

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self.at += 1
            yield "I", "user" if self.state == USER else "assistant", ""

    def read(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that stand for one row with its text."""
        self.solve()
        for _ in range(copies):
            yield from self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                yield edit, role, text
            elif edit == "R":
                self.state = NEXT[self.state]
                yield edit, "user" if self.state == USER else "assistant", text

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.solve()
        yield from self._inserted()

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Conversation, tuple | None]]:
    """(conv_id, conversation, repaired row or None at its end), in order."""
    conv, key = None, None
    for b in batches:
        for c, told, turn, role, text, blank, again, truncated, copies in zip(*(x.to_pylist() for x in b.columns)):
            if conv is None or c != key:
                if conv is not None:
                    yield from ((key, conv, row) for row in conv.end())
                    yield key, conv, None
                conv, key = Conversation(), c
            if not told:
                conv.see(turn, role, blank, again, truncated, copies)
            else:
                yield from ((key, conv, row) for row in conv.read(role, text, copies))
    if conv is not None:
        yield from ((key, conv, row) for row in conv.end())
        yield key, conv, None


SUMMARY = pa.schema(
    [("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
SUMMARY_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
ROWS_SQL = "conv_id long, pos long, edit string, role string, text string"


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4096 rows and about 4 MB."""
    some, total = [], 0
    for r in rows:
        some.append(r)
        total += size(r)
        if len(some) == 4096 or total > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, total = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        sha, some = hashlib.sha256(), False
        for key, conv, row in _walk(batches):
            if row is not None:
                sha.update(("\n" * some + row[1] + ":" + row[2]).encode())
                some = True
                continue
            yield key, conv.gaps, conv.blank, conv.duplicate, conv.truncated, conv.illegal, conv.cost, conv.audit, sha.hexdigest()
            sha, some = hashlib.sha256(), False

    yield from _batched(rows(), SUMMARY, lambda r: len(r[7]))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        pos = 0
        for key, _, row in _walk(batches):
            if row is None:
                pos = 0
            else:
                yield key, pos, *row
                pos += 1

    yield from _batched(rows(), ROWS, lambda r: len(r[4]))


# --------------------------------------------------------------------- tables


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` (1), as ``repair`` reads them."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(1).alias("copies")
    )


def damage(conversations: DataFrame) -> DataFrame:
    """``turns`` with every row damaged by crc32(``conv_id:turn``) modulo 20: 0
    drops it, 1 empties the text, 2 takes its sentence ends, 3 repeats it, 4 makes
    it the user's."""
    how = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20
    t = turns(conversations.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")}).select("conv_id", "turn", "role", "text"))
    return t.select(
        "conv_id",
        "turn",
        F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )


def _streams(rows: DataFrame) -> DataFrame:
    """Each conversation's rows without texts, then those that may stay with
    texts, sorted, whole conversations in one partition."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    t = rows.select(
        "conv_id", "turn", "role", "copies", "text", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    told = F.explode(F.when(F.col("copies") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("told")
    t = t.select("*", told).withColumns({"text": F.when(F.col("told") & ~F.col("blank"), F.col("text")), "live": F.col("copies") > 0})
    own = Window.partitionBy("conv_id", "told", "live", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    return (
        t.repartition("conv_id")
        .withColumn("again", F.row_number().over(own) > 1)
        .sortWithinPartitions("conv_id", "told", F.col("turn").asc_nulls_first(), "role", "h1", "h2")
        .select(
            "conv_id", "told", "turn", F.when(F.col("told"), F.col("role")).otherwise(F.substring("role", 1, 1)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            "blank", "again", "truncated", "copies",
        )
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row a conversation: the faults, the least cost, its edit letters and the
    SHA-256 of the repaired ``role:text`` lines.  ``rows`` is what ``turns`` or
    ``damage`` returns."""
    return _streams(rows).mapInArrow(_summaries, SUMMARY_SQL)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, pos, edit (K, R or I), role, text."""
    return _streams(rows).mapInArrow(_repaired, ROWS_SQL)
