"""Conversation structure repair with Four-Russians block tables.

The cheapest edits that bring a conversation's role initials into ``(s?(ua)+)?``: keep a row (0), give it the role user or
assistant (3), delete it (4; blank and duplicate rows must go), insert an empty row (3); a truncated row that stays adds 3.
Of equally cheap ones, the ASCII-least string of initials (Keep, Rerole, Delete, Insert).

The pattern has four states, so the cost of finishing from each is a vector of four; less its least entry it takes a few
values only (30). A row is one of nine symbols. For every block of up to BLOCK symbols and every vector to the right of
it, tables hold the vector to the left of it, and for each state on its left the least edits and the state on its right. A
conversation is processed from the right, block by block, by lookup; then from the left, where the vectors at the block
borders, expanded backwards into the blocks when the tables were made, say which edits lie on a cheapest path. So ties are
broken over the whole conversation, not within a block.

A conversation of any length is handled in pieces of at most 2 ** PIECE rows, wherever they lie:

1. Rows are dealt by range of (conv_id, turn, role, text) and a salt, sorted and numbered, so a large conversation spreads
   over many tasks, also when all of its rows are equal. Rows first seen are found by partial aggregation.
2. Each piece gives its map from vectors to vectors and states to states; one short row a piece is brought together per
   conversation, which tells every piece the vector on its right and the state on its left.
3. All pieces find their edits at once.

``digest`` hashes the repaired rows of a conversation one after the other, as SHA-256 demands: one task for each
conversation, in constant memory but for the string of its edits. ``repair`` has no such step.

Defined results: null roles and texts are one space; null turns come first; a null conv_id is a conversation like
others; rows of one turn are ordered by role, then text; equal rows are duplicates of the first; a conversation without rows is
not in ``repair``; an empty table gives no rows. Further columns are not read, whatever their names.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import SPACE, cut, map_batches, query, table, worker_memory

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Symbols of a block; rows of a piece, as a power of two.
BLOCK, PIECE = 3, 16
#: States: start, after the system row, after a user row, after an assistant row; a conversation may end in the first and last.
STATES, ENDS = 4, (0, 3)
#: State after a user or assistant row that the pattern asks for, and its role.
ASKED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: By role initial: state after a kept row, by state before it.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
INITIALS = list(KEPT)
#: Symbol 0 must be deleted; the others are 1 + 2 * (place of the initial) + (truncated).
SYMBOLS = 1 + 2 * len(INITIALS)
LEGAL = ("su", "ua", "au")


def _ways(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after it) for a row with this symbol, in ASCII order of the edits; without inserts."""
    ways = [(DELETE, DELETE_COST, state)]
    if symbol:
        extra = TRUNCATED_COST * ((symbol - 1) % 2)
        after = KEPT[INITIALS[(symbol - 1) // 2]].get(state)
        if after is not None:
            ways.append((KEEP, extra, after))
        ways.append((REROLE, REROLE_COST + extra, ASKED[state]))
    return ways


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(STATES):
        costs = [min(c, INSERT_COST + costs[ASKED[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: Cost of finishing after the last row.
LAST = _with_inserts([0 if s in ENDS else 10**6 for s in range(STATES)])


def _before(right: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs of finishing before a row, from those after it."""
    return _with_inserts([min(c + right[t] for _, c, t in _ways(symbol, s)) for s in range(STATES)])


def _edits(right: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """Least string of edits up to the one of this row on a cheapest path, and the state after it."""
    left, found = _before(right, symbol), ""
    while True:
        ways = [(DELETE, DELETE_COST + right[state], state)] + [(INSERT, INSERT_COST + left[ASKED[state]], ASKED[state])]
        ways += [(e, c + right[t], t) for e, c, t in _ways(symbol, state) if e != DELETE]
        edit, _, state = next(w for w in ways if w[1] == left[state])
        found += edit
        if edit != INSERT:
            return found, state


class Tables:
    """Transitions of all blocks of 1 to BLOCK symbols, by length: vectors, states and edits."""

    def __init__(self):
        normal = lambda v: tuple(c - min(v) for c in v)
        self.vectors, waiting = [normal(LAST)], [normal(LAST)]
        while waiting:
            right = waiting.pop()
            for symbol in range(SYMBOLS):
                left = normal(_before(right, symbol))
                if left not in self.vectors:
                    self.vectors.append(left)
                    waiting.append(left)
        number, n = {v: i for i, v in enumerate(self.vectors)}, len(self.vectors)
        left = np.array([[number[normal(_before(v, s))] for v in self.vectors] for s in range(SYMBOLS)])
        state = np.zeros((SYMBOLS, n, STATES), dtype=np.int64)
        edits = np.empty((SYMBOLS, n, STATES), dtype=object)
        for s in range(SYMBOLS):
            for i, v in enumerate(self.vectors):
                for q in range(STATES):
                    edits[s, i, q], state[s, i, q] = _edits(v, s, q)
        self.left, self.state, self.edits = {1: left}, {1: state}, {1: edits}
        for length in range(2, BLOCK + 1):
            # One symbol before a block that is one shorter: its right vector is the block's left one.
            rest_left, rest_state, rest_edits = (t[length - 1] for t in (self.left, self.state, self.edits))
            middle = state[:, rest_left]
            own = edits[:, rest_left]
            inner = np.broadcast_to(rest_state, middle.shape)
            self.left[length] = left[:, rest_left].reshape(-1, n)
            self.state[length] = np.take_along_axis(inner, middle, axis=3).reshape(-1, n, STATES)
            self.edits[length] = (own + np.take_along_axis(np.broadcast_to(rest_edits, middle.shape), middle, axis=3)).reshape(-1, n, STATES)

    def blocks(self, symbols: bytes) -> list[tuple[int, int]]:
        """(length, number) of the blocks of a sequence."""
        out = []
        for i in range(0, len(symbols), BLOCK):
            part, code = symbols[i:i + BLOCK], 0
            for s in part:
                code = code * SYMBOLS + s
            out.append((len(part), code))
        return out

    def summary(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each vector on the right of a sequence: the vector on its left, and by state on its left that on its right."""
        left = np.arange(len(self.vectors))
        state = np.tile(np.arange(STATES), (len(left), 1))
        for length, code in reversed(self.blocks(symbols)):
            state = np.take_along_axis(state, self.state[length][code][left], axis=1)
            left = self.left[length][code][left]
        return left, state

    def trace(self, symbols: bytes, right: int, state: int) -> str:
        """The least edits of a sequence between a state and a vector."""
        parts = self.blocks(symbols)
        rights = [right]
        for length, code in reversed(parts):
            rights.append(int(self.left[length][code, rights[-1]]))
        out = []
        for (length, code), v in zip(parts, rights[-2::-1]):
            out.append(self.edits[length][code, v, state])
            state = int(self.state[length][code, v, state])
        return "".join(out)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def forget() -> None:
    tables.cache_clear()


def steps(symbols: bytes, edits: str, state: int, last: bool) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, place at that row, edit, new role) for each edit; ``last`` adds the inserts behind the last row."""
    row = place = 0
    for edit in edits:
        role = None
        if edit in (INSERT, REROLE):
            state = ASKED[state]
            role = ROLES[state]
        elif edit == KEEP:
            state = KEPT[INITIALS[(symbols[row] - 1) // 2]][state]
        yield row, place, edit, role
        row, place = (row, place + 1) if edit == INSERT else (row + 1, 0)
    if last:
        place = 1
        while state not in ENDS:
            state = ASKED[state]
            yield row - 1, place, INSERT, ROLES[state]
            place += 1


def ordered(rows: DataFrame) -> DataFrame:
    """The rows in order: ``seq`` rises with conv_id, turn, role and text, over all tasks."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # The salt tells equal rows apart, so they may be dealt to several tasks; any order of them is the same.
    keys = ["conv_id", "turn", "role", "text", "salt"]
    dealt = rows.withColumn("salt", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    return cut(dealt.withColumn("seq", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(seq, conv_id, was, fault) of ordered rows: the role initial and the first fault (blank, duplicate, truncated)."""
    narrow = rows.select(
        "seq", "conv_id", "role", F.md5("text").alias("mark"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        F.col("text").rlike(rf"[.!?][{SPACE}]*\z").alias("whole"))
    # A duplicate's role and text were seen before; a blank row is blank first, wherever it was seen.
    first = narrow.where("NOT blank").groupBy("conv_id", "role", "mark").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("whole"), "truncated")
    return narrow.join(first, "seq", "left").select("seq", "conv_id", F.substring("role", 1, 1).alias("was"), fault.alias("fault"))


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The edits of all conversations in ``rows`` (conv_id, turn, role, text), one row for each.

    conv_id, seq and place (their order), edit, fault and was (fault and role initial of an edited row, null for an insert),
    turn, and role and text after the edit (null for a deleted row).
    """
    rows = ordered(rows)
    marked = cut(faults(rows), "faults")
    initial = F.lit(len(INITIALS) - 1)
    for i, c in enumerate(INITIALS[:-1]):
        initial = F.when(F.col("was") == c, i).otherwise(initial)
    symbol = F.when(F.coalesce("fault", F.lit("")).isin("blank", "duplicate"), 0).otherwise(
        1 + 2 * initial + F.col("fault").isNotNull().cast("int"))
    pieces = marked.select("conv_id", "seq", symbol.cast("byte").alias("symbol")).groupBy(
        "conv_id", F.shiftright("seq", piece).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("seq", "symbol"))).alias("rows"))
    pieces = cut(pieces.select("conv_id", F.col("rows")[0]["seq"].alias("head"), "rows.seq", "rows.symbol"), "pieces")

    def summarise(batch: pa.RecordBatch) -> dict:
        found = [tables().summary(bytes(s)) for s in batch["symbol"].to_pylist()]
        return {"conv_id": batch["conv_id"], "head": batch["head"], "lefts": [v.tolist() for v, _ in found], "states": [s.ravel().tolist() for _, s in found]}

    def fold(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("head", "right", "state", "last")}
        for parts in batch["parts"].to_pylist():
            rights = [0]
            for p in reversed(parts):
                rights.append(p["lefts"][rights[-1]])
            state = 0
            for k, (p, v) in enumerate(zip(parts, rights[-2::-1])):
                for c, x in zip(out, (p["head"], v, state, k + 1 == len(parts))):
                    out[c].append(x)
                state = p["states"][v * STATES + state]
        return out

    def edits(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("seq", "place", "edit", "new")}
        for seqs, symbols, right, state, last in zip(*(batch[c].to_pylist() for c in ("seq", "symbol", "right", "state", "last"))):
            symbols = bytes(symbols)
            for row, place, edit, role in steps(symbols, tables().trace(symbols, right, state), state, last):
                for c, x in zip(out, (seqs[row], place, edit, role)):
                    out[c].append(x)
        return out

    parts = map_batches(pieces, summarise, "conv_id long, head long, lefts array<byte>, states array<byte>")
    parts = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("head", "lefts", "states"))).alias("parts")).select("parts")
    borders = map_batches(parts, fold, "head long, right int, state int, last boolean")
    found = cut(map_batches(pieces.join(borders, "head").drop("conv_id", "head"), edits, "seq long, place int, edit string, new string"), "edits")
    whole = rows.join(marked.drop("conv_id"), "seq").join(found, "seq")
    own, stays = F.col("edit") != INSERT, F.col("edit") != DELETE
    return whole.select(
        "conv_id", "seq", "place", "edit", F.when(own, F.col("fault")).alias("fault"), F.when(own, F.col("was")).alias("was"), F.when(own, F.col("turn")).alias("turn"),
        F.when(stays, F.coalesce("new", "role")).alias("role"), F.when(~own, "").when(stays, F.col("text")).alias("text"))


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Digest:
    """Figures of one conversation, from its edits in order."""

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.sha, self.lines = conv_id, [], hashlib.sha256(), 0
        self.least = self.most = self.was = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def add(self, edit, fault, was, turn, role, text):
        self.audit.append(edit)
        if edit != INSERT:
            if turn is not None:
                self.turns += turn != self.most
                self.least, self.most = turn if self.least is None else self.least, turn
            if fault:
                self.faults[fault] += 1
            self.illegal += self.was is not None and self.was + was not in LEGAL
            self.was = was
        self.cost += {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[edit]
        self.cost += TRUNCATED_COST * (fault == "truncated" and edit != DELETE)
        if edit != DELETE:
            self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, 2**63 - 1)
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def digest(edits: DataFrame) -> DataFrame:
    """Of ``repair``, per conversation: turn gaps (at most 2 ** 63 - 1), faults, illegal neighbours, cost, edits, a hash of its rows."""
    target = edits.sparkSession.createDataFrame([], _DIGEST).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)
    names = ("edit", "fault", "was", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(__name__)
        held = None
        for batch in batches:
            done = []
            for conv_id, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", *names))):
                if held is None or held.conv_id != conv_id:
                    done += [held.row()] if held else []
                    held = _Digest(conv_id)
                held.add(*row)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in done], schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, held.row()))], schema=arrow)

    rows = edits.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place")
    return rows.select("conv_id", *names).mapInArrow(run, _DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """One row in twenty each (by the crc32 of conv_id:turn) is dropped, emptied, loses its ends of sentences, is repeated, becomes a user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """``digest`` of the repaired damaged rows, with a row for each conversation that the damage left without rows too."""
    found = digest(repair(damaged(rows)))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    zero = {c: F.lit(0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, z).alias(c) for c, z in zero.items()])


def sql() -> str:
    """The same in DuckDB SQL: a walk over the rows that keeps, for each state, the least cost, edits and rows so far."""
    space = r"\x20\x09-\x0D"

    def plus(s: str, cost: str, edit: str, line: str) -> str:
        """State string ``s`` (cost in nine digits, edits, chr(1), lines) after one more edit; null stays null."""
        return (f"lpad(CAST(CAST(substr({s}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10, instr({s}, chr(1)) - 10)"
                f" || '{edit}' || substr({s}, instr({s}, chr(1))) || {line}")

    insert = {2: plus("{}", "3", "I", "(chr(10) || 'user:')"), 3: plus("{}", "3", "I", "(chr(10) || 'assistant:')")}
    # Up to two inserts before a row, or at the end.
    once = lambda a, b: (f"SELECT * REPLACE (least(s2, {insert[2].replace('{}', 's0')}, {insert[2].replace('{}', 's1')}, {insert[2].replace('{}', 's3')}) AS s2, "
                         f"least(s3, {insert[3].replace('{}', 's2')}) AS s3) FROM ({a}){b}")
    closed = once(once("SELECT * FROM walk", ""), "")
    line, asked = "(chr(10) || f.role || ':' || f.text)", {2: "(chr(10) || 'user:' || f.text)", 3: "(chr(10) || 'assistant:' || f.text)"}
    extra = "CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END"
    keep = lambda s, c: f"CASE WHEN NOT f.gone AND f.was = '{c}' THEN {plus(s, extra, 'K', line)} END"
    other = lambda s, to: f"CASE WHEN NOT f.gone THEN {plus(s, f'3 + {extra}', 'R', asked[to])} END"
    gone = lambda s: plus(s, "4", "D", "''")
    w = lambda n: f"c.s{n}"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], range(8 * length(name))), lambda c, i:
    CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(name, i // 8 + 1, 1))) ELSE c END) & 1 = 1
      THEN xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(name, i // 8 + 1, 1))) ELSE c END) >> 1, 3988292384)
      ELSE (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(name, i // 8 + 1, 1))) ELSE c END) >> 1 END), 4294967295) % 20 AS code FROM k
), d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h
), o AS (
  SELECT *, substr(role, 1, 1) AS was, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), e AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' END AS fault,
    lag(was) OVER (PARTITION BY conv_id ORDER BY i) || was AS pair FROM o
), f AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone FROM e
), walk AS (
  SELECT DISTINCT conv_id, 0 AS i, '000000000' || chr(1) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM conversations
  UNION ALL
  SELECT c.conv_id, c.i + 1,
    {gone(w(0))},
    least({gone(w(1))}, {keep(w(0), 's')}),
    least({gone(w(2))}, {keep(w(0), 'u')}, {keep(w(1), 'u')}, {keep(w(3), 'u')}, {other(w(0), 2)}, {other(w(1), 2)}, {other(w(3), 2)}),
    least({gone(w(3))}, {keep(w(2), 'a')}, {other(w(2), 3)})
  FROM ({closed}) c JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = c.i + 1
), z AS (
  SELECT conv_id, least(s0, s3) AS s FROM ({closed}) WHERE true QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), g AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(substr(s, 1, 9) AS BIGINT) AS cost,
  substr(s, 10, instr(s, chr(1)) - 10) AS audit, sha256(substr(s, instr(s, chr(1)) + 2)) AS repaired_sha256
FROM z LEFT JOIN g ON z.conv_id IS NOT DISTINCT FROM g.conv_id"""


@query("op13_repaired_turns", sql())
def op13_repaired_turns(spark, sf_dir):
    return repaired_conversations(table(spark, sf_dir, "conversations"))
