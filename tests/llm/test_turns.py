import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import duckdb
import pytest

from auditweave.llm import turns
from auditweave.llm.base import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")


def least_edits(rows):
    """(cost, edits, repaired rows) by trying every edit at every row, in plain recursion over (row, end of the roles)."""

    @lru_cache(maxsize=None)
    def best(i, state):
        # state: what the last kept role was, '' at the start; inserts are bounded, as more never helps.
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            rest = lambda s, c, e, line=(): (best(i + 1, s)[0] + c, e + best(i + 1, s)[1], line + best(i + 1, s)[2])
            options.append(rest(state, 4, "D"))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if fits(state, role[:1]):
                    options.append(rest(role[:1], extra, "K", (f"{role}:{text}",)))
                options += [rest(r[0], 3 + extra, "R", (f"{r}:{text}",)) for r in ("user", "assistant") if fits(state, r[0])]
        if i == len(rows) or state is not None:
            for names in (("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
                s, ok = state, True
                for r in names:
                    ok, s = ok and fits(s, r[0]), r[0]
                if ok:
                    cost, edits, lines = after_inserts(i, s)
                    options.append((cost + 3 * len(names), "I" * len(names) + edits, tuple(f"{r}:" for r in names) + lines))
        return min(options, key=lambda o: o[:2])

    @lru_cache(maxsize=None)
    def after_inserts(i, state):
        if i == len(rows):
            return (0, "", ()) if state == "a" else (10**9, "", ())
        role, text, fault = rows[i]
        options = []
        rest = lambda s, c, e, line=(): (best(i + 1, s)[0] + c, e + best(i + 1, s)[1], line + best(i + 1, s)[2])
        options.append(rest(state, 4, "D"))
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            if fits(state, role[:1]):
                options.append(rest(role[:1], extra, "K", (f"{role}:{text}",)))
            options += [rest(r[0], 3 + extra, "R", (f"{r}:{text}",)) for r in ("user", "assistant") if fits(state, r[0])]
        return min(options, key=lambda o: o[:2])

    return best(0, "")


def fits(before, role):
    return (before, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def with_faults(rows):
    """(turn, role, text) in order -> (role, text, fault)."""
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def naive_digest(conv_id, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    marked = with_faults(rows)
    count = lambda f: sum(m[2] == f for m in marked)
    at = [r[0] for r in rows if r[0] is not None]
    initials = [m[0][:1] for m in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, edits, lines = least_edits(tuple(marked))
    assert PATTERN.fullmatch("".join(x[0] for x in lines))
    return (conv_id, max(at) - min(at) + 1 - len(set(at)) if at else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def naive_damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv_id, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def naive_rows(rows):
    kept = naive_damaged(rows)
    return sorted(repr(naive_digest(c, [r[1:] for r in kept if r[0] == c])) for c in {r[0] for r in rows})


def made(seed, conversations, longest=9):
    r = random.Random(seed)
    role = lambda t: r.choice(["user", "assistant", "system", "tool", "", "User", None]) if r.random() < 0.2 else ["user", "assistant"][t % 2]
    text = lambda: r.choice(["Yes.", "No", "", " \n", "What? ", "a.\tb", "Ok!\n", None, "Fine.", "é?", "x . y", f"{r.random()}."])
    return [(c, t if r.random() < 0.95 else r.choice([None, t + 2, 0]), role(t), text()) for c in range(conversations) for t in range(r.randint(1, longest))]


def test_blocks_agree_with_single_symbols():
    t, r = turns.tables(), random.Random(1)
    for _ in range(400):
        symbols = bytes(r.randrange(turns.SYMBOLS) for _ in range(r.randint(0, 20)))
        right = r.randrange(len(t.vectors))
        lefts, states = t.summary(symbols)
        left, vector = right, []
        for s in reversed(symbols):
            vector.append(left)
            left = int(t.left[1][s, left])
        assert left == lefts[right]
        for state in range(turns.STATES):
            q, edits = state, ""
            for s, v in zip(symbols, reversed(vector)):
                e, q2 = turns._edits(t.vectors[v], s, q)
                edits, q = edits + e, q2
            assert (edits, q) == (t.trace(symbols, right, state), int(states[right][state]))


def test_every_short_conversation():
    t = turns.tables()
    kinds = [("system", "."), ("user", "."), ("assistant", "."), ("tool", "."), ("user", "x"), ("assistant", "x"), ("user", "")]
    for n in range(5):
        for chosen in product(kinds, repeat=n):
            rows = [(role, f"{i}{text}" if text else "", "blank" if not text else "truncated" if text == "x" else None) for i, (role, text) in enumerate(chosen)]
            symbols = bytes(0 if f == "blank" else 1 + 2 * turns.INITIALS.index(role[0] if role[0] in "sua" else "") + (f == "truncated") for role, _, f in rows)
            made = list(turns.steps(symbols, t.trace(symbols, 0, 0), 0, n > 0))
            cost, edits, lines = least_edits(tuple(rows))
            assert "".join(x[2] for x in made) == edits
            out = tuple(f"{role or rows[row][0]}:{'' if e == 'I' else rows[row][1]}" for row, _, e, role in made if e != "D")
            assert out == lines


@pytest.fixture
def table_of(session):
    return lambda rows: session.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, seq int, edit string").repartition(3)


EDGES = [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Yes"), (-5, -3, "user", "A."), (-5, -3, "user", "A."), (-5, -3, "assistant", "B."),
         (900, -(1 << 63), "user", "Hi."), (900, (1 << 63) - 1, "assistant", "Yes."), (901, 4, "assistant", "?" * 9), (902, None, "system", "You.")]
# Conversations of one row that the damage drops.
DROPPED = [(c, 0, "user", "x.") for c in range(1000, 1060)]


def test_query_against_brute_force(table_of):
    rows = made(3, 300) + EDGES + DROPPED
    # A turn gap beyond a long is given as the greatest long.
    want = [w.replace(str(2**64 - 2), str(2**63 - 1)) for w in naive_rows(rows)]
    got = turns.repaired_conversations(table_of(rows))
    assert sorted(repr(tuple(x)) for x in got.collect()) == sorted(want)
    assert sum("'', 'e3b0c442" in w for w in want) > 2
    assert turns.repaired_conversations(table_of([])).count() == 0


@pytest.mark.parametrize("piece", [0, 1, 3])
def test_conversations_in_pieces(table_of, piece):
    r = random.Random(piece)
    one = [(7, t, r.choice(["user", "assistant", "tool"]), r.choice(["Yes.", "No", f"{t}!", "Why?"])) for t in range(120)]
    same = [(8, 1, "user", "Hi.")] * 50
    rows = one + same + made(9, 20) + [(None, t, "user", f"{t}.") for t in range(25)]
    want = sorted(repr(naive_digest(c, [(t, x or "", y or "") for k, t, x, y in plain if k == c])) for plain in [[(c, t, " " if x is None else x, " " if y is None else y) for c, t, x, y in rows]] for c in {r[0] for r in rows})
    edits = turns.repair(table_of(rows), piece)
    assert sorted(repr(tuple(x)) for x in turns.digest(edits).collect()) == want


def test_sql(session, table_of, tmp_path):
    rows = made(5, 150) + [e for e in EDGES if e[0] != 900] + DROPPED
    table_of(rows).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op13_repaired_turns"](session, str(tmp_path))
    want = con.execute(turns.sql()).fetchall()
    assert sorted(repr(tuple(x)) for x in got.collect()) == sorted(map(repr, want))
