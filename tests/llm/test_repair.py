"""Operator 12 against exhaustive search and a plain program over strings."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from msgscope.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """Least (cost, letters) over all edits, by states of the emitted string."""
    bad = faults(rows)
    state = lambda s, x: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(x)
    best = {s: min(((2 * n, "I" * n) for n in range(4) if GOOD.fullmatch(s + tail[n])), default=None) for s, tail in (("", ["", "", "ua", ""]), ("s", ["", "", "ua", ""]), ("u", ["", "a", "", "aua"]))} | {"a": (0, "")}
    for (role, _), f in zip(reversed(rows), reversed(bad)):
        base = {}
        for s in best:
            options = [(3 + best[s][0], "D" + best[s][1])]
            if f not in ("blank", "duplicate"):
                more = f == "truncated"
                n = state(s, role[:1])
                if n:
                    options.append((more + best[n][0], "K" + best[n][1]))
                for x in "ua":
                    n = state(s, x)
                    if n:
                        options.append((2 + more + best[n][0], "R" + best[n][1]))
            base[s] = min(options)
        for _ in range(3):
            for s in base:
                base[s] = min([base[s]] + [(2 + base[n][0], "I" + base[n][1]) for x in "ua" if (n := state(s, x))])
        best = base
    return best[""]


def exhaustive(rows, most=2):
    bad, found = faults(rows), []
    for n_ins in itertools.product(range(most + 1), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(bad, edits)):
                continue
            letters = "".join("I" * n + e for n, e in zip(n_ins, edits)) + "I" * n_ins[-1]
            cost = sum({"D": 3, "K": 0, "R": 2}[e] + (f == "truncated" and e != "D") for e, f in zip(edits, bad)) + 2 * sum(n_ins)
            rest, slots = iter(rows), []
            for x in letters:
                r = next(rest) if x != "I" else None
                slots.append([""] if x == "D" else [r[0][:1]] if x == "K" else ["u", "a"])
            if any(GOOD.fullmatch("".join(p)) and all(x != "K" or y for x, y in zip(letters, p)) for p in itertools.product(*slots)):
                found.append((cost, letters))
    return min(found)


def repaired(rows, letters):
    out, at, last = [], 0, ""
    for x in letters:
        if x != "I":
            role, text = rows[at]
            at += 1
        if x == "D":
            continue
        if x == "K":
            out.append(f"{role}:{text}")
            last = role[0]
        else:
            last = "a" if last == "u" else "u"
            out.append(("assistant:" if last == "a" else "user:") + (text if x == "R" else ""))
    return "\n".join(out)


def expect(rows, harm=True):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in damaged(rows) if harm else [(c, t, " " if role is None else role, " " if x is None else x) for c, t, role, x in rows]:
        groups[r[0]].append(r)
    out = {}
    for c, g in groups.items():
        g.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        pairs = [r[2:] for r in g]
        f, turns = faults(pairs), {r[1] for r in g} - {None}
        cost, audit = plain(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        sha = hashlib.sha256(repaired(pairs, audit).encode()).hexdigest()
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def talk(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "Sys", "s"])
            text = rng.choice(["Yes.", "No", "why?", "", " \n", None, "a b c!", "x\x1c", "é. \t"]) if rng.random() < 0.7 else f"text {c} {t}."
            if rng.random() < 0.9:
                rows.append((c - 3 if c else None, t if rng.random() < 0.97 else t + 5, role, text))
    # ties in turn would be ordered by a hash: leave one row of each turn
    return list({(r[0], r[1]): r for r in rows}.values())


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_plain_equals_exhaustive():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randrange(4))]
        assert plain(rows) == exhaustive(rows), rows


def test_runs_equal_plain():
    rng = random.Random(9)
    for n in range(500):
        rows = []
        while len(rows) < rng.choice([0, 1, 4, 20, 120]):
            role, stop = rng.choice(["system", "user", "assistant", "tool"]), rng.choice([".", "", "x"])
            rows += [(role, f"{len(rows)}-{i}{stop}" if stop != "x" else " ") for i in range(rng.choice([1, 1, 2, 9]))]
        runs = repair.Runs()
        for (role, _), f in zip(rows, faults(rows)):
            runs.add(repair.GONE if f in ("blank", "duplicate") else 1 + 2 * repair.CLASS.get(role[:1], 3) + (f == "truncated"))
        assert runs.solve() == plain(rows), rows


def test_long_run_by_powers():
    """A million equal rows take a number of steps like the letters of the result."""
    runs = repair.Runs()
    runs.add(1 + 2 * repair.CLASS["u"], 1_000_000)
    cost, audit = runs.solve()
    assert cost == 1_000_000 and len(runs.symbols) == 1  # every second one becomes the assistant's
    assert audit == "KR" * 500_000


def test_summary(spark):
    rows = talk(1, 120) + [(500, t, "user" if t % 2 else "assistant", "again and again") for t in range(400)]
    rows += [(600, None, "system", "x."), (600, 3, "user", "long " * 200_000 + "."), (600, 9, "assistant", "fine.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("copies", F.lit("x")).withColumn("blank", F.lit(1)).withColumn("h1", F.lit(0))
    assert got(repair.summary(repair.damage(df))) == expect(rows)
    assert got(repair.summary(repair.turns(df))) == expect(rows, harm=False)
    assert repair.summary(repair.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_nothing_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = got(repair.summary(repair.damage(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA))))
    assert out == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_ties_and_repeated_rows(spark):
    """Rows of one turn have an order of their own, whatever the input's."""
    rows = [(1, 0, "user", "b."), (1, 0, "assistant", "a."), (1, 0, "user", "b."), (1, None, "user", "b."), (1, None, None, None)] * 2
    a, b = (got(repair.summary(repair.turns(spark.createDataFrame(r, SCHEMA).repartition(n)))) for r, n in ((rows, 3), (rows[::-1], 1)))
    assert a == b and a[1][1:3] == (2, 6)


def test_repaired_rows(spark):
    rows = talk(2, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for r in sorted(repair.repair(repair.damage(df)).collect(), key=lambda r: (r["conv_id"] or -99, r["pos"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = expect(rows)
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
