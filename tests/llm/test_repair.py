"""Conversation repair: the trie's layers against full strings and against all edits, and whole results against plain code."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tabulens.llm import repair

SOLID = r"[^\x20\x09-\x0D]"


def cheapest(turns):
    """Least (cost, initials) over plain strings for turns (initial, fault); layers of dictionaries, no ranks."""
    nxt = {"": "su", "s": "u", "u": "a", "a": "u"}

    def fill(layer):
        layer = dict(layer)
        for _ in range(3):
            for s, (c, e) in list(layer.items()):
                t = "a" if s == "u" else "u"
                layer[t] = min(layer.get(t, (10**9, "")), (c + 5, e + "I"))
        return layer

    layer = {"": (0, "")}
    for role, fault in turns:
        new = {}
        for s, (c, e) in fill(layer).items():
            options = [(s, c + 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options += [(r, c + 1 + more, "R") for r in "ua" if r in nxt[s]]
                options += [(role, c + more, "K")] if role and role in nxt[s] else []
            for t, cost, edit in options:
                new[t] = min(new.get(t, (10**9, "")), (cost, e + edit))
        layer = new
    return min(v for s, v in fill(layer).items() if s in ("", "a"))


def exhaustive(turns):
    """Least (cost, initials) over all edits with at most two inserted turns at each place."""
    best = (10**9, "")
    choices = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", r), ("R", "u"), ("R", "a")]) for r, f in turns]
    fills = [x for k in range(3) for x in itertools.product("ua", repeat=k)]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(fills, repeat=len(turns) + 1):
            cost, initials, roles = 0, "", ""
            for i, gap in enumerate(gaps):
                cost, initials, roles = cost + 5 * len(gap), initials + "I" * len(gap), roles + "".join(gap)
                if i < len(turns):
                    edit, role = edits[i]
                    cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if turns[i][1] == "truncated" and edit != "D" else 0)
                    initials, roles = initials + edit, roles + (role or "")
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best, (cost, initials))
    return best


def brute(rows, damage=True):
    """The contract's columns by conversation."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, held in by.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        turns, seen = [], set()
        for _, role, text in held:
            solid = re.findall(SOLID, text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role[:1], fault))
        numbers = [t for t, _, _ in held if t is not None]
        cost, audit = cheapest(turns)
        lines, at = [], iter(held)
        odd = 0
        for edit in audit:
            free = "user" if odd % 2 == 0 else "assistant"
            if edit == "I":
                lines.append(f"{free}:")
                odd += 1
                continue
            _, role, text = next(at)
            if edit == "K":
                lines.append(f"{role}:{text}")
                odd += role[:1] != "s"
            elif edit == "R":
                lines.append(f"{free}:{text}")
                odd += 1
        count = collections.Counter(f for _, f in turns)
        initials = [r for r, _ in turns]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def random_rows(rnd, conversations):
    words = ["Yes.", "No!", "Why?", "and then", "ok.", "", " \n", "cut off", "Dr. No ", "é漢.", "end.\x1c", "a.\n"]
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randint(1, 9)):
            for _ in range(1 + (rnd.random() < 0.1)):
                rows.append((conv, None if rnd.random() < 0.08 else turn + rnd.choice([0, 0, 0, 1, 3]), rnd.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "User"]), rnd.choice(words * 3 + [None])))
    return rows


def test_layers_against_all_edits():
    """Every signature of up to three turns, and longer ones against full strings."""
    by_symbol = dict(zip(repair.SYMBOLS, [(r, repair.FAULTS[f]) for r in "suao" for f in range(4)], strict=True))
    for n in range(3):
        for some in itertools.product("suaoUAx", repeat=n):
            turns = [by_symbol[x] for x in some]
            assert repair.TriePath().answer("".join(some)) == exhaustive(turns) == cheapest(turns)
    rnd, path = random.Random(1), repair.TriePath()
    for s in sorted("".join(rnd.choice("suaSUAox") for _ in range(rnd.randint(0, 25))) for _ in range(2000)):
        assert path.answer(s) == cheapest([by_symbol[x] for x in s]), s


def test_shared_prefixes_are_computed_once():
    rnd = random.Random(2)
    some = sorted({"".join(rnd.choice("sua") for _ in range(rnd.randint(0, 8))) for _ in range(500)})
    path = repair.TriePath()
    for s in some:
        path.answer(s)
    assert path.computed == len({s[:k] for s in some for k in range(1, len(s) + 1)})


@pytest.mark.parametrize("damage", [True, False])
def test_whole_results(spark, damage, monkeypatch):
    rows = random_rows(random.Random(3), 400)
    rows += [(None, t, r, "Null id.") for t, r in [(0, "user"), (None, "assistant"), (1, None)]] + rows[:7]
    rows += [(999, t, ["user", "assistant"][t % 2], f"Turn {t % 700}.") for t in range(3000)]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, kind int, mark string").repartition(7)
    turns = repair.damaged(repair.turns(df)) if damage else repair.turns(df)
    plans = repair.cut(repair.planned(turns), "plans")
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(turns, plans).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes[r.conv_id]) for r in plans.collect()}
    want = brute(rows, damage)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], (conv, [r for r in rows if r[0] == conv])
    if not damage:
        plans, done = repair.repair(df)
        for conv, held in itertools.groupby(sorted(done.collect(), key=lambda r: (str(r.conv_id), r.place)), key=lambda r: r.conv_id):
            held = list(held)
            assert [r.place for r in held] == list(range(len(held)))
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in held).encode()).hexdigest() == want[conv][-1]


def test_parts_of_one_conversation(spark, monkeypatch):
    """A conversation whose turns lie in several partitions, a turn number across their edges."""
    rows = [(1, t // 5, "user", f"Turn {t}.") for t in range(500)] + [(1, None, "system", f"n {t}") for t in range(40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = repair.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        split = repair.parts(repair.coded(turns))
        assert split.count() > 1
        got = repair.summaries(split).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = brute(rows, damage=False)[1]
    assert (got.gaps, got.blank, got.duplicate, got.truncated, got.illegal) == want[:5]
    assert len(got.signature) == 540


def test_all_dropped_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    turns = repair.damaged(repair.turns(df))
    plans = repair.planned(turns)
    assert [tuple(r) for r in plans.collect()] == [(gone, 0, 0, 0, 0, 0, 0, "")]
    assert repair.digests(turns, plans).first().repaired_sha256 == hashlib.sha256(b"").hexdigest()
    turns = repair.damaged(repair.turns(df.where("conv_id < 0")))
    assert repair.planned(turns).count() == 0 and repair.digests(turns, repair.planned(turns)).count() == 0
