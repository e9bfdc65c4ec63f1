"""Conversation repair: every column against brute force, ropes against strings, and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from ratecard.llm import conversation_repair as cr

WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest())
    return sorted(out, key=key)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        chars = WORD.findall(text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen
                   else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, marks, most):
    """All edit scripts with at most ``most`` inserts."""
    best = None
    stack = [(0, 0, 0, "", ())]
    while stack:
        i, cost, ins, audit, out = stack.pop()
        if i == len(rows) and LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            new = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
            best = new if best is None or new[:2] < best[:2] else best
        if ins < most:
            for role in ("user", "assistant"):
                stack.append((i, cost + 2, ins + 1, audit + "I", (*out, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            stack.append((i + 1, cost + 3, ins, audit + "D", out))
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                stack.append((i + 1, cost + more, ins, audit + "K", (*out, (role, text))))
                for new in ("user", "assistant"):
                    stack.append((i + 1, cost + 2 + more, ins, audit + "R", (*out, (new, text))))
    return best


def dynamic(rows, marks):
    """The same by plain strings, one row after another."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def grow(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        put(best, step[state, role[0]], (cost + 2, audit + "I", out + ((role, ""),)))
        return best

    def put(best, state, new):
        if state not in best or new[:2] < best[state][:2]:
            best[state] = new

    best = grow({"": (0, "", ())})
    for (_, _, role, text), mark in zip(rows, marks):
        after = {}
        for state, (cost, audit, out) in best.items():
            put(after, state, (cost + 3, audit + "D", out))
            if mark not in ("blank", "duplicate"):
                for new, letter, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    if (state, new[:1]) in step:
                        put(after, step[state, new[:1]],
                            (cost + price + (mark == "truncated"), audit + letter, out + ((new, text),)))
        best = grow(after)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = damaged([r for r in table if r[0] == conv])
        marks = faults(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        initials = [r[2][:1] for r in rows]
        cost, audit, text = dynamic(rows, marks)
        if len(rows) <= 3:
            assert exhaustive(rows, marks, 3) == (cost, audit, text)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(marks.count, ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(n, seed=3):
    rng = random.Random(seed)
    said = ["yes.", "no", "Well then!", "", " \t", "what?", "a b", "fine. ", "é", "«x.»"]
    rows = []
    for conv in range(n):
        turns = rng.choice([0, 1, 1, 2, 3, 3, 4, 6, 8, 12])
        at = rng.randint(-3, 3)
        for i in range(turns):
            at += rng.choice([0, 1, 1, 1, 1, 3])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "s", "ux"])
            if rng.random() < 0.6:
                role = ["user", "assistant"][i % 2]
            rows.append((conv, rng.choice([at] * 9 + [None]), role, rng.choice([*said, None, f"t{conv}{i}."])))
    rows += [r for r in rows if rng.random() < 0.05]
    return rows + [(None, 1, "user", "hm."), (None, None, None, None), (None, 2, "assistant", "hm.")]


def result(spark, rows):
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, copies int, digest string")
    got = cr.repair(frame).collect()
    assert got == [] or got[0].__fields__ == ["conv_id", *cr.COUNT_NAMES, "repaired_sha256"]
    out = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def test_every_conversation_against_brute_force(spark):
    rows = conversations(400)
    want = expected(rows)
    got = result(spark, rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert any(w[6] == "" and w[1] + w[2] == 0 for w in want.values())  # one whose rows were all dropped


def test_one_long_conversation_over_many_tasks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(5, i, ["user", "assistant", "system"][min(rng.randrange(9), 2)], f"{i % 700}.") for i in range(3000)]
    rows += [(6, i % 3, "user", "same.") for i in range(500)] + [(7, 0, "user", "a."), (7, 1, "assistant", "b.")]
    assert result(spark, rows) == expected(rows)


def test_a_bound_on_the_grammar_changes_nothing(spark, monkeypatch):
    rows = conversations(60, seed=4)
    want = expected(rows)
    for rounds, rules in ((0, 64), (1, 1), (3, 2)):
        monkeypatch.setattr(cr, "ROUNDS", rounds)
        monkeypatch.setattr(cr, "RULES", rules)
        assert result(spark, rows) == want


def test_empty_table(spark):
    assert result(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_rewriting_keeps_what_symbols_stand_for(seed):
    rng = random.Random(seed)
    strings = ["".join(chr(65 + rng.choice([0, 1, 2, 8, 13])) for _ in range(rng.randrange(30))) for _ in range(40)]
    codes, _ = cr.symbols_of(strings)
    plain, grammar, symbol = codes, [], cr.ALPHABET
    for _ in range(6):
        at = cr.pair_places(codes)
        counted = {}
        for a, b in zip(codes[at].tolist(), codes[at + 1].tolist()):
            counted[a, b] = counted.get((a, b), 0) + 1
        rules = cr.chosen(sorted(counted, key=lambda p: (-counted[p], p))[:5], symbol)
        sides = [{r[k] for r in rules} for k in (0, 1)]
        assert all(a == b for a, b, _ in rules if a in sides[1] or b in sides[0])
        shorter = cr.rewritten(codes, rules)
        assert len(shorter) < len(codes)
        grammar, symbol, codes = [*grammar, rules], symbol + len(rules), shorter
    parts = {n: (a, b) for rules in grammar for a, b, n in rules}
    whole = lambda x: [x] if x not in parts else whole(parts[x][0]) + whole(parts[x][1])
    assert sum(map(whole, codes.tolist()), []) == plain.tolist()
    assert np.array_equal(np.flatnonzero(plain == -1) + 1, np.cumsum([len(s) + 1 for s in strings]))


def test_ropes_compare_like_strings():
    rng = random.Random(1)
    ropes = [cr.Rope(t) for t in ("", "D", "K", "KI", "RD", "KK")]
    for _ in range(300):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b)) and str(a + b) == str(a) + str(b)
        ropes.append(a + b) if len(str(a + b)) < 200 else None
