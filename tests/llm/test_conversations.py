import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from leaselake.llm import conversations, queries

BLANK = " \t\n\v\f\r"
ROWS = "conv_id long, turn long, role string, text string, cost string, known string, seen int"


def plain_repair(symbols):
    """Cheapest (cost, audit) over all edits, tried one by one up to the cost of deleting all rows."""
    best = (2 * len(symbols), "D" * len(symbols))

    def go(i, roles, audit, cost):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        for role in "ua":
            go(i, roles + role, audit + "I", cost + 5)
        if i < len(symbols):
            s = symbols[i]
            go(i + 1, roles, audit + "D", cost + 2)
            if s != "D":
                more = 5 if s.isupper() else 0
                go(i + 1, roles + s.lower(), audit + "K", cost + more)
                for role in "ua":
                    go(i + 1, roles + role, audit + "R", cost + 1 + more)

    go(0, "", "", 0)
    return best


def plain_report(rows):
    """The rows of the query by plain Python, from (conv, turn, role, text)."""
    out = []
    for conv in sorted({r[0] for r in rows}, key=repr):
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            left += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in left if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, symbols, counts = set(), "", Counter()
        for _, role, text in left:
            own = role[:1] if role[:1] in ("s", "u", "a") else "x"
            end = text.rstrip(BLANK)
            kind = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
            counts[kind] += 1
            symbols += "D" if kind in ("b", "d") else own.upper() if kind else own
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        cost, audit = conversations.cheapest([symbols])[0]
        parts, at, state = [], 0, "start"
        for edit in audit:
            wanted = "assistant" if state == "u" else "user"
            if edit == "I":
                parts.append(f"{wanted}:")
                state = wanted[0]
                continue
            _, role, text = left[at]
            at += 1
            if edit != "D":
                role = wanted if edit == "R" else role
                parts.append(f"{role}:{text}")
                state = role[0]
        digest = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest))
    return out


def some_rows(seed, convs=40):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", "Why? ", "", " \t\f\v", None, f"Text {c} {t}!", f"Open {c} {t}", "é "])
            rows.append((c, rng.choice([t, t, t, t + 3, None, 2]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (900, None, None, None)]
    return rows + rows[:4]


def test_costs_against_all_edits():
    rng = random.Random(1)
    strings = ["", *conversations.SYMBOLS, *("".join(rng.choice("DsuaxSUAXuaua") for _ in range(rng.randint(2, 5))) for _ in range(300))]
    assert conversations.cheapest(strings) == [plain_repair(s) for s in strings]


def test_grammar_gives_the_strings_back():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ua" if i % 2 else "uuuaD") for _ in range(rng.randint(0, 60))) for i in range(80)] + ["u" * 33, "u" * 32]
    rules, written = conversations.re_pair(strings)

    def text(s):
        return chr(s) if s < 256 else text(rules[s - 256][0]) + text(rules[s - 256][1])

    assert ["".join(map(text, w)) for w in written] == strings
    pairs = Counter()
    for w in written:
        at = 0
        while at + 1 < len(w):
            pairs[w[at], w[at + 1]] += 1
            at += 2 if at + 2 < len(w) and w[at] == w[at + 1] == w[at + 2] else 1
    assert rules and max(pairs.values(), default=0) < 2
    assert sum(map(len, written)) + 2 * len(rules) < sum(map(len, strings)) / 2


def test_shared_rules_change_nothing():
    rng = random.Random(3)
    strings = ["s" * (i % 2) + "".join(rng.choice(["ua", "ua", "uua", "D", "X", "uA"]) for _ in range(40)) for i in range(30)]
    assert conversations.cheapest(strings) == [conversations.cheapest([s])[0] for s in strings]


def test_long_conversation():
    n = 30_000
    assert conversations.cheapest(["s" + "ua" * n + "u"]) == [(2, "K" * (2 * n + 1) + "D")]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_plain_python(spark, seed):
    rows = some_rows(seed)
    docs = spark.createDataFrame([(*r, "own", "own", 7) for r in rows], ROWS).repartition(4)
    out = conversations.report(docs)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(plain_report(rows), key=repr)


def test_dropped_conversations_and_empty_tables(spark, folder):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    path = folder("dropped", conversations=table)
    (row,) = queries.op12_repair_grammar(spark, path).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversations.report(table.limit(0)).count() == 0
    assert conversations.repair(table.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "user", "B."), (1, 3, "assistant", "C."), (2, 5, "tool", "T."), (2, 6, "assistant", "")]
    out = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 0, "K", "system", "S."), (1, 1, "K", "user", "B."), (1, 2, "K", "assistant", "C.")]
