import random
import re
from collections import Counter

import duckdb
import pytest

from leaselake.llm import quality as Q

from .conftest import lines, words


def facts(text):
    """The base facts by their wording, in plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x, n in Counter(windows).items() if n > 1}
    inside = {j for i, x in enumerate(windows) if x in many for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


SAMPLES = [
    "", " \t", "a", "a b c a b c", "a a a a a", "x\n\nx\n \nx", lines(1, 9), words(2, 60).upper(), words(3, 60).replace(" ", " | "),
    "word " * 70, lines(4, 6) + "\n" + "same line here\n" * 9, words(5, 80).replace(" ", "!! "), "é ï " * 40 + words(6, 60),
]


@pytest.mark.parametrize("text", SAMPLES)
def test_facts(text):
    f = Q.Facts(text.encode())
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == facts(text)


def test_facts_of_random_words():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choices("abc", k=rng.randint(0, 30)))
        assert Q.Facts(text.encode()).n_repeat_words == facts(text)[4]


def test_rules_reject_junk_and_keep_prose():
    verdicts = [Q.passes(Q.Facts(t.encode()), list(Q.RULES)) and not Q.Facts(t.encode()).base_failed for t in SAMPLES]
    assert verdicts[6] and not any(v for i, v in enumerate(verdicts) if i not in (6, 12))


def test_order_is_by_rejections_per_second_and_any_order_gives_one_verdict():
    estimates = {name: (1.0, 0.1) for name in Q.RULES} | {"symbols": (0.1, 0.2), "stuttering": (2.0, 0.5)}
    assert Q.order_of(estimates)[:2] == ["symbols", "stuttering"]
    assert sorted(Q.order_of({})) == sorted(Q.RULES)
    for text in SAMPLES:
        f = Q.Facts(text.encode())
        assert len({Q.passes(f, order) for order in (list(Q.RULES), list(Q.RULES)[::-1])}) == 1


def test_same_as_sql(spark):
    rows = [(i, t) for i, t in enumerate([*SAMPLES, None])]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).drop("text")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(Q.SQL).fetchall())


def test_awkward_rows(awkward, empty):
    got = Q.judge(awkward)
    assert got.count() == awkward.count()
    for r in got.select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect():
        assert tuple(r)[1:] == facts(r.text or "")
    kept = Q.keep_good(awkward)
    assert kept.columns == awkward.columns and {r.kept for r in kept.collect()} == {"own kept"}
    assert Q.judge(empty).count() == 0 and Q.keep_good(empty).columns == empty.columns
