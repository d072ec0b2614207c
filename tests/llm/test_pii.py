import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from leaselake.llm import pii as P

from .conftest import awkward_rows, words


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def plain_spans(text):
    """The fixed patterns as they are worded."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


CARD = "4111 1111 1111 1111"
SAMPLES = [
    "", "a@b.c", "a@b.c@d.e x@y", "a.b+c@d-e.f.g, @x.y z@", "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.2.3.004", CARD, "4111-1111-1111-1112",
    "+1 (017) 555-7713 and +12 34", "x+1 (017) 555-7713 4.5.6.7", "é日 a@b.co 🙂 +49 30 123456 ١٢٣", "4111111111111111 4111111111111111",
]


def test_patterns():
    rng = random.Random(6)
    samples = SAMPLES + ["".join(rng.choices("a@.1 +-(4", k=rng.randint(0, 40))) for _ in range(3000)]
    for text in samples:
        assert P.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", [
    "0" * 5000 + "1.2.3.4", "1" * 1_000_000, "0" * 1_000_000 + ".0.0.0", "1." * 500_000, "+1" * 500_000, "+1" + "(" * 1_000_000, "1 " * 500_000,
    "@" * 1_000_000, "a" * 1_000_000 + "@", "9" * 5000 + ".1.1.1", "1.2.3." * 300_000 + "x", "-" * 1_000_000, "1-" * 500_000,
])
def test_long_runs_take_seconds_at_most(text):
    start = time.time()
    found = P.base_spans(text)
    P.tokens(text)
    assert time.time() - start < 5
    if text.startswith("0"):
        assert [k for k, _, _ in found if k == 1] == [1]


def test_runs_lie_all_over_a_text():
    assert P.runs(512, 1) == [(0, 512)] and P.runs(0, 1) == [(0, 0)]
    found = P.runs(100_000, 3)
    assert len(found) == P.RUNS and found == P.runs(100_000, 3) != P.runs(100_000, 4)
    assert all(e - s == P.RUN for s, e in found) and all(i * 12_500 <= s < e <= (i + 1) * 12_500 for i, (s, e) in enumerate(found))


def test_model_does_not_depend_on_partitions(spark):
    rows = [(i, f"{words(i, 3)} u{i}@mail.example.com {i}.2.3.4 v{i} 555-{i}") for i in range(60)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    a, b = (P.learn(d) for d in (docs.repartition(7), docs.coalesce(1)))
    assert np.array_equal(a.unary, b.unary) and np.array_equal(a.pair, b.pair)


def test_hidden_matches_come_back():
    texts = [f"mail ada{i}@mail.example.com {words(i, 9)} ada{i}@mail.example.com and 10.2.{i}.4 or 10.2.{i}.4" for i in range(60)]
    hidden, labelled, right = P.recovered(texts, MODEL)
    assert hidden > 40 and labelled >= 0.9 * hidden and right == labelled


def trained():
    rng = random.Random(7)
    counted = Counter()
    for i in range(300):
        kinds = [f"+1 (0{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)}", f"u{rng.randint(1, 99)}@mail.example.com",
                 ".".join(str(rng.randint(0, 255)) for _ in range(4)), f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}", str(rng.randint(1900, 2100))]
        text = f" {words(i, 5)} ".join(rng.sample(kinds, 3))
        field = P.Field()
        field.add(0, text, P.base_spans(text))
        counted.update(P.cases(field))
    return P.fit(counted)


MODEL = trained()


def test_repeats_take_the_label_of_a_match():
    text = f"call +1 (017) 555-7713 now. {words(1, 30)} again 555-7713 in {words(2, 20)} 2024"
    (base, added), = P.find([text], MODEL)
    assert [k for k, _, _ in base] == [3]
    assert [(k, text[s:e]) for k, s, e in added] == [(3, "555-7713")]


def test_a_lone_sign_does_not_stretch_a_span():
    text = f"call +1 (017) 555-7713 now. {words(1, 30)} 555-7713 @ 555-7713 end"
    (_, added), = P.find([text], MODEL)
    assert all("@" not in text[s:e] for _, s, e in added)


def test_plain_numbers_get_no_label():
    for text in ("version 3.0 of 2024", "4111111111111112 alone", words(3, 50), "1 2 3 4 5"):
        (base, added), = P.find([text], MODEL)
        assert (base, added) == ([], [])


def test_marginals_are_exact_on_a_tree():
    """Loopy passing against summing over all labellings, on a chain."""
    field = P.Field()
    field.add(0, "v1.2 99 7.7 x1 2020", [])
    model = P.Model(MODEL.unary * 0.3, MODEL.pair * 0.3)
    node, n = model.node_scores(field.features), len(field.spans)
    import itertools

    total = np.zeros((n, P.LABELS))
    for labels in itertools.product(range(P.LABELS), repeat=n):
        weight = np.exp(sum(node[i, y] for i, y in enumerate(labels)) + sum(model.pair[k, labels[a], labels[b]] for a, b, k in field.edges))
        for i, y in enumerate(labels):
            total[i, y] += weight
    assert np.allclose(model.marginals(field), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_many_similar_tokens_stay_linear():
    field = P.Field()
    field.add(0, " ".join(["9999888877776666"] * 5000), [])
    assert len(field.edges) <= 4 * len(field.spans)


def test_masking():
    text = "to a@b.co or 1.2.3.4 end"
    assert P.masked(text, P.base_spans(text)) == "to [EMAIL] or [IP] end"
    assert P.masked("abc", []) == "abc" and P.masked("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a[EMAIL]f"


def test_awkward_rows(awkward, empty):
    texts = [*SAMPLES, None]
    got = P.spans(awkward.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in got:
        want = plain_spans(r.text or "")
        assert r.base_spans == ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))
    found = P.spans(awkward)
    assert found.count() == len(awkward_rows()) and set(awkward.columns) <= set(found.columns)
    clean = P.redact(awkward)
    assert clean.columns == awkward.columns
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(r[:2]) for r in awkward_rows())
    assert P.spans(empty).count() == 0 and P.redact(empty).count() == 0


def test_the_stage_learns_from_all_texts(spark, monkeypatch):
    """Every token of every different text is in the fit of the stage, copies once, nulls not."""
    monkeypatch.setattr(P, "TRAIN_DOCUMENTS", 3)
    rows = [(i, f"{words(i, 3)} u{i}@mail.example.com {i}.2.3.4 v{i} 555-{i}") for i in range(20)]
    rows += [(90, " ".join(f"{i} x{i}" for i in range(400))), (91, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(P, "fit", lambda counted: seen.append(counted) or MODEL)
    P.redact(docs, length=None)
    assert sum(seen[0].values()) == sum(len(P.tokens(t)) for _, t in rows if t)


def test_cases_that_stay_in_tasks_give_the_same_model(spark, monkeypatch):
    monkeypatch.setattr(P, "STEPS", 12)
    rows = [(i, f"{words(i, 3)} u{i}@mail.example.com {i}.2.3.4 v{i} 555-{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = P.learn(docs, whole=True)
    monkeypatch.setattr(P, "TRAIN_CASES", 5)
    far = P.learn(docs, whole=True)
    assert np.allclose(near.unary, far.unary) and np.allclose(near.pair, far.pair)
    assert not np.allclose(near.unary, P.learn(docs).unary)
