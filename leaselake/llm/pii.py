"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels further.

The field has a node for each token (run of non-blank characters) that holds a digit or an at sign. Next
tokens are linked as a chain; tokens of a document with the same or a similar core (letters and digits) are
linked by skip edges, each to the next occurrence, however far. Tokens under a pattern match keep its label;
loopy message passing gives the others their marginals, and sure ones become spans of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.common import map_chunks, texts, with_fields
from leaselake.operators.skew import broadcast_if_small
from leaselake.session import stored

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1

# Fixed patterns of the four kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A start that fails fails for its whole run of digits, so only the first digit of a run starts a match.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Different texts to fit the field on at most, and different cases (token features, label, neighbours' labels).
TRAIN_DOCUMENTS = 20_000
TRAIN_CASES = 100_000
#: Tokens of each text in the fit: runs of RUN at seeded places all over it, or all of a text with fewer than RUNS * RUN.
RUN, RUNS = 64, 8
#: Percent of the pattern matches whose label the fit hides from their neighbours.
HIDDEN = 30
SEED = 20_250_707
#: Marginal from which a label becomes a span.
SURE = 0.95
ROUNDS = 30
DAMPING = 0.3
STEPS = 400
PENALTY = 0.01
#: Code points of a core that make two tokens similar.
CORE = 6

Span = tuple[int, int, int]


def _luhn(digits: str | list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of all pattern matches, by kind and then start.

    An email is looked for at each at sign: its local part is the run of allowed characters before it, back
    to the last match, which is what the whole pattern matches from the left.
    """
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_SIGN = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_CORE = re.compile(r"[^0-9A-Za-z@]+")


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of each non-blank run that holds a digit or an at sign."""
    out, end = [], 0
    found = _SIGN.search(text)
    while found:
        start = found.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, found.start())
        end = blank.start() if blank else len(text)
        out.append((start, end))
        found = _SIGN.search(text, end)
    return out


_BUCKETS = (0, 1, 2, 3, 4, 7, 10, 13, 16, 20)
_MARKS = "@.+()-:/=\"%#"
FEATURES = 1 + 3 * len(_BUCKETS) + 3 * len(_MARKS) + 5
#: Prior weight for equal labels along each kind of edge, towards which the fit is held.
AGREEMENT = (0.0, 4.0, 2.0)


def _bucket(n: int) -> int:
    return sum(n >= b for b in _BUCKETS) - 1


def features(token: str) -> list[int]:
    """Numbers of the features a token has: counts of digits, letters and dots, marks, shape."""
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    out = [0, 1 + _bucket(digits), 1 + len(_BUCKETS) + _bucket(letters), 1 + 2 * len(_BUCKETS) + _bucket(token.count("."))]
    base = 1 + 3 * len(_BUCKETS)
    for i, mark in enumerate(_MARKS):
        if mark in token:
            out.append(base + 3 * i)
            if token[0] == mark:
                out.append(base + 3 * i + 1)
            if token[-1] == mark:
                out.append(base + 3 * i + 2)
    base += 3 * len(_MARKS)
    if digits == len(token):
        out.append(base)
    if token[0].isdigit():
        out.append(base + 1)
    if "." in token and all(p.isdigit() for p in token.split(".")):
        out.append(base + 2)
    if "@" in token and "." in token.rpartition("@")[2]:
        out.append(base + 3)
    if digits >= 16 and not _luhn([c for c in token if c in "0123456789"]):
        out.append(base + 4)
    return out


class Field:
    """Nodes and edges of some documents. Edge kinds: 0 chain, 1 same core, 2 similar core."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.owner: list[int] = []
        self.features: list[list[int]] = []
        self.given: list[int] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, owner: int, text: str, base: list[Span], kept: list[tuple[int, int]] | None = None) -> None:
        """Nodes and edges of a text, or of the tokens (first, end) in ``kept``."""
        covered = sorted((s, e, k) for k, s, e in base)
        seen: tuple[dict[str, int], ...] = ({}, {}, {})
        before, place = -1, 0
        found = tokens(text)
        for start, end in found if kept is None else [t for first, last in kept for t in found[first:last]]:
            node, token = len(self.spans), text[start:end]
            while place < len(covered) and covered[place][1] <= start:
                place += 1
            over = [k for s, e, k in covered[place : place + 4] if s < end and e > start]
            self.spans.append((start, end))
            self.owner.append(owner)
            self.features.append(features(token))
            self.given.append(min(over) if over else -1)
            if before >= 0 and text[before:start].isspace():
                self.edges.append((node - 1, node, 0))
            before = end
            core = _CORE.sub("", token).lower()
            if len(core) < CORE:
                continue
            linked = set()
            for i, key in enumerate((core, f"{len(core)}<{core[:CORE]}", f"{len(core)}>{core[-CORE:]}")):
                other = seen[i].get(key)
                if other is not None and other not in linked:
                    linked.add(other)
                    self.edges.append((other, node, 1 if i == 0 else 2))
                seen[i][key] = node


class Model:
    """Weights of features by label, and of label pairs by edge kind."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def node_scores(self, rows: list[list[int]]) -> np.ndarray:
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        out = np.zeros((len(rows), LABELS))
        np.add.at(out, owner, self.unary[np.concatenate([np.array(r) for r in rows])])
        return out

    def marginals(self, field: Field) -> np.ndarray:
        """Label probabilities of every node by damped loopy sum-product; given labels are fixed."""
        node = self.node_scores(field.features)
        given = np.array(field.given)
        fixed = np.flatnonzero(given >= 0)
        node[fixed] = -50.0
        node[fixed, given[fixed]] = 0.0
        node = np.exp(node - node.max(axis=1, keepdims=True))
        if not field.edges:
            return node / node.sum(axis=1, keepdims=True)
        a, b, kind = np.array(field.edges).T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.exp(np.clip(self.pair, -20, 20))
        tables = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
        message = np.full((len(source), LABELS), 1 / LABELS)
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        for _ in range(ROUNDS):
            logs = np.zeros_like(node)
            np.add.at(logs, target, np.log(message))
            # What a node says to another leaves out what that one said to it.
            cavity = np.log(node[source] + 1e-30) + logs[source] - np.log(message[back])
            cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            new = np.einsum("el,elm->em", cavity, tables) + 1e-30
            new /= new.sum(axis=1, keepdims=True)
            new = DAMPING * message + (1 - DAMPING) * new
            moved = np.abs(new - message).max()
            message = new
            if moved < 1e-4:
                break
        logs = np.log(node + 1e-30)
        np.add.at(logs, target, np.log(message))
        belief = np.exp(logs - logs.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


Case = tuple[tuple[int, ...], int, tuple[int, ...]]


def cases(field: Field, hidden: np.ndarray | None = None) -> list[Case]:
    """Features, label and neighbours of each node; a neighbour is its edge kind, end and label as one number.

    Nodes marked as hidden say nothing to their neighbours, as tokens without a match do in use.
    """
    near: list[list[int]] = [[] for _ in field.spans]
    label = [OTHER if g < 0 else g for g in field.given]
    for a, b, kind in field.edges:
        if hidden is None or not hidden[b]:
            near[a].append((kind * 2) * LABELS + label[b])
        if hidden is None or not hidden[a]:
            near[b].append((kind * 2 + 1) * LABELS + label[a])
    return [(tuple(f), y, tuple(sorted(n))) for f, y, n in zip(field.features, label, near)]


class Cases:
    """Cases and their numbers as arrays."""

    def __init__(self, rows: list[Case], weight: list[int]):
        self.n, self.weight = len(rows), np.array(weight, dtype=float)[:, None]
        self.truth = np.eye(LABELS)[np.array([r[1] for r in rows], dtype=np.int64)]
        self.owner = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])
        self.at = np.array([f for r in rows for f in r[0]], dtype=np.int64)
        self.node = np.repeat(np.arange(self.n), [len(r[2]) for r in rows])
        code = np.array([c for r in rows for c in r[2]], dtype=np.int64)
        self.kind, self.behind, self.other = code // (2 * LABELS), code // LABELS % 2 == 1, code % LABELS

    def push(self, model: Model, unary: np.ndarray, pair: np.ndarray) -> None:
        """Add the direction in which these cases move the weights."""
        kind, behind, other, node = self.kind, self.behind, self.other, self.node
        scores = np.zeros((self.n, LABELS))
        np.add.at(scores, self.owner, model.unary[self.at])
        said = np.where(behind[:, None], model.pair[kind, other, :], model.pair[kind, :, other])
        np.add.at(scores, node, said)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = (self.truth - p / p.sum(axis=1, keepdims=True)) * self.weight
        np.add.at(unary, self.at, error[self.owner])
        np.add.at(pair, (kind[~behind], slice(None), other[~behind]), error[node[~behind]])
        np.add.at(pair, (kind[behind], other[behind]), error[node[behind]])


def _climb(push: Callable[[Model, np.ndarray, np.ndarray], None]) -> Model:
    """Pseudo-likelihood: each node's label given its features and its neighbours' pattern labels."""
    prior = np.array(AGREEMENT)[:, None, None] * np.eye(LABELS)
    model = Model(np.zeros((FEATURES, LABELS)), prior.copy())
    rate = {"unary": np.full_like(model.unary, 1e-8), "pair": np.full_like(model.pair, 1e-8)}
    for _ in range(STEPS):
        unary, pair = -PENALTY * model.unary, -PENALTY * (model.pair - prior)
        push(model, unary, pair)
        for name, weights, gradient in (("unary", model.unary, unary), ("pair", model.pair, pair)):
            rate[name] += gradient**2
            weights += 0.5 * gradient / np.sqrt(rate[name])
    return model


def fit(counted: dict[Case, int]) -> Model:
    """Fit on cases by number."""
    if not counted:
        model = Model(np.zeros((FEATURES, LABELS)), np.array(AGREEMENT)[:, None, None] * np.eye(LABELS))
        model.unary[0, OTHER] = 10.0  # nothing to learn from: nothing is added
        return model
    rows = sorted(counted)
    return _climb(Cases(rows, [counted[r] for r in rows]).push)


def fit_spread(counted: DataFrame) -> Model:
    """The same fit where the cases stay in tasks: each step, every task sends one direction of fixed size."""
    size = FEATURES * LABELS

    def push(model: Model, unary: np.ndarray, pair: np.ndarray) -> None:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros_like(unary), np.zeros_like(pair)
            for batch in batches:
                features, label, near, n = (batch.column(c).to_pylist() for c in ("features", "label", "near", "n"))
                Cases(list(zip(features, label, near)), n).push(model, *own)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([o.ravel() for o in own])], pa.list_(pa.float64()))], ["moved"])

        for row in counted.mapInArrow(step, "moved array<double>").collect():
            moved = np.array(row.moved)
            unary += moved[:size].reshape(unary.shape)
            pair += moved[size:].reshape(pair.shape)

    return _climb(push)


def runs(n: int, seed: int) -> list[tuple[int, int]]:
    """Runs of tokens (first, end) to fit on: all of few tokens, else RUNS of RUN, one in each part of the text."""
    if n <= RUN * RUNS:
        return [(0, n)]
    draw = np.random.default_rng(seed)
    edges = np.linspace(0, n, RUNS + 1).astype(int)
    starts = [int(draw.integers(low, max(low, high - RUN) + 1)) for low, high in zip(edges, edges[1:])]
    return [(s, s + RUN) for s in starts]


def sampled(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """At most ``limit`` different texts (``text``, ``draw``), the first by a seeded hash: the same on any cluster."""
    draw = F.xxhash64(text, F.lit(SEED)).alias("draw")
    known = docs.where(F.col(text).isNotNull())
    chosen = known.select(draw).distinct().orderBy("draw").limit(limit)
    # At most ``limit`` hashes are broadcast; copies of a text that are chosen meet in its hash only after that.
    return known.select(F.col(text).alias("text"), draw).join(F.broadcast(chosen), "draw").dropDuplicates(["draw"])


def different(docs: DataFrame, text: str) -> DataFrame:
    """All different texts (``text``, ``draw``). Only texts that come more than once meet, so the others stay where they are."""
    known = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(text, F.lit(SEED)).alias("draw"))
    repeated = stored(known.groupBy("draw").agg(F.count("*").alias("n")).where("n > 1").select("draw"), "repeated-texts")
    copies = broadcast_if_small(repeated)
    return known.join(copies, "draw", "left_anti").unionByName(known.join(copies, "draw").dropDuplicates(["draw"]))


def learn(docs: DataFrame, text: str = "text", whole: bool = False) -> Model:
    """Fit on at most TRAIN_DOCUMENTS different texts, labelled by the patterns, or on the ``whole`` of all texts.

    Tasks reduce tokens to different cases and their number. The driver gets the TRAIN_CASES most frequent;
    for the whole it gets all of them or, if there are more, none: then they stay in tasks.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[Case, int] = {}
        for t, draw in zip(texts(part), part.column("draw").to_pylist()):
            field, seed = Field(), draw & (1 << 63) - 1
            field.add(0, t, base_spans(t), None if whole else runs(len(tokens(t)), seed))
            hidden = (np.random.default_rng(seed + 1).integers(0, 100, len(field.spans)) < HIDDEN) & (np.array(field.given) >= 0)
            for case in cases(field, hidden):
                found[case] = found.get(case, 0) + 1
        lists = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in found], lists), pa.array([c[1] for c in found], pa.int32()),
             pa.array([c[2] for c in found], lists), pa.array(list(found.values()), pa.int64())],
            ["features", "label", "near", "n"],
        )

    chosen = different(docs, text) if whole else sampled(docs, text, TRAIN_DOCUMENTS)
    rows = map_chunks(chosen, run, "features array<int>, label int, near array<int>, n long")
    counted = rows.groupBy("features", "label", "near").agg(F.sum("n").alias("n"))
    if whole:
        counted = stored(counted, "cases")
        if counted.count() > TRAIN_CASES:
            return fit_spread(counted)
    counted = counted.orderBy(F.desc("n"), "features", "label", "near")
    return fit({(tuple(r.features), r.label, tuple(r.near)): r.n for r in counted.limit(TRAIN_CASES).collect()})


def recovered(values: list[str], model: Model, percent: int = HIDDEN) -> tuple[int, int, int]:
    """How many pattern matches were hidden, got any sure label, and got their own."""
    hidden = labelled = right = 0
    for i, t in enumerate(values):
        field = Field()
        field.add(0, t, base_spans(t))
        truth = np.array(field.given)
        hide = (np.random.default_rng(SEED + i).integers(0, 100, len(truth)) < percent) & (truth >= 0)
        if not hide.any():
            continue
        field.given = np.where(hide, -1, truth).tolist()
        belief = model.marginals(field)
        best = belief.argmax(axis=1)
        sure = hide & (best != OTHER) & (belief.max(axis=1) >= SURE)
        hidden, labelled, right = hidden + int(hide.sum()), labelled + int(sure.sum()), right + int((sure & (best == truth)).sum())
    return hidden, labelled, right


_TRIM = re.compile(r"[0-9A-Za-z+(].*[0-9A-Za-z)]|[0-9A-Za-z]", re.DOTALL)


def find(values: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text. One field holds all texts that have a token no pattern covers."""
    base = [base_spans(t) for t in values]
    field = Field()
    for i, t in enumerate(values):
        before = (len(field.spans), len(field.edges))
        field.add(i, t, base[i])
        if -1 not in field.given[before[0] :]:
            for part, size in ((field.spans, before[0]), (field.owner, before[0]), (field.features, before[0]), (field.given, before[0]), (field.edges, before[1])):
                del part[size:]
    added: list[list[Span]] = [[] for _ in values]
    gave = -1
    if field.spans:
        belief = model.marginals(field)
        best = belief.argmax(axis=1)
        chained = {b for a, b, kind in field.edges if kind == 0 and best[a] == best[b] and field.given[a] < 0}
        sure = (best != OTHER) & (belief.max(axis=1) >= SURE) & (np.array(field.given) < 0)
        for node in np.flatnonzero(sure).tolist():
            owner, (start, end), label = field.owner[node], field.spans[node], int(best[node])
            found = _TRIM.search(values[owner][start:end])
            if not found:
                continue
            span = (label, start + found.start(), start + found.end())
            # A token beside the one that gave the last span stretches it; a token between may have given none.
            if node in chained and gave == node - 1:
                span = (label, added[owner].pop()[1], span[2])
            added[owner].append(span)
            gave = node
    return list(zip(base, added))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add pattern counts, ``base_spans`` and ``spans`` (kind:start:end, code points) to every row.

    Null and empty texts have none. No shuffle. Columns of these names are replaced; others are kept.
    """
    names = [part.split()[0] for part in _FOUND.split(", ")]
    model = learn(docs, text)
    kept = docs.drop(*names)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = find(texts(part, text), model)
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in range(len(KINDS))]
        return pa.RecordBatch.from_arrays(
            [*part.columns, *counts, pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(b + a) for b, a in found], pa.string())],
            [*part.schema.names, *names],
        )

    return map_chunks(kept, run, with_fields(kept, _FOUND), text)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, end = [], 0
    for start, stop, kind in sorted((s, e, k) for k, s, e in found):
        if start < end:
            end = max(end, stop)
            continue
        out.append(text[end:start])
        out.append(f"[{KINDS[kind].upper()}]")
        end = stop
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Documents with all spans masked in the text, and the length column (if there is one) set anew.

    The fit is on all different texts. Null texts stay null; rows, order of columns and all other columns stay as they are.
    """
    model = learn(docs, text, whole=True)
    size = docs.columns.index(length) if length in docs.columns else None
    place = docs.columns.index(text)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values = part.column(place).to_pylist()
        found = find([v or "" for v in values], model)
        clean = [v if v is None else masked(v, b + a) for v, (b, a) in zip(values, found)]
        columns = list(part.columns)
        columns[place] = pa.array(clean, pa.string())
        if size is not None:
            lengths = [old if v is None else len(v) for v, old in zip(clean, columns[size].to_pylist())]
            columns[size] = pa.array(lengths, columns[size].type)
        return pa.RecordBatch.from_arrays(columns, part.schema.names)

    return map_chunks(docs, run, docs.schema, text)
