"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.common import chunks, fresh, raw_texts, with_fields

#: Documents on which costs and rejection rates are estimated. They set the order of the rules only:
#: every order gives the same verdict.
SAMPLE = 4000
SEED = 20_250_702
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


class Facts:
    """What rules ask about one text; each value is computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() cuts at exactly the six ASCII white-space characters.
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        # Code points are the bytes that are not UTF-8 continuations.
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line and not line.isspace()]

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def line_bytes(self) -> tuple[int, int]:
        """Bytes of all lines, and of the lines equal to an earlier one."""
        whole = sum(map(len, self.lines))
        return whole, whole - sum(map(len, set(self.lines)))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text has at least twice."""
        words = self.words
        repeated = {w for w, n in Counter(zip(words, words[1:], words[2:])).items() if n > 1}
        if not repeated:
            return 0
        total = covered = 0
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            if window in repeated:
                total += min(3, i + 3 - covered)
                covered = i + 3
        return total

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))

    @cached_property
    def n_adjacent(self) -> int:
        """Words equal to the word before."""
        return sum(a == b for a, b in zip(self.words, self.words[1:]))


#: Name and rejection test of each rule. Integer arithmetic, so that every engine decides alike.
RULES: dict[str, Callable[[Facts], bool]] = {
    "short_words": lambda f: f.word_chars < 2 * f.n_words,
    "long_words": lambda f: f.word_chars > 14 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > 2 * f.n_words,
    "repeated_lines": lambda f: 10 * f.line_bytes[1] > 2 * f.line_bytes[0],
    "shouting": lambda f: 10 * f.n_upper > 3 * (f.n_upper + f.n_lower),
    "exclaiming": lambda f: 10 * f.raw.count(b"!") > 2 * f.n_words,
    "stuttering": lambda f: 10 * f.n_adjacent > 3 * f.n_words,
}


def estimate(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Cost in seconds and rejection rate of each rule, on a seeded sample of about ``sample`` documents.

    The base facts are computed for every document anyway, so they are not part of a rule's cost. An empty
    table gives an empty result.
    """
    n = docs.count()
    if not n:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spent, rejected = 0, dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        for batch in batches:
            for raw in raw_texts(batch):
                facts = Facts(raw)
                if facts.base_failed:
                    continue
                _ = (facts.word_chars, facts.n_symbols, facts.n_dup_lines)
                seen += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    rejected[name] += rule(facts)
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pylist(
            [{"rule": r, "seen": seen, "spent": spent[r], "rejected": rejected[r]} for r in RULES]
        )

    schema = "rule string, seen long, spent double, rejected long"
    part = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample / n), seed=SEED)
    sums = part.mapInArrow(run, schema).groupBy("rule").agg(
        F.sum("seen").alias("seen"), F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")
    )
    return {r.rule: (r.spent / max(1, r.seen), r.rejected / max(1, r.seen)) for r in sums.collect()}


def order_of(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, most first; rules without an estimate come last."""
    rate = lambda name: estimates[name][1] / max(estimates[name][0], 1e-9) if name in estimates else -1.0
    return sorted(RULES, key=lambda name: (-rate(name), name))


def passes(facts: Facts, order: list[str]) -> bool:
    """The cascade: the first rule that rejects ends it."""
    return not any(RULES[name](facts) for name in order)


_FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base facts and the verdict to every row. Null and empty texts have no words and fail.

    No shuffle; the order of the rules comes from one sampled pass before. Columns with the names of the
    added ones are replaced; others are kept.
    """
    names = [part.split()[0] for part in _FACTS.split(", ")]
    order = order_of(estimate(docs, text))
    kept = docs.drop(*names)
    schema = with_fields(kept, _FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                rows = []
                for raw in raw_texts(part, text):
                    f = Facts(raw)
                    failed = f.base_failed
                    verdict = not failed and passes(f, order)
                    rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, verdict))
                added = [pa.array(c, pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents the cascade keeps, with their own columns (also ones named like the facts)."""
    held = fresh(docs, "row_of_document")[0]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held), F.col(f"`{text}`").alias("text"))
    return judge(whole).where("kept").select(f"{held}.*")


#: The verdict in DuckDB SQL, over table documents with unique doc_id.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)
), repeated AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id
), facts AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    coalesce(covered.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up,
    length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low,
    length(t) - length(replace(t, '!', '')) AS bangs,
    len(list_filter(range(2, greatest(len(w) + 1, 2)), lambda i: w[i] = w[i - 1])) AS adjacent
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id
), base AS (
  SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(list_sum(list_transform(l, lambda x: strlen(x))), 0) AS line_bytes,
    coalesce(list_sum(list_transform(list_distinct(l), lambda x: strlen(x))), 0) AS distinct_bytes, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > 2 * n_words
    OR 10 * (line_bytes - distinct_bytes) > 2 * line_bytes OR 10 * up > 3 * (up + low) OR 10 * bangs > 2 * n_words
    OR 10 * adjacent > 3 * n_words
  ) AS kept
FROM base
"""
