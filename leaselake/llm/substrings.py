"""Passages repeated across documents, found by relative Lempel-Ziv parsing.

Every window of WINDOW words has an anchor, its run of GRAM words of least hash. Equal windows have equal anchors,
so a window can only be repeated where its anchor occurs in another row. Neighbouring windows of one anchor form
a phrase. A phrase that also occurs in a row of smaller key is one factor, found by its hash. The first row of each
different phrase of an anchor gives its words to the anchor's reference block, where they are factored greedily
against the block's phrases from smaller keys: each factor is the stretch from an indexed window on for as long as
the words agree, and the next windows looked up are those that cross the factor's end. Blocks without a
document's anchor have no factor of WINDOW words for it, so a document is factored against all other blocks.

A block of an anchor with more than BUSY places is not gathered: its first phrases are taken window by window, each
window under its own hash, and the least key of a window is reduced before it moves. So no task holds more than
BUSY phrases of a block, and none is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.common import chunks, fresh, map_chunks, raw_texts, with_fields
from leaselake.session import stored

WINDOW = 13
GRAM = 5
BUSY = 1024
#: Bytes of a text hashed at a time, and phrases of an output batch.
PIECE, PHRASES = 1 << 20, 1 << 14
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_TIMES = 0x9E3779B97F4A7C15
_BACK = pow(_TIMES, -1, 1 << 64)


def pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of a text of about PIECE bytes, cut at blanks."""
    start = 0
    while start < len(raw):
        blank = _BLANK.search(raw, start + PIECE)
        end = blank.start() if blank else len(raw)
        yield raw[start:end]
        start = end


def word_hashes(raw: bytes) -> np.ndarray:
    parts = []
    for part in pieces(raw):
        words = part.split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values *= np.uint64(_TIMES)
    return values ^ (values >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """The phrases of some texts: owner (number of the text), first word, number of words, block and print."""

    def __init__(self, raws: list[bytes], window: int = WINDOW) -> None:
        gram = min(GRAM, window)
        hashed = [word_hashes(raw) for raw in raws]
        counts = np.array([len(h) for h in hashed], np.int64)
        words = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        starts = np.cumsum(counts) - counts
        # Place of each window in all words, for texts that have one.
        sizes = np.maximum(counts - window + 1, 0)
        owner = np.repeat(np.arange(len(raws)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        raised = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(_TIMES, len(words)), out=raised[1:])
        back = _powers(_BACK, len(words) + 1)

        def hashes(first: np.ndarray, end: np.ndarray) -> np.ndarray:
            return _mixed((raised[end] - raised[first]) * back[first])

        self.hashes, self.at, self.window = hashes, at, window
        grams = hashes(np.arange(max(len(words) - gram + 1, 0)), np.arange(gram, max(len(words), gram - 1) + 1))
        least, place = grams[at], at.copy()
        for j in range(1, window - gram + 1):
            other = grams[at + j]
            better = np.flatnonzero(other < least)
            least[better] = other[better]
            place[better] = at[better] + j
        # A place belongs to one text, so windows of one place follow each other there.
        run = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        last = np.concatenate([run[1:], [len(place)]])[: len(run)] - 1
        self.owner, self.start = owner[run], starts
        self.first, self.end = at[run], at[last] + window
        self.block = least[run]

    @property
    def prints(self) -> np.ndarray:
        return self.hashes(self.first, self.end)


def _codes(owner: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    out = _mixed(owner.astype(np.uint64) + np.uint64(1))
    for part in parts:
        out = _mixed(out ^ part)
    return out


def _listed(part: pa.RecordBatch, column: str, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Owner and fields of the structs in a list column, flattened."""
    lists = part.column(column)
    owner = np.repeat(np.arange(len(lists)), [0 if v is None else v for v in lists.value_lengths().to_pylist()])
    flat = lists.flatten()
    return owner, [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _anchors(window: int):
    """Key, anchor and number of its places for each different anchor of a row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = Windows(raw_texts(part), window)
        order = np.lexsort((found.block, found.owner))
        owner, block = found.owner[order], found.block[order]
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])])) if len(block) else order
        times = np.diff(np.append(new, len(block)))
        return pa.RecordBatch.from_arrays(
            [part.column("key").take(pa.array(owner[new])), pa.array(block[new].view(np.int64)), pa.array(times)], ["key", "anchor", "times"]
        )

    return run


def _prints(window: int):
    """Phrases of the marked anchors of each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = Windows(raw_texts(part), window)
        owner, (anchor, busy) = _listed(part, "marked", "anchor", "busy")
        codes = _codes(owner, anchor.view(np.uint64))
        order = np.argsort(codes)
        own = _codes(found.owner, found.block)
        place = np.minimum(np.searchsorted(codes[order], own), max(len(codes) - 1, 0))
        hit = np.flatnonzero(codes[order][place] == own) if len(codes) else np.zeros(0, np.int64)
        columns = part.select(["key", "tie"]).take(pa.array(found.owner[hit])).columns
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(found.block[hit].view(np.int64)), pa.array(found.prints[hit].view(np.int64)),
             pa.array((found.first - found.start[found.owner])[hit].astype(np.int32)), pa.array((found.end - found.first)[hit].astype(np.int32)),
             pa.array(busy[order][place[hit]])],
            ["key", "tie", "block", "print", "first", "n", "busy"],
        )

    return run


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word."""
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _phrases(window: int):
    """Words of the asked phrases of each row; for busy blocks the hash of each window instead."""
    names = ["key", "tie", "block", "first", "phrase"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
            rows, blocks, firsts, values = zip(*held)
            columns = part.select(["key", "tie"]).take(pa.array(rows, pa.int64())).columns
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.array(blocks, np.uint64).view(np.int64)), pa.array(firsts, pa.int32()), pa.array(values, pa.binary())], names
            )

        for batch in batches:
            for part in chunks(batch, "text"):
                raws = raw_texts(part)
                found = Windows(raws, window)
                owner, (block, mark, busy) = _listed(part, "asked", "block", "print", "busy")
                asked = dict(zip(_codes(owner, block.view(np.uint64), mark.view(np.uint64)).tolist(), busy.tolist()))
                held: list[tuple] = []
                row, spans = -1, None
                for at, code in enumerate(_codes(found.owner, found.block, found.prints).tolist()):
                    kind = asked.get(code)
                    if kind is None:
                        continue
                    i = int(found.owner[at])
                    first, end, base = int(found.first[at]), int(found.end[at]), int(found.start[i])
                    if kind:
                        at_window = np.arange(first, end - window + 1)
                        hashes = found.hashes(at_window, at_window + window)
                        held += [(i, h, f - base, None) for h, f in zip(hashes.tolist(), at_window.tolist())]
                    else:
                        if row != i:
                            row, spans = i, word_spans(raws[i])
                        piece = raws[i][spans[0][first - base] : spans[1][end - base - 1]]
                        held.append((i, int(found.block[at]), first - base, b" ".join(piece.split())))
                    if len(held) >= PHRASES:
                        yield out(part, held)
                        held = []
                if held:
                    yield out(part, held)

    return run


class Block:
    """Reference phrases of one block, indexed by their windows."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.index: dict[tuple[bytes, ...], tuple[list[bytes], int]] = {}

    def add(self, words: list[bytes]) -> None:
        for at in range(len(words) - self.window + 1):
            self.index.setdefault(tuple(words[at : at + self.window]), (words, at))

    def factors(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Greedy factors (start, end) of at least a window, in order; the next may begin inside the last."""
        out, at = [], 0
        while self.index and at + self.window <= len(words):
            found = self.index.get(tuple(words[at : at + self.window]))
            if found is None:
                at += 1
                continue
            other, place = found
            n = self.window
            while at + n < len(words) and place + n < len(other) and words[at + n] == other[place + n]:
                n += 1
            out.append((at, at + n))
            # Windows inside the factor are decided; those that cross its end are looked up next.
            at += n - self.window + 1
        return out


def _factors(window: int):
    """Factors of each phrase against phrases of its block with a smaller key; blocks follow each other in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, held, waiting = None, None, Block(window), []
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (key, least, first, phrase) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "key", "first", "phrase")))):
                words = phrase.split(b" ")
                if key != block:
                    block, at, held, waiting = key, least, Block(window), []
                if least != at:
                    for other in waiting:
                        held.add(other)
                    at, waiting = least, []
                for s, e in held.factors(words):
                    rows.append(i)
                    starts.append(first + s)
                    ends.append(first + e)
                waiting.append(words)
            columns = batch.select(["key", "tie"]).take(pa.array(rows, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["key", "tie", "start", "end"])

    return run


def repeated(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``spans`` (start and end word) of the windows of a row that also start in a row of smaller key.

    ``texts`` has ``key`` without nulls, ``tie`` (hash of the text) and ``text``; the result key, tie and spans, which
    may overlap, for rows that have some.
    """
    key = texts.schema["key"].dataType.simpleString()
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = f"key {key}, tie long"
    found = map_chunks(texts.select("key", "text"), _anchors(window), f"key {key}, anchor long, times long")
    shared = stored(
        found.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("times").alias("times")).where("n > 1")
        .select("anchor", (F.col("times") > BUSY).alias("busy")),
        "shared-anchors",
    )
    marked = stored(
        found.select("key", "anchor").join(shared, "anchor").groupBy("key")
        .agg(F.collect_set(F.struct("anchor", "busy")).alias("marked")),
        "marked-anchors",
    )
    rows = stored(
        map_chunks(texts.join(marked, "key").select("key", "tie", "text", "marked"), _prints(window), f"{own}, block long, print long, first int, n int, busy boolean"),
        "phrases",
    )
    # The first key of each phrase; only blocks of different phrases are looked into.
    least = rows.groupBy("block", "print", "busy").agg(F.min("key").alias("least"))
    mixed = rows.groupBy("block").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").select("block")
    asked = least.join(mixed, "block").groupBy(F.col("least").alias("key")).agg(F.collect_set(F.struct("block", "print", "busy")).alias("asked"))
    first_rows = stored(
        texts.join(asked, "key").select("key", "tie", "text", "asked").mapInArrow(_phrases(window), f"{own}, block long, first int, phrase binary"),
        "first-phrases",
    )
    whole = rows.join(least.select("block", "print", "least"), ["block", "print"]).where(F.col("least") < F.col("key")).select(
        "key", "tie", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end")
    )
    quiet = (
        first_rows.where(F.col("phrase").isNotNull()).repartition(tasks, "block").sortWithinPartitions("block", "key")
        .mapInArrow(_factors(window), f"{own}, start int, end int")
    )
    windows = first_rows.where(F.col("phrase").isNull())
    earliest = windows.groupBy("block").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    busy = windows.join(earliest, "block").where(F.col("least") < F.col("key")).select(
        "key", "tie", F.col("first").alias("start"), (F.col("first") + window).alias("end")
    )
    return whole.unionByName(quiet).unionByName(busy).groupBy("key", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def cut(raw: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """Number of words, of removed ones, and the kept words joined by one blank."""
    words = raw.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["end"]] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    return len(words), len(words) - len(kept), b" ".join([words[i] for i in kept.tolist()])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows with ``text`` cut to the words outside repeated windows, ``n_words`` and ``n_removed`` (long).

    A window is ``window`` words that follow each other in one row (runs of characters outside \\x20 and \\x09-\\x0D,
    unchanged). Words of a window that also starts in a row of smaller key go, judged on the texts as they
    come; the kept words are joined by one blank. Rows of equal key do not remove each other's words. A row
    with a null key neither removes nor loses any. Null, empty and short texts lose nothing; a null text
    becomes an empty one. Repeated rows stay repeated; columns named n_words or n_removed are replaced.
    """
    tie, spans = fresh(docs, "text_hash", "repeated_spans")
    docs = docs.drop(*({"n_words", "n_removed"} - {key, text})).withColumn(tie, F.xxhash64(text))
    texts = docs.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    found = repeated(texts, window).select(F.col("key").alias(key), F.col("tie").alias(tie), F.col("spans").alias(spans))
    joined = docs.join(found, [key, tie], "left").select(*docs.columns, spans).drop(tie)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        done = [cut(raw, s or []) for raw, s in zip(raw_texts(part, text), part.column(spans).to_pylist())]
        columns = {n: c for n, c in zip(part.schema.names, part.columns) if n != spans}
        columns[text] = pa.array([d[2] for d in done], pa.binary()).cast(pa.string())
        columns |= {"n_words": pa.array([d[0] for d in done], pa.int64()), "n_removed": pa.array([d[1] for d in done], pa.int64())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_chunks(joined, run, with_fields(joined.drop(spans), "n_words long, n_removed long"), text)


#: The same for documents with doc_id and text, by all windows at once.
SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13
), keyed AS (
  SELECT rid, doc_id, pos, array_to_string(list_slice(words, pos, pos + 12), ' ') AS win FROM win
), least AS (
  SELECT win, min(doc_id) AS first_doc FROM keyed GROUP BY win
), hit AS (
  SELECT rid, pos FROM keyed JOIN least USING (win) WHERE first_doc < doc_id
), gone AS (
  SELECT rid, list(DISTINCT place) AS places FROM (SELECT rid, unnest(range(pos, pos + 13)) AS place FROM hit) GROUP BY rid
), kept AS (
  SELECT doc_id, words, coalesce(places, []) AS places, w.rid FROM w LEFT JOIN gone ON w.rid = gone.rid
), out AS (
  SELECT doc_id, len(words) AS n_words, len(places) AS n_removed, words,
         list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)) AS stay FROM kept
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(stay, lambda i: words[i]), ' '), '')) AS kept_sha256
FROM out
"""
