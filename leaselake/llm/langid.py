"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product of its three letter vectors, the
first rotated by two places and the second by one. A document is the sum of its trigram vectors, a
language the sum of its documents, and a document's language the one of highest cosine.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.llm.common import chunks, fresh, in_fold, map_chunks, texts, with_fields
from leaselake.session import stored

DIMENSIONS = 1024
SEED = 20_250_706
UNDETERMINED = "und"
#: Cosine that a text passes by chance with a language of unrelated letters in about one of 160 cases: 2.5 standard errors.
CHANCE = 2.5 / DIMENSIONS**0.5
#: At most one in so many learned texts of a size below CHANCE, and so many learned ones at least, for the cosine to decide.
TOLD, LEAST_LEARNED = 1000, 1000
#: Texts are read in pieces of so many code points, so that memory does not follow the longest text.
PIECE = 1 << 20
BLOCK = 8192
SPACE = 32
ROWS = 256
BYTES = 2 << 20


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1
    )


def letter_bits(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Random bits of each code point, from a seeded mix of code point and place."""
    words = dimensions // 64
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
        x = (x + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return np.unpackbits(x.view(np.uint8), axis=1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)


def _reduced(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters as they are and all else as blanks; and which of them count, those not beside a letter do not."""
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    return np.where(letter, codes, SPACE), keep


def _long(value: str) -> Iterator[np.ndarray]:
    """What counts of a long text, piece by piece; each begins with the last two codes of the one before."""
    last = np.zeros(0, dtype=np.int64)
    padded = f"\n{value}\n"
    for start in range(0, len(padded), PIECE):
        around = (padded[start - 1 : start] if start else "\n", padded[start + PIECE : start + PIECE + 1] or "\n")
        codes, keep = _reduced(_codes(around[0] + padded[start : start + PIECE] + around[1]))
        piece = np.concatenate([last, codes[1:-1][keep[1:-1]]])
        yield piece
        last = piece[-2:]


class Trigrams:
    """Counted trigrams of several texts: letters, the distinct trigrams, and where each occurs.

    Takes the codes that count, the owner of each, and the part it belongs to; no trigram goes over two parts.
    """

    def __init__(self, codes: np.ndarray, owner: np.ndarray, part: np.ndarray):
        present = np.zeros(sys.maxunicode + 1, dtype=bool)
        present[codes] = True
        self.letters = np.flatnonzero(present)
        place = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        place[self.letters] = np.arange(len(self.letters))
        at, size = place[codes], max(1, len(self.letters))
        inside = part[:-2] == part[2:] if len(part) > 2 else np.zeros(0, dtype=bool)
        grams = ((at[:-2] * size + at[1:-1]) * size + at[2:])[inside] if len(part) > 2 else np.zeros(0, np.int64)
        self.owner = owner[: max(0, len(owner) - 2)][inside]
        if size**3 <= 1 << 22:
            table = np.zeros(size**3, dtype=bool)
            table[grams] = True
            self.grams = np.flatnonzero(table)
            index = np.zeros(size**3, dtype=np.int64)
            index[self.grams] = np.arange(len(self.grams))
            self.which = index[grams]
        else:
            self.grams, self.which = np.unique(grams, return_inverse=True)
        self.size = size

    def sums(self, n: int, dimensions: int = DIMENSIONS) -> np.ndarray:
        """Sum of trigram vectors for each of ``n`` owners, in blocks of distinct trigrams."""
        out = np.zeros((n, dimensions), dtype=np.float32)
        if not len(self.grams):
            return out
        bits = letter_bits(self.letters, dimensions)
        first, second = np.roll(bits, 2, axis=1), np.roll(bits, 1, axis=1)
        for start in range(0, len(self.grams), BLOCK):
            grams = self.grams[start : start + BLOCK]
            if len(self.grams) > BLOCK:
                here = (self.which >= start) & (self.which < start + BLOCK)
                cell = self.owner[here] * len(grams) + self.which[here] - start
            else:
                cell = self.owner * len(grams) + self.which
            counts = np.bincount(cell, minlength=n * len(grams)).reshape(n, -1).astype(np.float32)
            i, j, k = grams // self.size**2, grams // self.size % self.size, grams % self.size
            vectors = 1 - 2 * (first[i] ^ second[j] ^ bits[k]).astype(np.float32)
            out += counts @ vectors
        return out


def document_vectors(values: list[str], owners: list[int] | None = None, n: int | None = None) -> np.ndarray:
    """One row per text, or per owner where texts share owners."""
    owners = list(range(len(values))) if owners is None else owners
    n = len(values) if n is None else n
    out = np.zeros((n, DIMENSIONS), dtype=np.float32)
    held: list[tuple[int, str]] = []
    size = 0

    def sums() -> np.ndarray:
        lengths = [len(text) for _, text in held]
        codes, keep = _reduced(_codes("".join([text for _, text in held])))
        of = np.repeat(np.array([owner for owner, _ in held], dtype=np.int64), lengths)
        part = np.repeat(np.arange(len(held), dtype=np.int64), lengths)
        return Trigrams(codes[keep], of[keep], part[keep]).sums(n)

    for owner, value in zip(owners, values):
        value = value.lower()
        if len(value) > PIECE:
            for codes in _long(value):
                out += Trigrams(codes, np.full(len(codes), owner, dtype=np.int64), np.zeros(len(codes), dtype=np.int64)).sums(n)
            continue
        held.append((owner, f"\n{value}\n"))
        size += len(value)
        if size >= PIECE:
            out += sums()
            held, size = [], 0
    if held:
        out += sums()
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Prototype of each language: the sum over all its documents. Rows with null language are ignored.

    Each task sums its own documents and sends one vector per language it met; those are summed by key,
    and languages x dimensions numbers reach the driver. An empty table gives no prototypes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text", ROWS, BYTES):
                langs = part.column(1).to_pylist()
                names = sorted(set(langs))
                at = {name: i for i, name in enumerate(names)}
                for name, v in zip(names, document_vectors(texts(part), [at[v] for v in langs], len(names))):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "v"]
            )

    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = labelled.mapInArrow(run, "lang string, v array<double>")
    total = (
        sums.select("lang", F.posexplode("v").alias("place", "v"))
        .groupBy("lang", "place")
        .agg(F.sum("v").alias("v"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("v"))
        .select("lang", F.col("v.v").alias("v"))
    )
    rows = sorted((r.lang, r.v) for r in total.collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), DIMENSIONS)


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Add the predicted language and its cosine (0 to 1) to every row.

    Null texts, texts without a letter and every text under an empty model get ``und`` and 0. Equal
    cosines go to the first language in order. Columns of the two names are replaced; others are kept.
    """
    langs, prototypes = model
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    kept = docs.drop(*names)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        vectors = document_vectors(texts(part, text))
        norm = np.linalg.norm(vectors, axis=1)
        out, score = [UNDETERMINED] * len(norm), np.zeros(len(norm))
        if langs:
            cosine = vectors @ unit.T / np.maximum(norm, 1e-12)[:, None]
            best = cosine.argmax(axis=1)
            out = [langs[b] if n > 0 else UNDETERMINED for b, n in zip(best, norm)]
            score = np.where(norm > 0, np.clip(cosine.max(axis=1), 0, 1), 0.0)
        return pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(out, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, *names]
        )

    return map_chunks(kept, run, with_fields(kept, f"{names[0]} string, {names[1]} double"), text, ROWS, BYTES)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from the rows outside one fold of doc_id and predict every row.

    Returns doc_id, held_out, lang_pred, score. Rows with a null doc_id are in no fold: nothing is
    learned from them, and they are predicted as not held out.
    """
    fold = in_fold("doc_id", folds, held_out)
    rows = docs.select("doc_id", "text", "lang", fold.alias("held_out"))
    model = learn(rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return predict(rows.select("doc_id", "text", "held_out"), model).drop("text")


def _letters(text: str) -> Column:
    """Size class of a text: its number of letters doubles from one class to the next."""
    return F.length(F.bin(F.length(F.regexp_replace(text, r"\P{L}+", ""))))


def told_classes(scored: DataFrame) -> list[int]:
    """Classes whose texts are told from chance by their cosine, from learned rows (``letters``, ``score``).

    That is so where at most one in TOLD learned texts lies below CHANCE. A class of fewer than LEAST_LEARNED
    learned texts goes by the next lower one that has them.
    """
    low = F.sum((F.col("score") < CHANCE).cast("long")).alias("low")
    learned = {r.letters: r for r in scored.groupBy("letters").agg(F.count("*").alias("n"), low).collect()}
    out, told = [], False
    for size in range(1, 32):  # a text has fewer than 2^31 letters
        if size in learned and learned[size].n >= LEAST_LEARNED:
            told = learned[size].low * TOLD <= learned[size].n
        if told:
            out.append(size)
    return out


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Documents with a determined language, with their own columns; ``lang`` is the language found.

    Undetermined are null texts, texts without a letter, and texts that resemble no learned language: their best
    cosine is one that texts of unrelated letters reach by chance, though learned texts of as many letters
    lie above it. Of shorter texts with such a cosine nothing can be told; they stay, with the language given
    or else the likeliest.
    """
    learned = ~in_fold("doc_id", folds, held_out) & F.col("doc_id").isNotNull()
    model = learn(docs.where(learned), text, lang)
    found, score, letters = fresh(docs, "lang_pred", "score", "letters")
    rows = predict(docs, model, text, (found, score)).where(F.col(found) != UNDETERMINED)
    rows = stored(rows.withColumn(letters, _letters(text)), "languages")
    told = told_classes(rows.where(learned & F.col(lang).isNotNull()).select(F.col(letters).alias("letters"), F.col(score).alias("score")))
    chance = F.col(score) < CHANCE
    language = F.when(chance, F.coalesce(lang, found)).otherwise(F.col(found))
    return rows.where(~(chance & F.col(letters).isin(told))).withColumn(lang, language).select(*docs.columns)
