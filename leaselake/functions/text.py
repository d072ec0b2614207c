"""Text normalisation as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space that str.strip() removes in the source data's tooling.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(col: Column) -> Column:
    """Trim every kind of Unicode white space on both sides."""
    return F.btrim(col, F.lit(WHITESPACE))


def collapse_ws(col: Column) -> Column:
    """Replace runs of white space with one space and trim."""
    return F.btrim(F.regexp_replace(col, r"(?U)\s+", " "))


def fold_case(col: Column) -> Column:
    """Lower-case text whose every code point keeps its position.

    The four letters whose case folding changes length or leaves the Latin
    alphabet are mapped first, and characters outside the basic plane become one
    placeholder, so an offset found in the folded text is the offset in the
    original. Case-sensitive patterns on this column then behave as
    case-insensitive patterns on the original, at a lower cost per character.
    """
    special = "\u0130\u0131\u017f\u212a"
    basic = F.regexp_replace(col, r"[\x{10000}-\x{10FFFF}]", "\ufffd")
    return F.lower(
        F.when(
            col.rlike("[" + special + r"\x{10000}-\x{10FFFF}]"), F.translate(basic, special, "iisk")
        ).otherwise(col)
    )


def contains_any(col: Column, stems: tuple[str, ...]) -> Column:
    """Cheap test that a pattern can match at all: one of its literal stems occurs."""
    return reduce(or_, [F.contains(col, F.lit(stem)) for stem in stems])


def _spelled(col: Column, table: dict[str, str]) -> Column:
    """Replace characters by strings of any length; texts without one of them pass as they are."""
    if not table:
        return col
    keys = "".join(sorted(table))
    ranges, start = [], keys[0]
    for left, right in zip(keys, keys[1:] + "\0"):
        if ord(right) != ord(left) + 1:
            ranges.append((ord(start), ord(left)))
            start = right
    letters = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    entries = F.map_from_arrays(
        F.split(F.lit("\x01".join(table)), "\x01"), F.split(F.lit("\x01".join(table.values())), "\x01", -1)
    )
    spelled = F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(entries, c), c))
    return F.when(col.rlike(f"[{letters}]"), F.array_join(spelled, "")).otherwise(col)


@lru_cache(maxsize=1)
def _decompositions() -> dict[str, str]:
    """Characters of the basic plane without accents and compatibility forms, by the Unicode tables.

    Hangul syllables and the characters that stay as they are have no entry.
    """
    out = {}
    for code in (c for block in (range(0x80, 0xAC00), range(0xF900, 0x10000)) for c in block):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char:
            out[char] = plain
    return out


@lru_cache(maxsize=1)
def _case_foldings() -> dict[str, str]:
    """Characters whose case folding is not their lower-case form, by the Unicode tables."""
    return {chr(c): chr(c).casefold() for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()}


def unaccent(col: Column) -> Column:
    """Remove accents and compatibility forms."""
    table = _decompositions()
    # Latin letters, nearly all there is, one for one; the rest where it occurs.
    common = {c: p for c, p in table.items() if c < "\u2500" and len(p) < 2}
    order = sorted(common, key=lambda c: not common[c])
    plain = F.translate(col, "".join(order), "".join(common[c] for c in order))
    return _spelled(plain, {c: p for c, p in table.items() if c not in common})


def case_fold(col: Column) -> Column:
    """Text in which letters differ by more than case only."""
    return F.lower(_spelled(col, _case_foldings()))


def header_key(col: Column) -> Column:
    """header text without accents, lower case, trimmed; null becomes ''."""
    return unaccent(F.lower(strip_ws(F.coalesce(col, F.lit("")))))


def name_key(col: Column) -> Column:
    """party name with spaces collapsed and case folded."""
    return case_fold(collapse_ws(col))


def null_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))
