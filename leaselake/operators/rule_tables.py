"""Rule packs as tables: users change patterns, or add fields of their own, without code (U4).

Two tables hold a pack: the fields, and their rules in priority order. ``pack_tables`` gives the
default pack in this form; ``read_pack`` turns tables into the pack that ``extract_fields``,
``with_provenance``, ``assemble_contracts`` and ``analyse`` take as ``rules``.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leaselake.operators.extract import CARRIED, FIELD_NAMES
from leaselake.plans import lease_ptbr as R

FIELD_COLUMNS = (
    "field string, label string, type string, missing string, unreadable string, least int, most int, out_of_range string"
)
RULE_COLUMNS = (
    "field string, position int, pattern string, parser string, confidence double, detail string, capture int, "
    "constant string, refine string, stems array<string>"
)
#: Largest pack that is read: every rule becomes a part of the plan, so a larger one is refused.
MAX_RULES = 2_000
#: Types each parser may give.
PARSED = {
    "text": ("string",), "money": ("decimal(18,2)",), "date": ("date",), "date_second": ("date",), "int": ("int",),
    "years": ("int",), "words": ("int",), "years_words": ("int",), "constant": ("string", "int"),
}
RESERVED = (
    {*FIELD_NAMES, *CARRIED, "flags", "provenance", "review_fields", "contract_needs_review"} - {f.name for f in R.FIELDS}
)


def pack_tables(spark: SparkSession, rules: tuple[R.Field, ...] = R.FIELDS) -> tuple[DataFrame, DataFrame]:
    """A pack as its two tables: fields and rules."""
    fields = [
        (f.name, f.key, f.type, f.missing, f.unreadable, *(f.valid or (None, None)), f.out_of_range) for f in rules
    ]
    rows = [
        (f.name, i, r.pattern, r.parser, r.confidence, r.detail, r.group, None if r.constant is None else str(r.constant), r.refine, list(r.stems))
        for f in rules
        for i, r in enumerate(f.rules)
    ]
    return spark.createDataFrame(fields, FIELD_COLUMNS), spark.createDataFrame(rows, RULE_COLUMNS)


def _pattern_fault(spark: SparkSession, pattern: str, group: int) -> str | None:
    """Why Spark cannot take this group of the pattern; an empty text matches the added empty branch."""
    try:
        spark.range(1).select(F.regexp_extract(F.lit(""), f"(?:{pattern})|", group)).collect()
    except PySparkException as error:
        return str(error).splitlines()[0]
    return None


def _faults(spark: SparkSession, field: Row, rules: list[Row]) -> list[str]:
    faults = []
    if not re.fullmatch(r"[a-z][a-z0-9_]*", field.field or "") or field.field in RESERVED:
        faults.append("this name cannot be used")
    if not field.label or not field.type or field.missing is None:
        faults.append("label, type and missing are needed")
    if (field.least is None) != (field.most is None) or (field.least is not None and field.type != "int"):
        faults.append("least and most come together, for integers")
    standard = {f.name: f.type for f in R.FIELDS}.get(field.field)
    if standard and field.type != standard:
        faults.append(f"the type is {standard}, since other fields are derived from it")
    if not rules:
        faults.append("no rules")
    for rule in rules:
        at = f"rule {rule.position}: "
        if rule.position is None or rule.pattern is None or rule.confidence is None or not 0 <= rule.confidence <= 1:
            faults.append(at + "position, pattern and a confidence from 0 to 1 are needed")
            continue
        if field.type not in PARSED.get(rule.parser, ()):
            faults.append(at + f"parser {rule.parser} gives no {field.type}")
        if (rule.parser == "constant") != (rule.constant is not None):
            faults.append(at + "a constant goes with the parser constant")
        elif rule.parser == "constant" and field.type == "int" and not re.fullmatch(r"-?[0-9]{1,9}", rule.constant):
            faults.append(at + "the constant is no integer")
        if rule.parser == "date_second" and rule.refine is None:
            faults.append(at + "date_second takes the second group of refine")
        parts = [(rule.pattern, 1 if rule.capture is None else rule.capture)] if rule.parser != "constant" else [(rule.pattern, 0)]
        if rule.refine is not None:
            parts.append((rule.refine, 2 if rule.parser == "date_second" else 1))
        faults += [at + fault for pattern, group in parts if (fault := _pattern_fault(spark, pattern, group))]
    return faults


def read_pack(fields: DataFrame, rules: DataFrame) -> tuple[R.Field, ...]:
    """The pack the two tables hold, or a ValueError that names every fault.

    Patterns are written for lower-case text. ``capture`` is the group that holds the value
    (1 if null), ``refine`` a second pattern for the first one's match, ``stems`` lower-case literals of
    which one occurs in every match (none if null), ``least`` and ``most`` the valid range of an
    integer. Fields come in the order of their names after those of the default pack, which all
    have to be there since other fields are derived from them. Other columns are ignored.
    """
    spark = fields.sparkSession
    wanted = [c.split()[0] for c in FIELD_COLUMNS.split(", ")], [c.split()[0] for c in RULE_COLUMNS.split(", ")]
    held = fields.select(*wanted[0]).limit(MAX_RULES + 1).collect()
    rows = rules.select(*wanted[1]).limit(MAX_RULES + 1).collect()
    if max(len(held), len(rows)) > MAX_RULES:
        raise ValueError(f"a pack has at most {MAX_RULES} fields and rules")
    faults = [f"{name}: more than one row" for name, n in Counter(f.field for f in held).items() if n > 1]
    faults += [f"{label}: label of more than one field" for label, n in Counter(f.label for f in held).items() if n > 1]
    taken = {k: n for n, k in R.PROVENANCE_KEYS} | {R.LEGAL_FLAGS_KEY: None}
    faults += [f"{f.field}: label {f.label} belongs to another field" for f in held if taken.get(f.label, f.field) != f.field]
    faults += [f"{name}: rules without a field" for name in sorted({str(r.field) for r in rows} - {str(f.field) for f in held})]
    faults += [f"{name}: a field of the default pack is missing" for name in sorted({f.name for f in R.FIELDS} - {f.field for f in held})]
    faults += [
        f"{name}: two rules at position {position}"
        for (name, position), n in Counter((r.field, r.position) for r in rows).items()
        if n > 1
    ]
    order = {f.name: i for i, f in enumerate(R.FIELDS)}
    pack = []
    for field in sorted(held, key=lambda f: (order.get(f.field, len(order)), f.field or "")):
        own = [r for r in rows if r.field == field.field]
        if found := _faults(spark, field, own):
            faults += [f"{field.field}: {fault}" for fault in found]
            continue
        pack.append(
            R.Field(
                field.field, field.label, field.type,
                tuple(
                    R.Rule(
                        r.pattern, r.parser, r.confidence, r.detail, 1 if r.capture is None else r.capture,
                        int(r.constant) if r.constant is not None and field.type == "int" else r.constant,
                        r.refine, tuple(r.stems or ()),
                    )
                    for r in sorted(own, key=lambda r: r.position)
                ),
                field.missing, field.unreadable, (field.least, field.most) if field.least is not None else None, field.out_of_range,
            )
        )
    if faults:
        raise ValueError("; ".join(faults))
    return tuple(pack)
