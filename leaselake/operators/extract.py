"""Rule-driven field extraction from contract text.

Every field becomes ``struct<value, confidence, origin, detail>``. The work is
laid out in stages, each one projection: fold the text once, capture every rule
once, then build the fields from the captures, then the fields that depend on
other fields. No stage shuffles; a document never leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake.functions import parsing as P
from leaselake.functions.keys import COMPANY_PATTERN, PERSON_PATTERN, digits_only
from leaselake.functions.text import collapse_ws, contains_any, fold_case, name_key, null_if_empty
from leaselake.operators.skew import lookup_join
from leaselake.plans import lease_ptbr as R
from leaselake.session import stored, work_folder

PARTY = "struct<type:string,name:string,document:string>"
FIELD_TYPES = {
    "landlord": PARTY,
    "tenant": PARTY,
    "extra_landlords": f"array<{PARTY}>",
    "lease_type": "string",
    "termination_penalty": "decimal(18,2)",
    "guarantees": "array<string>",
    "grace_months": "int",
    "index_source": "string",
    "adjustment_automatic": "boolean",
    "renewal_automatic": "boolean",
    "expenses": "map<string,string>",
    **{f.name: f.type for f in R.FIELDS},
}
FIELD_NAMES = tuple(name for name, _ in R.PROVENANCE_KEYS)


def result_type(value_type: str) -> str:
    return f"struct<value:{value_type},confidence:double,origin:string,detail:string>"


# ---- field results ---------------------------------------------------------------
@lru_cache(maxsize=None)
def _constant(value: object, type_: str, name: str) -> Column:
    """A typed literal; shared, because every field result repeats the same few."""
    return F.lit(value).cast(type_).alias(name)


def _part(value: Column | object, type_: str, name: str) -> Column:
    if isinstance(value, Column):
        return value.cast(type_).alias(name)
    return _constant(value, type_, name)


def result(
    value: Column | object,
    confidence: Column | float,
    origin: str,
    detail: Column | str | None,
    type_: str,
) -> Column:
    return F.struct(
        _part(value, type_, "value"),
        _part(confidence, "double", "confidence"),
        _part(origin, "string", "origin"),
        _part(detail, "string", "detail"),
    )


def found(
    value: Column | object, confidence: Column | float, type_: str, detail: Column | str | None = None
) -> Column:
    return result(value, confidence, R.BY_RULE, detail, type_)


def missing(type_: str, detail: Column | str | None = None) -> Column:
    return result(None, 0.0, R.NOT_FOUND, detail, type_)


# ---- parsers a rule may name -------------------------------------------------------
def _int(col: Column) -> Column:
    return col.try_cast("int")


PARSERS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: c,
    "money": P.parse_money,
    "date": P.parse_date,
    "date_second": P.parse_date,
    "int": _int,
    "years": lambda c: _int(c) * 12,
    "words": P.number_from_words,
    "years_words": lambda c: P.number_from_words(c) * 12,
}


def _first(fold: Column, pattern: str, group: int, stems: tuple[str, ...] = ()) -> Column:
    """First match of a pattern, '' when there is none; null when no stem of it occurs.

    A later stage makes null of ''; here that would search twice.
    """
    found_text = F.regexp_extract(fold, pattern, group)
    return F.when(contains_any(fold, stems), found_text) if stems else found_text


def _has(fold: Column, pattern: str, stems: tuple[str, ...] = ()) -> Column:
    matched = fold.rlike(pattern)
    return contains_any(fold, stems) & matched if stems else matched


def _capture(fold: Column, rule: R.Rule) -> Column:
    """Raw capture of one rule, as from ``_first``; a rule with a constant gives '1' or null."""
    if rule.parser == "constant":
        return F.when(_has(fold, rule.pattern, rule.stems), F.lit("1"))
    return _first(fold, rule.pattern, rule.group, rule.stems)


def _refined(raw: Column, rule: R.Rule) -> Column:
    """Narrow a capture to the part that holds the value."""
    if rule.refine is None:
        return raw
    return null_if_empty(F.regexp_extract(raw, rule.refine, 2 if rule.parser == "date_second" else 1))


def _values(rules: list[tuple[Column, R.Rule]]) -> dict[str, Column]:
    """Parse all captures of one parser together: one expression in the plan per parser."""
    return {
        parser: F.transform(
            F.array(*[_refined(raw, rule) for raw, rule in rules if rule.parser == parser]), function
        )
        for parser, function in PARSERS.items()
        if any(rule.parser == parser for _, rule in rules)
    }


def _field(field: R.Field, raws: list[Column], values: list[Column]) -> Column:
    """First rule whose value is usable wins; otherwise the reason it is missing."""
    attempts = []
    for rule, value in zip(field.rules, values):
        usable = value.between(*field.valid) if field.valid else value.isNotNull()
        attempts.append(F.when(usable, found(value, rule.confidence, field.type, rule.detail)))
    reason = F.lit(field.missing)
    if field.out_of_range:
        reason = F.when(
            values[0].isNotNull(), F.concat(F.lit(field.out_of_range), values[0].cast("string"))
        ).otherwise(reason)
    if field.unreadable:
        reason = F.when(raws[0].isNotNull(), F.lit(field.unreadable)).otherwise(reason)
    return F.coalesce(*attempts, missing(field.type, reason))


# ---- blocks of the parties --------------------------------------------------------------
_MARK = "\x01"


def labelled_blocks(text: Column, root: str, opposite: str) -> Column:
    """Blocks that follow a party's label, each up to its border; blocks that are too long are left out.

    Labels are marked where their block begins. From a mark on the text is read up to the next border
    (blank line, the other party, section heading); a block is what such a piece holds
    behind a mark, provided the piece ends near enough.
    """
    marked = F.regexp_replace(
        F.replace(text, F.lit(_MARK), F.lit(" ")),
        f"{R.PARTY_HEAD}(?iuU)({root}{R.LABEL_SUFFIX}{R.LABEL_SEPARATOR})", f"$1{_MARK}",
    )
    borders = "|".join([R.BLANK_LINE, opposite, *R.SECTION_WORDS])
    pieces = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?:(?!{R.BORDER_HEAD}(?iuU:{borders}))(?s:.))*+"), F.lit(0))
    behind = F.transform(
        pieces,
        lambda p: F.when(
            F.instr(F.substring(p, 2, 1 << 30), _MARK) > 0,
            F.regexp_extract(p, f"(?s){_MARK}([^{_MARK}](?:{_MARK}?[^{_MARK}]){{0,{R.BLOCK_LENGTH - 1}}}){_MARK}?\\z", 1),
        ).when(F.length(p) <= R.BLOCK_LENGTH + 1, p).otherwise(""),
    )
    return F.filter(F.transform(behind, lambda b: F.replace(b, F.lit(_MARK), F.lit(""))), lambda b: b != "")


# ---- parties (E1-E4) ------------------------------------------------------------------
def parse_parties(blocks: Column) -> Column:
    """Name, tax id and type of every qualification block of an array.

    One array element becomes one field result; a null block stays null. The
    steps are chained so that every pattern runs once per block.
    """
    searched = F.transform(
        blocks,
        lambda b: F.when(
            b.isNotNull(),
            F.struct(
                collapse_ws(
                    F.btrim(F.regexp_replace(b, R.NAME_END + "(?s:.*)", ""), F.lit(R.NAME_EDGE))
                ).alias("name"),
                F.regexp_substr(b, F.lit(COMPANY_PATTERN)).alias("company"),
                F.regexp_substr(b, F.lit(PERSON_PATTERN)).alias("person"),
            ),
        ),
    )
    typed = F.transform(
        searched,
        lambda s: F.when(
            s.isNotNull(),
            F.struct(
                F.when(s["company"].isNotNull(), F.lit("PJ"))
                .when(s["person"].isNotNull(), F.lit("PF"))
                .when(s["name"].rlike(R.COMPANY_WORDS), F.lit("PJ"))
                .alias("type"),
                F.when(s["name"].rlike(R.NAME_LETTER), s["name"]).alias("name"),
                null_if_empty(digits_only(F.coalesce(s["company"], s["person"]))).alias("document"),
            ),
        ),
    )
    both = lambda p: p["name"].isNotNull() & p["document"].isNotNull()
    either = lambda p: p["name"].isNotNull() | p["document"].isNotNull()
    return F.transform(
        typed,
        lambda p: F.when(both(p), found(p, R.HIGH, PARTY))
        .when(either(p), found(p, R.MEDIUM, PARTY))
        .when(p.isNotNull(), missing(PARTY)),
    )


def same_party(a: Column, b: Column) -> Column:
    """equal documents when both have one, else equal names, else false."""
    return F.coalesce(
        F.when(
            null_if_empty(a["document"]).isNotNull() & null_if_empty(b["document"]).isNotNull(),
            a["document"] == b["document"],
        ).when(
            null_if_empty(a["name"]).isNotNull() & null_if_empty(b["name"]).isNotNull(),
            name_key(a["name"]) == name_key(b["name"]),
        ),
        F.lit(False),
    )


def _prose_window(
    text: Column, fold: Column, labelled: Column, root: str, opposite: str, stems: tuple[str, ...]
) -> Column:
    """Text after an unseparated label, up to the other party; null when not needed."""
    window = F.regexp_extract(text, R.prose_window(root), 1)
    own = F.regexp_replace(window, rf"{R.PARTY_HEAD}(?iuUs)\b{opposite}\b.*", "")
    unresolved = F.coalesce(labelled["confidence"] < R.REVIEW_LIMIT, F.lit(True))
    return F.when(
        unresolved & contains_any(fold, stems), F.regexp_replace(own, R.PROSE_FILLER, "")
    )


def _prose_party(parsed: Column) -> Column:
    """Party found in running text, at medium confidence at most; else null."""
    return F.when(
        parsed["value"].isNotNull(),
        found(
            parsed["value"], F.least(parsed["confidence"], F.lit(R.MEDIUM)), PARTY, R.PROSE_DETAIL
        ),
    )


def _party(labelled: Column, prose: Column, label: str) -> Column:
    return F.coalesce(
        F.when(labelled["confidence"] >= R.REVIEW_LIMIT, labelled),
        prose,
        labelled,
        missing(PARTY, R.NO_LABEL.format(label)),
    )


def _extra_landlords(blocks: Column, principal: Column) -> Column:
    """Later labelled blocks that are neither the principal nor repeated."""
    parsed = F.filter(
        parse_parties(blocks),
        lambda p: p["value"].isNotNull() & ~same_party(p["value"], principal),
    )
    empty = F.array().cast(f"array<{result_type(PARTY)}>")
    kept = F.aggregate(
        parsed,
        empty,
        lambda acc, p: F.when(
            F.exists(acc, lambda k: same_party(k["value"], p["value"])), acc
        ).otherwise(F.concat(acc, F.array(p))),
    )
    type_ = FIELD_TYPES["extra_landlords"]
    return F.when(
        F.size(kept) > 0,
        found(
            F.transform(kept, lambda p: p["value"]),
            F.array_min(F.transform(kept, lambda p: p["confidence"])),
            type_,
        ),
    ).otherwise(found(F.array(), R.HIGH, type_))


# ---- single fields with their own logic ------------------------------------------------
def _lease_type(title: Column, residential: Column, commercial: Column) -> Column:
    """E5: the title decides; else the body when it names exactly one type."""
    by_title = F.when(title.startswith(R.TITLE_COMMERCIAL_PREFIX), F.lit("comercial")).otherwise(
        F.lit("residencial")
    )
    by_body = F.when(residential & ~commercial, F.lit("residencial")).when(
        commercial & ~residential, F.lit("comercial")
    )
    return (
        F.when(title.isNotNull(), found(by_title, R.HIGH, "string", R.TITLE_DETAIL))
        .when(by_body.isNotNull(), found(by_body, R.HIGH, "string"))
        .otherwise(missing("string", R.NO_INTERPRETER))
    )


def _penalty(amount: Column, count: Column, rent: Column) -> Column:
    """Amount in the text, else a number of rents times the rent."""
    type_ = FIELD_TYPES["termination_penalty"]
    return (
        F.when(amount.isNotNull(), found(amount, R.HIGH, type_))
        .when(
            count.isNotNull() & rent.isNotNull(),
            found(
                (rent * count).cast(type_), R.MEDIUM, type_,
                F.format_string(R.PENALTY_RENTS_DETAIL, count),
            ),
        )
        .when(count.isNotNull(), missing(type_, F.format_string(R.PENALTY_NO_BASE, count)))
        .otherwise(missing(type_, R.PENALTY_MISSING))
    )


def _guarantees(fold: Column) -> Column:
    """Guarantee types in fixed order; surety is sought without bond insurance."""
    tests = [
        F.when(_has(fold, pattern, (stem,)), F.lit(code)) for code, pattern, stem in R.GUARANTEES
    ]
    code, pattern, stem = R.SURETY
    rest = F.when(contains_any(fold, (R.BOND_STEM,)), F.regexp_replace(fold, R.BOND_INSURANCE, " ")).otherwise(fold)
    tests.append(F.when(contains_any(fold, (stem,)) & rest.rlike(pattern), F.lit(code)))
    return F.array_compact(F.array(*tests))


def _grace(raw: Column) -> Column:
    """Months; absent (null) is a confident null; named without months is a gap."""
    months = _int(raw)
    return (
        F.when(months.isNotNull(), found(months, R.HIGH, "int"))
        .when(raw.isNotNull(), missing("int", R.GRACE_UNCLEAR))
        .otherwise(found(None, R.HIGH, "int"))
    )


def _index_source(fold: Column, index: Column) -> Column:
    """Source named right after the first mention of the chosen index."""
    window = F.lit(None).cast("string")
    for name, pattern, _ in R.INDICES:
        after = F.regexp_extract(
            fold, "%s(?s:%s)(.{0,%d})" % ("(?Us)", pattern, R.INDEX_SOURCE_WINDOW), 1
        )
        window = F.when(index == name, after).otherwise(window)
    source = F.upper(null_if_empty(F.regexp_extract(window, R.INDEX_SOURCE, 1)))
    return found(source, R.HIGH, "string")


def _flag(fold: Column, pattern: str, stems: tuple[str, ...], absent: str) -> Column:
    """True when named; otherwise false at low confidence."""
    return F.when(_has(fold, pattern, stems), found(True, R.HIGH, "boolean")).otherwise(
        found(False, R.LOW, "boolean", absent)
    )


def _expense_matches(fold: Column) -> list[Column]:
    """Position of each expense word, null without its stem; its text where the anchor depends on it."""
    columns = []
    for code, pattern, stem in R.EXPENSES:
        columns.append(F.when(contains_any(fold, (stem,)), F.regexp_instr(fold, F.lit(pattern))).alias(f"_at_{code}"))
        if R.EXPENSE_ANCHOR_WORD in pattern:
            columns.append(F.when(contains_any(fold, (stem,)), F.regexp_substr(fold, F.lit(pattern))).alias(f"_match_{code}"))
    return columns


def _expense_anchor(code: str, pattern: str) -> Column:
    """1-based position of the expense word; null when the expense is absent."""
    start = F.col(f"_at_{code}")
    anchor = start
    if R.EXPENSE_ANCHOR_WORD in pattern:
        match = F.col(f"_match_{code}")
        at_end = start + F.length(match) - R.EXPENSE_ANCHOR_LENGTH
        anchor = F.when(match.startswith(R.EXPENSE_ANCHOR_WORD), start).otherwise(at_end)
    return F.when(start > 0, anchor)


def _payer_window(fold: Column, anchor: Column) -> Column:
    """Text around the anchor, padded so that the anchor is always at PAYER_REACH + 1."""
    reach = R.PAYER_REACH
    left = F.least(anchor - 1, F.lit(reach))
    return F.concat(
        F.repeat(F.lit(" "), F.lit(reach) - left), F.substring(fold, anchor - left, left + reach)
    )


def _payers(windows: Column) -> Column:
    """Nearest party label of each window; an exact tie or no label gives null.

    Each step is a pass over the windows, so that every pattern runs once for a window.
    """
    reach, far = R.PAYER_REACH, 10 * R.PAYER_REACH
    before, after = "(?Us)^(#.{0,%d})%s" % (reach - 1, "%s"), "(?Us)^(#.{%d,}?)%s" % (reach, "%s")
    (first, first_pattern), (second, second_pattern) = R.PAYERS
    searched = F.transform(
        F.transform(windows, lambda w: F.concat(F.lit("#"), w)),
        lambda w: F.struct(
            *[
                F.length(F.regexp_extract(w, form % pattern, 1)).alias(f"{side}{i}")
                for i, pattern in enumerate((first_pattern, second_pattern))
                for side, form in (("before", before), ("after", after))
            ]
        ),
    )
    # Without a match the length is 0; with one the text holds the mark in front at least.
    distance = lambda s, i: F.least(
        F.when(s[f"before{i}"] > 0, reach + 1 - s[f"before{i}"]).otherwise(far),
        F.when(s[f"after{i}"] > 0, s[f"after{i}"] - (reach + 1)).otherwise(far),
    )
    apart = F.transform(searched, lambda s: distance(s, 0) - distance(s, 1))
    return F.transform(apart, lambda d: F.when(d < 0, F.lit(first)).when(d > 0, F.lit(second)))


def _expenses(windows: Column) -> Column:
    """Expense type to payer, for the types present (windows in rule order)."""
    type_ = FIELD_TYPES["expenses"]
    codes = F.array(*[F.lit(code) for code, *_ in R.EXPENSES])
    named = F.filter(
        F.arrays_zip(codes.alias("key"), windows.alias("window")), lambda entry: entry["window"].isNotNull()
    )
    payers = _payers(F.transform(named, lambda entry: entry["window"]))
    entries = F.zip_with(
        named, payers, lambda entry, payer: F.struct(entry["key"].alias("key"), payer.alias("value"))
    )
    return F.when(
        F.exists(windows, lambda w: w.isNotNull()),
        found(F.map_from_entries(entries), R.HIGH, type_),
    ).otherwise(missing(type_, R.EXPENSES_MISSING))


def _calculated_next(explicit: Column, start: Column, period: Column, ref: Column) -> Column:
    """Next date from start and period when the text has none."""
    months = F.coalesce(F.nullif(period, F.lit(0)), F.lit(R.DEFAULT_PERIOD))
    when = P.next_adjustment(start, months, ref)
    detail = F.format_string(R.CALCULATED_DETAIL, F.date_format(start, "dd/MM/yyyy"), months)
    return F.when(
        explicit["value"].isNull() & when.isNotNull(),
        result(when, R.LOW, R.BY_CALCULATION, detail, "date"),
    ).otherwise(explicit)


# ---- the stages --------------------------------------------------------------------------
CARRIED = ("adjustment_automatic", "renewal_automatic", "waives_improvements", "cumulates_penalties")
TEXT, FOLD = "_text", "_fold"


def _attempts(rules: tuple[R.Field, ...]) -> list[tuple[R.Field, int, R.Rule]]:
    return [(field, i, rule) for field in rules for i, rule in enumerate(field.rules)]


def _capture_names(rules: tuple[R.Field, ...]) -> dict[tuple[str, int], str]:
    """Column of each rule's capture, by field and place; rules that capture the same share one."""
    shared: dict[tuple, str] = {}
    return {
        (field.name, i): shared.setdefault(
            (rule.pattern, rule.group, rule.stems, rule.parser == "constant"), f"_{field.name}_{i}"
        )
        for field, i, rule in _attempts(rules)
    }


def _capture_stage(rules: tuple[R.Field, ...]) -> list[Column | str]:
    """Every pattern once over the whole text."""
    text, fold, names = F.col(TEXT), F.col(FOLD), _capture_names(rules)
    return [
        TEXT,
        FOLD,
        *[
            _capture(fold, rule).alias(f"_{field.name}_{i}")
            for field, i, rule in _attempts(rules)
            if names[field.name, i] == f"_{field.name}_{i}"
        ],
        F.when(
            contains_any(fold, R.LANDLORD_STEMS),
            labelled_blocks(text, R.LANDLORD_ROOT, R.TENANT_ROOT),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("_landlord_blocks"),
        F.when(
            contains_any(fold, R.TENANT_STEMS),
            F.get(labelled_blocks(text, R.TENANT_ROOT, R.LANDLORD_ROOT), F.lit(0)),
        ).alias("_tenant_block"),
        _first(fold, R.PENALTY_VALUE, 1, R.PENALTY_STEMS).alias("_penalty_value"),
        _first(fold, R.PENALTY_RENTS, 1, R.PENALTY_STEMS).alias("_penalty_rents"),
        *_expense_matches(fold),
        _guarantees(fold).alias("_guarantees"),
        _first(fold, R.GRACE_MONTHS, 1, R.GRACE_STEMS).alias("_grace"),
        _first(fold, R.TITLE_TYPE, 1, R.TITLE_STEMS).alias("_title"),
        _flag(
            fold, R.AUTOMATIC_ADJUSTMENT, R.AUTOMATIC_ADJUSTMENT_STEMS, R.AUTOMATIC_ADJUSTMENT_MISSING
        ).alias("adjustment_automatic"),
        _flag(
            fold, R.AUTOMATIC_RENEWAL, R.AUTOMATIC_RENEWAL_STEMS, R.AUTOMATIC_RENEWAL_MISSING
        ).alias("renewal_automatic"),
        _has(fold, R.IMPROVEMENTS_WAIVER, R.IMPROVEMENTS_STEMS).alias("waives_improvements"),
        _has(fold, R.CUMULATIVE_PENALTIES, R.CUMULATIVE_STEMS).alias("cumulates_penalties"),
    ]


def _value_stage(rules: tuple[R.Field, ...]) -> list[Column | str]:
    """Typed values from the captures; short strings only."""
    fold, names = F.col(FOLD), _capture_names(rules)
    captured = lambda field, i: null_if_empty(F.col(names[field.name, i]))
    attempts = [(captured(f, i), rule) for f, i, rule in _attempts(rules)]
    title = null_if_empty(F.col("_title"))
    return [
        TEXT,
        FOLD,
        *CARRIED,
        "_landlord_blocks",
        "_guarantees",
        _grace(F.col("_grace")).alias("grace_months"),
        title.alias("_title"),
        # The body is read only where the title says nothing.
        F.when(title.isNull(), _has(fold, R.BODY_RESIDENTIAL, R.BODY_RESIDENTIAL_STEMS)).alias("_residential"),
        F.when(title.isNull(), _has(fold, R.BODY_COMMERCIAL, R.BODY_COMMERCIAL_STEMS)).alias("_commercial"),
        *[captured(field, 0).alias(f"_{field.name}_0") for field in rules if field.unreadable],
        *[
            F.col(names[f.name, i]).alias(f"_is_{f.name}_{i}")
            for f, i, rule in _attempts(rules)
            if rule.parser == "constant"
        ],
        *[column.alias(f"_values_{parser}") for parser, column in _values(attempts).items()],
        P.parse_money(F.col("_penalty_value")).alias("_penalty_value"),
        _int(F.col("_penalty_rents")).alias("_penalty_rents"),
        parse_parties(
            F.array(F.get("_landlord_blocks", F.lit(0)), F.col("_tenant_block"))
        ).alias("_parties"),
        F.transform(
            F.array(*[_expense_anchor(code, pattern) for code, pattern, _ in R.EXPENSES]),
            lambda anchor: F.when(anchor.isNotNull(), _payer_window(fold, anchor)),
        ).alias("_windows"),
    ]


def _value_columns(field: R.Field, rules: tuple[R.Field, ...]) -> list[Column]:
    """The parsed values of one field, in rule order."""
    columns = []
    for i, rule in enumerate(field.rules):
        if rule.parser == "constant":
            columns.append(F.when(F.col(f"_is_{field.name}_{i}").isNotNull(), F.lit(rule.constant)))
        else:
            peers = [(f.name, j) for f, j, r in _attempts(rules) if r.parser == rule.parser]
            columns.append(F.get(f"_values_{rule.parser}", F.lit(peers.index((field.name, i)))))
    return columns


def _field_stage(rules: tuple[R.Field, ...]) -> list[Column | str]:
    """Field results, and the prose fallback of a party its label did not resolve."""
    text, fold = F.col(TEXT), F.col(FOLD)
    landlord, tenant = F.get("_parties", F.lit(0)), F.get("_parties", F.lit(1))
    return [
        FOLD,
        *CARRIED,
        "grace_months",
        _lease_type(F.col("_title"), F.col("_residential"), F.col("_commercial")).alias("lease_type"),
        "_landlord_blocks",
        "_penalty_value",
        "_penalty_rents",
        *[
            _field(field, [F.col(f"_{field.name}_0")], _value_columns(field, rules)).alias(field.name)
            for field in rules
        ],
        landlord.alias("_landlord"),
        tenant.alias("_tenant"),
        parse_parties(
            F.array(
                _prose_window(text, fold, landlord, R.LANDLORD_ROOT, R.TENANT_ROOT, R.LANDLORD_STEMS),
                _prose_window(text, fold, tenant, R.TENANT_ROOT, R.LANDLORD_ROOT, R.TENANT_STEMS),
            )
        ).alias("_prose"),
        _expenses(F.col("_windows")).alias("expenses"),
        F.when(
            F.size("_guarantees") > 0,
            found(F.col("_guarantees"), R.HIGH, FIELD_TYPES["guarantees"]),
        )
        .otherwise(missing(FIELD_TYPES["guarantees"], R.GUARANTEES_MISSING))
        .alias("guarantees"),
    ]


def _dependent_stage(rules: tuple[R.Field, ...], dated: bool) -> list[Column | str]:
    """Fields that need the value of another field."""
    following = F.col("adjustment_next")
    if dated:
        following = _calculated_next(
            following,
            F.col("start_date.value"),
            F.col("adjustment_period_months.value"),
            F.col("_ref_date"),
        )
    return [
        *CARRIED,
        "grace_months",
        "lease_type",
        *[f.name for f in rules if f.name != "adjustment_next"],
        "guarantees",
        "expenses",
        "_landlord_blocks",
        following.alias("adjustment_next"),
        _penalty(F.col("_penalty_value"), F.col("_penalty_rents"), F.col("rent.value")).alias(
            "termination_penalty"
        ),
        _party(
            F.col("_landlord"), _prose_party(F.get("_prose", F.lit(0))), R.LANDLORD_LABEL
        ).alias("landlord"),
        _party(F.col("_tenant"), _prose_party(F.get("_prose", F.lit(1))), R.TENANT_LABEL).alias("tenant"),
        # A single resolved block is the principal itself.
        ((F.size("_landlord_blocks") > 1) | ~F.coalesce(F.col("_landlord.confidence") > 0, F.lit(False)))
        .alias("_more_landlords"),
        _index_source(F.col(FOLD), F.col("adjustment_index.value")).alias("index_source"),
    ]


def own_fields(rules: tuple[R.Field, ...]) -> list[R.Field]:
    """Fields of a pack that the default one does not have."""
    return [f for f in rules if f.name not in FIELD_NAMES]


def _output_stage(rules: tuple[R.Field, ...]) -> list[Column | str]:
    principal = F.coalesce(
        F.col("landlord.value"),
        F.struct(*[F.lit(None).cast("string").alias(n) for n in ("type", "name", "document")]),
    )
    extra = F.when(
        F.col("_more_landlords"), _extra_landlords(F.col("_landlord_blocks"), principal)
    ).otherwise(found(F.array(), R.HIGH, FIELD_TYPES["extra_landlords"]))
    return [
        *[extra.alias(n) if n == "extra_landlords" else n for n in FIELD_NAMES],
        *[f.name for f in own_fields(rules)],
        "waives_improvements",
        "cumulates_penalties",
    ]


@lru_cache(maxsize=32)
def _stages(rules: tuple[R.Field, ...], dated: bool) -> tuple[list[Column | str], ...]:
    """The select lists of all stages; built once per rule pack, they name no table."""
    ref = ["_ref_date"] if dated else []
    return (
        _capture_stage(rules) + ref,
        _value_stage(rules) + ref,
        _field_stage(rules) + ref,
        _dependent_stage(rules, dated),
        _output_stage(rules),
    )


def extract_fields(
    df: DataFrame,
    text_col: str = "text",
    rules: tuple[R.Field, ...] = R.FIELDS,
    ref_date: date | str | Column | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Add one result struct per contract field to every document.

    ``ref_date`` switches on the calculated next adjustment; without it that
    field holds only a date written in the text. The other columns of ``df`` stay;
    the text itself is dropped unless ``keep_text``, so that later stages do not
    carry it. ``rules`` may hold fields of the caller's own beside all of the default pack
    (``rule_tables``).
    """
    kept = [c for c in df.columns if keep_text or c != text_col]
    taken = set(kept) & {*FIELD_NAMES, *[f.name for f in rules]}
    if taken:
        raise ValueError(f"input columns clash with extracted fields: {sorted(taken)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    ref = [P.as_date(ref_date).alias("_ref_date")] if ref_date is not None else []
    staged = df.select(*kept, text.alias(TEXT), fold_case(text).alias(FOLD), *ref)
    for stage in _stages(rules, ref_date is not None):
        staged = staged.select(*kept, *stage)
    return staged


# ---- ambiguous fields (E25, F25, U2) --------------------------------------------------------
def _excerpt(text: Column, fold: Column, length: int) -> Column:
    cut = F.substring(text, 1, length)
    for term in reversed(R.EXCERPT_TERMS):
        at = F.instr(fold, term)
        start = F.greatest(F.lit(1), at - length // 4)
        cut = F.when(at > 0, F.substring(text, start, F.lit(length))).otherwise(cut)
    return cut


def with_excerpt(
    df: DataFrame, text_col: str, out: str, wanted: Column | None = None, length: int = R.EXCERPT_LENGTH
) -> DataFrame:
    """text around the first anchor term, in priority order; else the head.

    Rows that are not ``wanted`` get null.
    """
    fold = fold_case(F.col(text_col))
    folded = df.withColumn("_folded", fold if wanted is None else F.when(wanted, fold))
    cut = F.when(
        F.col("_folded").isNotNull(), _excerpt(F.col(text_col), F.col("_folded"), length)
    )
    return folded.withColumn(out, cut).drop("_folded")


def answered(
    excerpts: DataFrame, interpreter: Callable[[Column], Column], root: str, col: str = "_excerpt"
) -> DataFrame:
    """``hash`` and ``reply`` of all distinct excerpts, asking only for those without a stored answer.

    New answers are added to the table at ``root`` when all of them are there; a null reply counts as none, so
    the next run asks again. Of two answers, as from runs side by side, the least counts.
    """
    spark = excerpts.sparkSession
    open_ = excerpts.where(F.col(col).isNotNull()).select(F.col(col).alias("excerpt")).distinct()
    open_ = open_.withColumn("hash", F.sha2("excerpt", 256))
    if _holds_table(spark, root):
        open_ = open_.join(spark.read.parquet(root).where(F.col("reply").isNotNull()).select("hash").distinct(), "hash", "left_anti")
    # A filter on the reply here would be moved before the projection, and ask twice.
    open_.select("hash", interpreter(F.col("excerpt")).alias("reply")).write.mode("append").parquet(root)
    return spark.read.parquet(root).where(F.col("reply").isNotNull()).groupBy("hash").agg(F.min("reply").alias("reply"))


def _holds_table(spark: SparkSession, root: str) -> bool:
    try:
        spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def route_ambiguous(
    df: DataFrame,
    text_col: str,
    interpreter: Callable[[Column], Column] | None = None,
    field: str = "lease_type",
    allowed: tuple[str, ...] = R.LEASE_TYPES,
    answers: str | None = None,
) -> DataFrame:
    """Ask the caller's interpreter about the unresolved rows, and about no others.

    ``interpreter`` maps the excerpt column to ``struct<value, confidence,
    detail>`` (an Arrow ``pandas_udf`` or any Column function); a null answer means that
    it is not configured. It is asked once for each distinct excerpt (the empty one for a null
    text); with ``answers``, a folder of stored answers, also over all runs of one field. A reply
    outside ``allowed``, or no interpreter, leaves the field not found, with the reason. Rows
    and excerpts are written once and read by all parts; the questions are asked when this is called.
    """
    resolved = F.coalesce(
        F.col(field)["value"].isNotNull() & (F.col(field)["confidence"] >= R.REVIEW_LIMIT), F.lit(False)
    )
    if interpreter is None:
        return df.withColumn(field, F.when(resolved, F.col(field)).otherwise(missing("string", R.NO_INTERPRETER)))
    whole = with_excerpt(df.withColumn("_source", F.coalesce(F.col(text_col), F.lit(""))), "_source", "_excerpt", ~resolved)
    rows = stored(whole.drop("_source"), "routing")
    unresolved = rows.where(F.col("_excerpt").isNotNull())
    replies = answered(unresolved, interpreter, answers or work_folder(df.sparkSession, "answers"))
    replies = replies.select(F.col("hash").alias("_hash"), F.col("reply").alias("_reply"))
    reply = F.col("_reply")
    value = F.lower(F.trim(reply["value"]))
    decided = (
        F.when(reply.isNull(), missing("string", R.INTERPRETER_ABSENT))
        .when(value.isin(*allowed), result(value, reply["confidence"], R.BY_INTERPRETER, reply["detail"], "string"))
        .otherwise(missing("string", R.INTERPRETER_UNDECIDED))
    )
    plain = ["_excerpt", *[n for n, t in df.dtypes if t in ("string", "int", "bigint")]]
    asked = lookup_join(
        unresolved.withColumn("_hash", F.sha2("_excerpt", 256)), replies, ["_hash"], plain
    ).withColumn(field, decided)
    return rows.where(F.col("_excerpt").isNull()).select(*df.columns).unionByName(asked.select(*df.columns))


# ---- provenance and assembly (E23, E24, E26, A9) -----------------------------------------------
def needs_review(field: Column) -> Column:
    return (field["origin"] == R.NOT_FOUND) | (field["confidence"] < R.REVIEW_LIMIT)


def _record(field: Column) -> Column:
    return F.struct(
        field["origin"].alias("origin"),
        field["confidence"].alias("confidence"),
        needs_review(field).alias("needs_review"),
        field["detail"].alias("detail"),
    )


def with_provenance(df: DataFrame, rules: tuple[R.Field, ...] = R.FIELDS) -> DataFrame:
    """Provenance map, the sorted fields to review, and the review flag.

    Needs the alert list of ``compliance_flags``.
    """
    legal = F.struct(
        F.lit(R.BY_RULE).alias("origin"),
        F.lit(R.HIGH).alias("confidence"),
        F.lit(False).alias("needs_review"),
        F.concat(F.size("flags.alerts").cast("string"), F.lit(R.LEGAL_FLAGS_DETAIL)).alias("detail"),
    )
    fields = [*R.PROVENANCE_KEYS, *[(f.name, f.key) for f in own_fields(rules)]]
    keys = [key for _, key in fields] + [R.LEGAL_FLAGS_KEY]
    provenance = F.map_from_arrays(
        F.array(*[F.lit(k) for k in keys]),
        F.array(*[_record(F.col(name)) for name, _ in fields], legal),
    )
    review = F.array_sort(
        F.array_compact(
            F.array(
                *[F.when(needs_review(F.col(n)), F.lit(k)) for n, k in fields]
            )
        )
    )
    return df.withColumns({"provenance": provenance, "review_fields": review}).withColumn(
        "contract_needs_review", F.size("review_fields") > 0
    )


def assemble_contracts(df: DataFrame, rules: tuple[R.Field, ...] = R.FIELDS) -> DataFrame:
    """Replace the result structs by their values, provenance kept beside them."""
    own = [f.name for f in own_fields(rules)]
    others = [c for c in df.columns if c not in FIELD_NAMES and c not in own]
    return df.select(
        *others,
        *[
            F.coalesce(F.col(f"{n}.value"), F.array().cast(FIELD_TYPES[n])).alias(n)
            if FIELD_TYPES[n].startswith("array")
            else F.col(f"{n}.value").alias(n)
            for n in FIELD_NAMES
        ],
        *[F.col(f"{n}.value").alias(n) for n in own],
    )


def provenance_long(df: DataFrame, *id_cols: str) -> DataFrame:
    """One row per document and field, from the provenance map."""
    return df.select(*id_cols, F.explode("provenance").alias("field", "record")).select(
        *id_cols, "field", "record.*"
    )


def review_workload(df: DataFrame) -> DataFrame:
    """Documents per field that need review, with the mean confidence."""
    return (
        df.select(F.explode("provenance").alias("field", "record"))
        .groupBy("field")
        .agg(
            F.count("*").alias("documents"),
            F.count_if("record.needs_review").alias("to_review"),
            F.avg("record.confidence").alias("mean_confidence"),
        )
    )
