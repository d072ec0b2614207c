"""Portfolio import from messy sheets: header, column roles, row outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.functions.keys import looks_like_key, normalise_key
from leaselake.functions.parsing import clean_list
from leaselake.functions.text import header_key, strip_ws
from leaselake.operators.skew import HOT_ROWS, attach_group, lookup_join, running_total

# Header words in priority order, limits, messages.
KEY_WORDS = ("cnpj",)
NAME_WORDS = ("razao", "social", "empresa", "nome")
KEY_SHARE = 0.6
HEADER_ROWS = 10
SAMPLE_ROWS = 20
NO_KEY_COLUMN = "Não foi possível identificar a coluna de CNPJ (nem por cabeçalho, nem por valor)."
NO_NAME_COLUMN = "Não foi possível identificar a coluna de Razão Social."
KEY_PREFIX = "CNPJ inválido: "
KEY_ABSENT = "CNPJ ausente na linha."
EMPTY_NAME = "Dados inválidos: Razão Social: String should have at least 1 character"

IMPORTED, DUPLICATE, ERROR, BLANK = "imported", "duplicate", "error", "blank"


def _has_word(cell: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.contains(header_key(cell), F.lit(word))
    return test


def source_heads(rows: DataFrame, max_rows: int = HEADER_ROWS) -> DataFrame:
    """First rows of every source, one row per source; all header work reads only this."""
    return (
        rows.where(F.col("row") < max_rows)
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("head"))
    )


def with_header_row(heads: DataFrame) -> DataFrame:
    """Best score of the first rows, lowest row on ties, row 0 when none scores."""
    scored = F.transform(
        "head",
        lambda r: F.struct(
            (
                F.exists(r["cells"], lambda c: _has_word(c, KEY_WORDS)).cast("int")
                + F.exists(r["cells"], lambda c: _has_word(c, NAME_WORDS)).cast("int")
            ).alias("score"),
            (-r["row"]).alias("at"),
        ),
    )
    return heads.withColumn("_best", F.array_max(scored)).withColumn(
        "header_row",
        F.when(F.col("_best.score") > 0, -F.col("_best.at")).otherwise(F.lit(0).cast("long")),
    ).drop("_best")


def detect_header(rows: DataFrame, max_rows: int = HEADER_ROWS) -> DataFrame:
    """Header row per source."""
    return with_header_row(source_heads(rows, max_rows)).select("source", "header_row")


def _by_header(cells: Column, words: tuple[str, ...], exclude: Column | None = None) -> Column:
    """First column, by word priority then position, whose header holds the word."""
    found = []
    for word in words:
        hits = F.filter(
            F.transform(cells, lambda c, i: F.when(F.contains(header_key(c), F.lit(word)), i)),
            lambda i: i.isNotNull() if exclude is None else i.isNotNull() & (i != F.coalesce(exclude, F.lit(-1))),
        )
        found.append(F.get(hits, F.lit(0)))
    return F.coalesce(*found)


def value_profile(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Per source and column: filled cells, cells like a key, cells with text."""
    data = lookup_join(rows, headers, ["source"], ["row"]).where(F.col("row") > F.col("header_row"))
    cells = data.select("source", F.posexplode("cells").alias("col", "value"))
    text = strip_ws(F.coalesce(F.col("value"), F.lit("")))
    numeric = F.regexp_replace(text, "[./-]", "").rlike(r"^(?U)\d+$")
    return cells.groupBy("source", "col").agg(
        F.count_if(text != "").alias("filled"),
        F.count_if((text != "") & looks_like_key(F.col("value"))).alias("key_like"),
        F.count_if((text != "") & ~numeric).alias("textual"),
    )


def _profile_per_source(profile: DataFrame) -> DataFrame:
    """Column profiles of a source as one short array."""
    return profile.groupBy("source").agg(
        F.collect_list(F.struct("col", "filled", "key_like", "textual")).alias("_columns")
    )


def _key_by_value(columns: Column) -> Column:
    """Highest share of key-like cells, at least the limit; the later column on ties."""
    shares = F.transform(
        F.filter(columns, lambda c: (c["filled"] > 0) & (c["key_like"] / c["filled"] >= KEY_SHARE)),
        lambda c: F.struct((c["key_like"] / c["filled"]).alias("share"), c["col"].alias("col")),
    )
    return F.array_max(shares)["col"]


def _name_by_value(columns: Column, key_col: Column) -> Column:
    """Most cells with text, not the key column; the earlier column on ties."""
    texts = F.transform(
        F.filter(columns, lambda c: (c["col"] != key_col) & (c["textual"] > 0)),
        lambda c: F.struct(c["textual"].alias("textual"), (-c["col"]).alias("at")),
    )
    return -F.array_max(texts)["at"]


def map_columns(
    rows: DataFrame,
    search_header: bool = False,
    explicit: DataFrame | None = None,
    header_rows: DataFrame | None = None,
) -> DataFrame:
    """Key and name column per source, by header, else by values, else an error.

    Row 0 is the header unless ``search_header``; ``header_rows`` (source, header_row)
    names it for some or all sources. The value profile reads only the
    sources whose header left a role open. ``explicit`` (source, key_col, name_col)
    overrides detection. The result has one row per source; store it before using
    it on the rows again.
    """
    heads = source_heads(rows)
    heads = with_header_row(heads) if search_header else heads.withColumn("header_row", F.lit(0).cast("long"))
    if header_rows is not None:
        # The row named may lie beyond the first rows.
        named = header_rows.select("source", F.col("header_row").cast("long").alias("row"))
        own = named.join(rows, ["source", "row"], "left").select("source", F.col("row").alias("_row"), F.col("cells").alias("_own"))
        heads = heads.join(own, "source", "left").withColumn("header_row", F.coalesce("_row", "header_row"))
    cells = F.get(F.filter("head", lambda r: r["row"] == F.col("header_row")), F.lit(0))["cells"]
    if header_rows is not None:
        cells = F.when(F.col("_row").isNotNull(), F.col("_own")).otherwise(cells)
    roles = (
        heads.select("source", "header_row", cells.alias("_cells"))
        .withColumn("key_by_header", _by_header(F.col("_cells"), KEY_WORDS))
        .withColumn("name_by_header", _by_header(F.col("_cells"), NAME_WORDS, F.col("key_by_header")))
    )
    unsure = roles.where(F.col("key_by_header").isNull() | F.col("name_by_header").isNull())
    profile = value_profile(
        rows, unsure.select("source", "header_row")
    )
    known = roles.join(_profile_per_source(profile), "source", "left").withColumn(
        "key_col", F.coalesce("key_by_header", _key_by_value(F.col("_columns")))
    )
    # The name search skips the key column, also one found by its values.
    named = known.withColumn(
        "name_col",
        F.when(
            F.col("key_col").isNotNull(),
            F.coalesce(
                _by_header(F.col("_cells"), NAME_WORDS, F.col("key_col")),
                _name_by_value(F.col("_columns"), F.col("key_col")),
            ),
        ),
    )
    mapping = named.select(
        "source",
        "header_row",
        "key_col",
        "name_col",
        F.when(F.col("key_col").isNull(), F.lit(NO_KEY_COLUMN))
        .when(F.col("name_col").isNull(), F.lit(NO_NAME_COLUMN))
        .alias("error"),
    )
    if explicit is None:
        return mapping
    given = explicit.select(
        "source", F.col("key_col").alias("_key"), F.col("name_col").alias("_name")
    )
    return mapping.join(given, "source", "left").select(
        "source",
        "header_row",
        F.coalesce("_key", "key_col").alias("key_col"),
        F.coalesce("_name", "name_col").alias("name_col"),
        F.when(F.col("_key").isNull(), F.col("error")).alias("error"),
    )


def profile_sources(rows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Rows, sample, header row, column roles and estimated data rows per source."""
    mapping = map_columns(rows, search_header=True) if mapping is None else mapping
    in_sample = F.col("row") < SAMPLE_ROWS
    sizes = rows.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.array_sort(
            F.array_compact(F.collect_list(F.when(in_sample, F.struct("row", "cells"))))
        ).alias("_sample"),
    )
    return sizes.join(mapping, "source", "left").select(
        "source",
        "rows",
        F.transform("_sample", lambda r: r["cells"]).alias("sample"),
        "header_row",
        F.when(F.col("error").isNull(), F.struct("key_col", "name_col")).alias("mapping"),
        F.greatest(F.col("rows") - F.col("header_row") - 1, F.lit(0)).alias("data_rows"),
    )


def suggested_source(profiles: DataFrame) -> DataFrame:
    """The source with most rows, the first by name on ties."""
    return profiles.agg(F.min_by("source", F.struct(-F.col("rows"), "source")).alias("source"))


def import_rows(rows: DataFrame, mapping: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Outcome of every data row of every mapped source.

    A key counts as seen only from the first row that has the key and a name; later
    rows with it are duplicates even without a name, earlier ones are errors.
    """
    mapped = lookup_join(rows, mapping.where(F.col("error").isNull()).drop("error"), ["source"], ["row"])
    data = mapped.where(F.col("row") > F.col("header_row"))
    raw_key, raw_name = F.get("cells", F.col("key_col")), F.get("cells", F.col("name_col"))
    name = strip_ws(F.coalesce(raw_name, F.lit("")))
    checked = data.select(
        "source",
        "row",
        normalise_key(raw_key).alias("_key"),
        raw_key.isNull().alias("_no_cell"),
        (strip_ws(F.coalesce(raw_key, F.lit(""))) == "").alias("_no_key"),
        name.alias("name"),
    ).select(
        "source", "row", F.col("_key.value").alias("key"), "name",
        (F.col("_no_key") & (F.col("name") == "")).alias("_blank"),
        F.when(F.col("_no_cell"), F.lit(KEY_ABSENT)).otherwise(F.col("_key.reason")).alias("_problem"),
    )
    accepted = F.when(F.col("key").isNotNull() & (F.col("name") != ""), F.col("row"))
    marked = attach_group(
        checked, ["source", "key"], {"_first": F.min(accepted)}, ["row"], hot_rows
    )
    status = (
        F.when(F.col("_blank"), F.lit(BLANK))
        .when(F.col("key").isNull(), F.lit(ERROR))
        .when(F.col("row") > F.col("_first"), F.lit(DUPLICATE))
        .when(F.col("name") == "", F.lit(ERROR))
        .otherwise(F.lit(IMPORTED))
    )
    return marked.withColumn("status", status).select(
        "source",
        (F.col("row") + 1).alias("line"),
        "key",
        "name",
        "status",
        F.when(
            F.col("status") == ERROR,
            F.when(F.col("key").isNull(), F.concat(F.lit(KEY_PREFIX), F.col("_problem"))).otherwise(
                F.lit(EMPTY_NAME)
            ),
        ).alias("reason"),
    )


def import_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    """A2: counters; blank rows count in the total only."""
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("status") == IMPORTED).alias("imported"),
        F.count_if(F.col("status") == DUPLICATE).alias("duplicates"),
        F.count_if(F.col("status") == ERROR).alias("errors"),
    )


def imported_companies(outcomes: DataFrame, portfolio: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Accepted rows as portfolio records; the sheet carries no other names.

    Order numbers go on after the largest stored one: sources by name, each after the
    lines of the ones before. All records of an import are created at one time.
    """
    empty = F.array().cast("array<string>")
    sizes = outcomes.groupBy("source").agg(F.max("line").alias("_lines"))
    offsets = running_total(sizes, ["source"], "_lines", "_offset").drop("_lines")
    top = portfolio.agg(F.coalesce(F.max("portfolio_seq"), F.lit(0)).alias("n")).scalar()
    accepted = outcomes.where(F.col("status") == IMPORTED)
    return lookup_join(accepted, offsets, ["source"], ["line"]).select(
        F.col("key").alias("cnpj"),
        F.col("name").alias("razao_social"),
        empty.alias("aliases"),
        empty.alias("nomes_fantasia"),
        F.lit(True).alias("ativo"),
        F.col("source").alias("origem_import"),
        (top + F.col("_offset") + F.col("line")).alias("portfolio_seq"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def validate_records(df: DataFrame, key: str = "cnpj", name: str = "razao_social") -> DataFrame:
    """M7: add ``reason``, null for a record with a usable key and a name."""
    problem = normalise_key(F.col(key))["reason"]
    parts = F.concat_ws(
        "; ",
        F.concat(F.lit("CNPJ: "), problem),
        F.when(
            strip_ws(F.coalesce(F.col(name), F.lit(""))) == "",
            F.lit("Razão Social: String should have at least 1 character"),
        ),
    )
    return df.withColumn("reason", F.nullif(parts, F.lit("")))


# Fields of a company record in order, their kind, whether a null or no value will do, and messages.
RECORD_FIELDS = (
    ("cnpj", "string", "needed"), ("razao_social", "string", "needed"), ("aliases", "list", "default"), ("nomes_fantasia", "list", "default"),
    ("ativo", "boolean", "default"), ("origem_import", "string", "null"), ("created_at", "datetime", "default"),
)
FIELD_LABELS = {"cnpj": "CNPJ", "razao_social": "Razão Social"}
MISSING, UNEXPECTED, NO_NAME = "Field required", "Extra inputs are not permitted", "String should have at least 1 character"
WRONG_KIND = {
    "string": "Input should be a valid string", "list": "Input should be a valid list",
    "boolean": "Input should be a valid boolean", "datetime": "Input should be a valid datetime",
}
TRUE_WORDS, FALSE_WORDS = ("true", "t", "1", "yes", "y", "on"), ("false", "f", "0", "no", "n", "off")
NO_RECORD = "campo: Input should be a valid dictionary"


def _field(record: Column, name: str) -> dict[str, Column]:
    """A field of a parsed record: its kind in JSON (null where it is absent), text and items."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    return {
        "kind": F.schema_of_variant(value), "text": F.try_variant_get(record, f"$.{name}", "string"),
        "items": F.try_variant_get(record, f"$.{name}", "array<variant>"),
    }


def _fits(field: dict[str, Column], kind: str) -> Column:
    text = field["kind"] == "STRING"
    word = F.lower(field["text"])
    if kind == "string":
        return text
    if kind == "list":
        return field["kind"].startswith("ARRAY")
    if kind == "boolean":
        return (field["kind"] == "BOOLEAN") | (text & word.isin(*TRUE_WORDS, *FALSE_WORDS)) | ((field["kind"] == "BIGINT") & word.isin("0", "1"))
    return (field["kind"] == "BIGINT") | (text & field["text"].try_cast("timestamp").isNotNull())


def _item_faults(items: Column, name: str) -> Column:
    """A message for each item that is no string, null for the others."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    message = lambda i: F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(f": {WRONG_KIND['string']}"))
    faults = F.transform(items, lambda v, i: F.when(kind(v) != "STRING", message(i)))
    return F.coalesce(faults, F.array().cast("array<string>"))


def validate_json(df: DataFrame, line: str = "line") -> DataFrame:
    """M7: add ``reason`` and ``record`` to JSON lines that should be company records, one company each.

    ``reason`` names each field that is missing, of a wrong kind, unusable or not expected, by the order of the
    model and then by that of the line, joined by "; "; it is null for a sound record. ``record`` holds the cleaned
    fields of a sound record and is null for any other. A null line, text that is no JSON and JSON that is no object
    are refused as a whole. An absent field and a null one count as the default where the model has one, and
    a null where it asks for a value is of a wrong kind. Other columns are kept.
    """
    parsed = F.try_parse_json(F.col(line))
    keys = F.json_object_keys(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.col(line)))
    rows = df.withColumns({"_parsed": parsed, "_keys": keys})
    fields = {name: _field(F.col("_parsed"), name) for name, _, _ in RECORD_FIELDS}
    key, owner = normalise_key(fields["cnpj"]["text"]), strip_ws(fields["razao_social"]["text"])
    problems = []
    for name, kind, absent in RECORD_FIELDS:
        field, there = fields[name], F.array_contains("_keys", name)
        null = there & (F.coalesce(field["kind"], F.lit("VOID")) == "VOID")
        problem = F.when(null, F.lit(None if absent == "null" else WRONG_KIND[kind])).when(there & ~_fits(field, kind), WRONG_KIND[kind])
        if absent == "needed":
            problem = F.when(~there, MISSING).otherwise(problem)
        text_ok = there & (field["kind"] == "STRING")
        if name == "cnpj":
            problem = F.when(text_ok, key["reason"]).otherwise(problem)
        if name == "razao_social":
            problem = F.when(text_ok & (owner == ""), NO_NAME).otherwise(problem)
        label = FIELD_LABELS.get(name, name)
        problems.append(F.array(F.concat(F.lit(f"{label}: "), problem)))
        if kind == "list":
            problems.append(_item_faults(field["items"], name))
    known = F.array(*[F.lit(n) for n, _, _ in RECORD_FIELDS])
    problems.append(F.transform(F.array_except("_keys", known), lambda k: F.concat(k, F.lit(f": {UNEXPECTED}"))))
    reason = F.nullif(F.array_join(F.array_compact(F.concat(*problems)), "; "), F.lit(""))
    names = lambda n: clean_list(F.try_variant_get("_parsed", f"$.{n}", "array<string>"))
    active = F.lower(fields["ativo"]["text"])
    record = F.struct(
        key["value"].alias("cnpj"), owner.alias("razao_social"), names("aliases").alias("aliases"), names("nomes_fantasia").alias("nomes_fantasia"),
        F.coalesce(active.isin(*TRUE_WORDS), F.lit(True)).alias("ativo"), strip_ws(fields["origem_import"]["text"]).alias("origem_import"),
        F.coalesce(fields["created_at"]["text"].try_cast("timestamp"), F.timestamp_seconds(fields["created_at"]["text"].try_cast("long"))).alias("created_at"),
    )
    judged = rows.withColumn("reason", F.when(F.col("_keys").isNull(), NO_RECORD).otherwise(reason))
    return judged.withColumn("record", F.when(F.col("reason").isNull(), record)).drop("_parsed", "_keys")
