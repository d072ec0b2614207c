"""Delimited portfolio files as numbered rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaselake.operators.skew import lookup_join
from leaselake.session import stored
from leaselake.sources.documents import file_name

# Delimiters in order of preference, size of the sniffed sample.
DELIMITERS = (",", ";", "\t")
SAMPLE_CHARS = 4096
#: Longest quoted cell, the limit of common readers; a quote left open longer than that is no cell.
MAX_CELL_CHARS = 131_072


def numbered_lines(raw: DataFrame) -> DataFrame:
    """0-based line number per file, without bringing a file into one task.

    ``raw`` has source, block, line_id and value. Lines are counted per block, the
    counts are added up over the blocks of a file, and lines are only ordered
    inside their block, which has a bounded size.
    """
    counts = raw.groupBy("source", "block").agg(F.count("*").alias("lines"))
    offsets = counts.select(
        "source",
        "block",
        F.coalesce(
            F.sum("lines").over(
                W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("offset"),
    )
    inside = raw.withColumn(
        "_n", F.row_number().over(W.partitionBy("source", "block").orderBy("line_id"))
    )
    return inside.join(offsets, ["source", "block"]).select(
        "source", "block", (F.col("offset") + F.col("_n") - 1).alias("row"), "value"
    )


def sniff_delimiters(lines: DataFrame) -> DataFrame:
    """Delimiter per source from its first characters: the one whose count per line
    is the most regular, comma when none occurs."""
    ordered = W.partitionBy("source").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    # A sample of 4096 characters holds at most 4096 lines.
    head = lines.where(F.col("row") < SAMPLE_CHARS).withColumn(
        "_before", F.coalesce(F.sum(F.length("value") + 1).over(ordered), F.lit(0))
    )
    sample = head.where((F.col("_before") < SAMPLE_CHARS) & (F.col("value") != ""))
    counted = sample.select(
        "source",
        F.posexplode(
            F.array(
                *[
                    F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))
                    for d in DELIMITERS
                ]
            )
        ).alias("choice", "times"),
    ).where(F.col("times") > 0)
    regular = counted.groupBy("source", "choice", "times").agg(F.count("*").alias("lines"))
    best = regular.groupBy("source").agg(
        F.max(F.struct("lines", "times", (-F.col("choice")).alias("_choice"))).alias("_best")
    )
    named = F.element_at(F.array(*[F.lit(d) for d in DELIMITERS]), (1 - F.col("_best._choice")).cast("int"))
    return best.select("source", named.alias("delimiter"))


def split_cells(line: Column, delimiter: Column) -> Column:
    """Cells of a line; quoted cells may hold the delimiter and doubled quotes."""
    plain = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1)
    outside = F.concat(
        F.lit("\\Q"), delimiter, F.lit('\\E(?=(?:[^"]*"[^"]*")*[^"]*$)')
    )
    quoted = F.transform(
        F.split(line, outside),
        lambda c: F.when(
            F.trim(c).rlike('(?s)^".*"$'),
            F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )
    return (
        F.when(line == "", F.array().cast("array<string>"))
        .when(F.contains(line, F.lit('"')), quoted)
        .otherwise(plain)
    )


def _patterns(delimiter: str) -> tuple[str, str, str, str]:
    """Patterns of the letters in quotes, the rest of a cell, the delimiter, and cells up to an opening quote."""
    d = f"\\Q{delimiter}\\E" if delimiter != "\t" else "\t"
    letters, other = '(?:[^"]++|"")*+', f"[^{delimiter}]*+"
    closed_cell, plain_cell = f'"{letters}"{other}', f'[^"{delimiter}]{other}'
    return letters, other, d, f'(?:(?:{closed_cell}|{plain_cell})?{d})*"'


def _open_after(line: Column, delimiter: str, inside: bool) -> Column:
    """True where a quoted cell is open at the end of a line that starts outside or inside one.

    A quote opens a cell only where the cell begins; a doubled quote inside is a letter.
    """
    letters, other, d, opening = _patterns(delimiter)
    outside = f"{opening}{letters}$"
    if not inside:
        return line.rlike(f"(?s)^{outside}")
    return line.rlike(f"(?s)^{letters}$") | line.rlike(f'(?s)^{letters}"{other}{d}{outside}')


def _cell_parts(delimiter: Column, value: Column, opened: Column, open_after: Column) -> tuple[Column, Column, Column]:
    """Whether a line ends the cell it starts in, and the lengths of its parts of the first and of the last open cell."""
    closes, first, last = F.lit(False), F.length(value), F.lit(0)
    for d in DELIMITERS:
        letters, other, cut, opening = _patterns(d)
        closing = ~value.rlike(f"(?s)^{letters}$")
        head = F.length(F.regexp_extract(value, f'(?s)^({letters})"', 1))
        after_one = F.regexp_extract(value, f'(?s)^{letters}"{other}{cut}{opening}({letters})$', 1)
        after_none = F.regexp_extract(value, f"(?s)^{opening}({letters})$", 1)
        same = delimiter == d
        closes = F.when(same, opened & closing).otherwise(closes)
        first = F.when(same & closing, head).otherwise(first)
        last = F.when(same, F.length(F.when(opened, after_one).otherwise(after_none))).otherwise(last)
    return closes, F.when(opened, first).otherwise(0), F.when(open_after & (~opened | closes), last).otherwise(0)


def _longest_cells(several: DataFrame) -> DataFrame:
    """Longest quoted cell over several lines of each record: source, _record, _size.

    Cells are numbered as records are, within blocks and then over the blocks of a file, so a cell's lines do not meet.
    """
    closes, first, last = _cell_parts(F.col("delimiter"), F.col("value"), F.col("_open") == 1, F.col("_open_after") == 1)
    parts = several.withColumn("_closes", closes).withColumn("_first", first).withColumn("_tail", last)
    begins = (F.col("_open_after") == 1) & ((F.col("_open") == 0) | F.col("_closes"))
    parts = parts.withColumn("_begins", begins.cast("int")).withColumn("_cell", F.sum("_begins").over(
        W.partitionBy("source", "block").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    ))
    counts = parts.groupBy("source", "block").agg(F.sum("_begins").alias("_n"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("source", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # A line break belongs to the cell that is open after it.
    cell = F.col("_offset") + F.col("_cell")
    pieces = parts.join(offsets, ["source", "block"]).select("source", "_record", F.explode(F.array(
        F.struct((cell - F.col("_begins")).alias("cell"), (F.col("_first") + ((F.col("_open_after") == 1) & (F.col("_begins") == 0)).cast("int")).alias("n")),
        F.struct(cell.alias("cell"), (F.col("_tail") + F.col("_begins")).alias("n")),
    )).alias("_p"))
    sizes = pieces.groupBy("source", "_record", "_p.cell").agg(F.sum("_p.n").alias("_n"))
    return sizes.groupBy("source", "_record").agg(F.max("_n").alias("_size"))


def join_quoted(lines: DataFrame, give_back: bool = False) -> DataFrame:
    """Lines of one quoted cell as one row: source, row and value, rows numbered anew.

    ``lines`` has source, block, row, value and delimiter. What a line does to the
    open-or-not state of a cell is known without its neighbours: it leaves it, turns
    it over, or sets it. So states are added up within blocks and then over the
    blocks of a file, as line numbers are, and no file meets in one task. The lines of a row
    with a cell longer than MAX_CELL_CHARS are not gathered: it is empty, or with ``give_back`` each
    of its lines is a row of its own, and a column ``error`` says so. The rows behind them move on by
    sums of the same kind.
    """
    opened, kept = F.lit(False), F.lit(True)
    for d in DELIMITERS:
        same = F.col("delimiter") == d
        opened = F.when(same, _open_after(F.col("value"), d, False)).otherwise(opened)
        kept = F.when(same, _open_after(F.col("value"), d, True)).otherwise(kept)
    quoted = F.contains("value", F.lit('"'))
    at = W.partitionBy("source", "block").orderBy("row")
    upto, before = at.rowsBetween(W.unboundedPreceding, W.currentRow), at.rowsBetween(W.unboundedPreceding, -1)
    marked = lines.withColumn("_a", quoted & opened).withColumn("_b", ~quoted | kept)
    turns = (F.col("_a") & ~F.col("_b")).cast("int")
    marked = marked.withColumn("_turns", F.sum(turns).over(upto)).withColumn(
        "_set", F.when(F.col("_a") == F.col("_b"), (F.col("_a").cast("int") + F.col("_turns")) % 2)
    ).withColumn("_last", F.last("_set", ignorenulls=True).over(upto))
    whole = marked.groupBy("source", "block").agg(
        F.max("_turns").alias("_all_turns"), F.max_by("_last", "row").alias("_block_set")
    )
    blocks = W.partitionBy("source").orderBy("block")
    sofar = blocks.rowsBetween(W.unboundedPreceding, W.currentRow)
    state = (F.coalesce(F.last("_fixed", ignorenulls=True).over(sofar), F.lit(0)) + F.col("_sum")) % 2
    whole = (
        whole.withColumn("_sum", F.sum("_all_turns").over(sofar))
        .withColumn("_fixed", F.when(F.col("_block_set").isNotNull(), (F.col("_block_set") + F.col("_all_turns") + F.col("_sum")) % 2))
        .withColumn("_after", state)
        .select("source", "block", F.coalesce(F.lag("_after").over(blocks), F.lit(0)).alias("_first"))
    )
    after = (F.coalesce(F.col("_last"), F.col("_first")) + F.col("_turns")) % 2
    known = marked.join(whole, ["source", "block"]).withColumn("_open_after", after)
    known = known.withColumn("_open", F.coalesce(F.lag("_open_after").over(at), F.col("_first"))).withColumn(
        "_begun", F.sum(F.when(F.col("_open") == 0, 1).otherwise(0)).over(upto)
    )
    counts = known.groupBy("source", "block").agg(F.max("_begun").alias("_rows"))
    offsets = counts.select(
        "source", "block",
        F.coalesce(F.sum("_rows").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
    )
    rows = known.join(offsets, ["source", "block"]).select(
        "source", "block", F.greatest(F.col("_offset") + F.col("_begun") - 1, F.lit(0)).alias("_record"), "row", "value", "delimiter",
        "_open", "_open_after", ((F.col("_open") == 1) | (F.col("_open_after") == 1)).alias("_several"),
    )
    one = rows.where(~F.col("_several")).select(
        "source", "block", F.col("row").alias("_line"), F.col("_record").alias("row"), "value", "delimiter"
    )
    # Read several times from here on: written once, and so are the few cells over several lines.
    several = stored(rows.where("_several"), "open-lines")
    sizes = stored(_longest_cells(several), "cell-sizes")
    fitting = several.join(sizes.where(F.col("_size") <= MAX_CELL_CHARS), ["source", "_record"]).groupBy(
        "source", F.col("_record").alias("row")
    ).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda r: r["value"]), "\n").alias("value"),
        F.first("delimiter").alias("delimiter"),
        F.min(F.struct("block", F.col("row").alias("_line"))).alias("_at"),
    ).select("source", "_at.*", "row", "value", "delimiter")
    if not give_back:
        endless = several.join(sizes.where(F.col("_size") > MAX_CELL_CHARS), ["source", "_record"])
        empty = endless.groupBy("source", F.col("_record").alias("row")).agg(F.lit("").alias("value"), F.first("delimiter").alias("delimiter"))
        return one.unionByName(fitting).drop("block", "_line").unionByName(empty)
    # Every line of a record that is given back after its first moves all that follows by one row.
    given = several.join(sizes.where(F.col("_size") > MAX_CELL_CHARS), ["source", "_record"]).select(
        "source", "block", F.col("row").alias("_line"), F.col("_record").alias("row"), "value", "delimiter", F.col("_open").alias("_later"),
        F.lit(f"quoted cell longer than {MAX_CELL_CHARS} characters: line given back as a row").alias("error"),
    )
    kept_rows = one.unionByName(fitting).withColumn("_later", F.lit(0)).withColumn("error", F.lit(None).cast("string"))
    later = given.groupBy("source", "block").agg(F.sum("_later").alias("_moved"))
    moves = counts.join(later, ["source", "block"], "left").select(
        "source", "block",
        F.coalesce(F.sum("_moved").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_moves"),
    )
    lines_of_block = W.partitionBy("source", "block").orderBy("_line").rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = kept_rows.unionByName(given).withColumn("_here", F.sum("_later").over(lines_of_block))
    return moved.join(moves, ["source", "block"]).select(
        "source", (F.col("row") + F.col("_moves") + F.col("_here")).alias("row"), "value", "delimiter", "error"
    )


def rows_from_lines(lines: DataFrame) -> DataFrame:
    """source, row, cells from numbered lines (source, row, value), with block also quoted line breaks and ``error``."""
    cut = lookup_join(lines, sniff_delimiters(lines), ["source"], ["row"])
    cut = cut.withColumn("delimiter", F.coalesce(F.col("delimiter"), F.lit(DELIMITERS[0])))
    if "block" in lines.columns:
        cut = join_quoted(cut, give_back=True)
    errors = ["error"] if "error" in cut.columns else []
    return cut.select("source", "row", split_cells(F.col("value"), F.col("delimiter")).alias("cells"), *errors)


def read_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of every delimited file under ``path``: source (full path), row, cells, error, file_name.

    A byte-order mark is dropped. A file with any line that is not UTF-8 is read as
    ISO-8859-1 as a whole. Files of the same name in several folders stay apart, and
    quoted cells may hold line breaks. Where a quote stays open past MAX_CELL_CHARS, each line is a row with an error.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )
    utf8 = raw.groupBy("source").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    lines = lookup_join(numbered_lines(raw), utf8, ["source"], ["row"]).select(
        "source",
        "block",
        "row",
        F.when(F.col("utf8"), F.col("value"))
        .otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
        .alias("value"),
    )
    mark = F.when(F.col("row") == 0, F.ltrim(F.col("value"), F.lit("\ufeff")))
    # Sniffed, joined and cut from here on: written once.
    lines = stored(lines.withColumn("value", F.coalesce(mark, "value")), "lines")
    return rows_from_lines(lines).withColumn("file_name", file_name(F.col("source")))


def cells_long(rows: DataFrame) -> DataFrame:
    """One row per cell; cells a short row lacks are simply absent."""
    return rows.select("source", "row", F.posexplode("cells").alias("col", "value"))
