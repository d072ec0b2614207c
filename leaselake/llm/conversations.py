"""Repair of conversation structure by a grammar-compressed dynamic programme.

A conversation is a string of symbols, one for each row: the role and the fault. Strings are brought down to the
distinct ones and compressed by Re-Pair: the pair of neighbours that is most frequent becomes a rule, until none
is left that occurs twice. Each symbol has a min-plus matrix over the states of the wanted role order, with
the cheapest edits from one state to another: their cost and their audit as a rope. A rule's matrix is the
product of those of its two sides, so it is worked out once, bottom-up, for all places where the rule occurs.

States of the order ``(s?(ua)+)?``: nothing yet, system said, user said, assistant said.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaselake.llm.common import fresh
from leaselake.session import stored

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: State after a system, user or assistant row, by state; the state in which a repair may end.
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ENDS = (START, ASSISTANT)
#: Row that may be inserted, or the role a row may take, by state.
WANTED = ("u", "u", "a", "u")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Symbols of rows: D for one that must go, else its role initial, x for any other; in upper case if truncated.
SYMBOLS = "DsuaxSUAX"
#: Strings compressed with one grammar, by number and by symbols.
STRINGS, LENGTH = 4096, 1 << 18

Rope = str | tuple["Rope", "Rope"]
Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]


def flat(rope: Rope) -> str:
    """The text of a rope, left to right, without recursion."""
    out, waiting = [], [rope]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            waiting += (part[1], part[0])
    return "".join(out)


def joined(a: Rope, b: Rope) -> Rope:
    """One rope after another; short ones become text."""
    if a == "" or b == "":
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 32:
        return a + b
    return (a, b)


def better(a: Entry, b: Entry) -> Entry:
    """The cheaper entry, of equal ones that with the ASCII-least audit.

    Audits of equal cost between the same states over the same rows are never one the start of another, as
    what follows could only be insertions; so what is least stays least with anything before or behind it.
    """
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or flat(a[1]) <= flat(b[1]) else b


def times(a: Matrix, b: Matrix) -> Matrix:
    rows = []
    for i in range(STATES):
        row: list[Entry] = [None] * STATES
        for k, left in enumerate(a[i]):
            if left is None:
                continue
            for j, right in enumerate(b[k]):
                # Nothing is joined for an entry that is dearer than the best so far.
                if right is None or row[j] is not None and left[0] + right[0] > row[j][0]:
                    continue
                row[j] = better((left[0] + right[0], joined(left[1], right[1])), row[j])
        rows.append(tuple(row))
    return tuple(rows)


def _inserted() -> Matrix:
    """Up to two inserted rows; more would only come back to a state."""
    one = [[None] * STATES for _ in range(STATES)]
    none = tuple(tuple((0, "") if i == j else None for j in range(STATES)) for i in range(STATES))
    for state, role in enumerate(WANTED):
        one[state][state] = (0, "")
        one[state][AFTER[role][state]] = (INSERT, "I")
    one = tuple(tuple(r) for r in one)
    return times(times(none, one), one)


INSERTED = _inserted()


def row_matrix(symbol: str) -> Matrix:
    """Insertions, then one row kept, given another role or deleted."""
    role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    rows = []
    for state in range(STATES):
        row: list[Entry] = [None] * STATES
        row[state] = (DELETE, "D")
        if symbol != "D":
            kept = AFTER[role][state] if role in AFTER else None
            if kept is not None:
                row[kept] = better(row[kept], (KEEP + more, "K"))
            turned = AFTER[WANTED[state]][state]
            row[turned] = better(row[turned], (REROLE + more, "R"))
        rows.append(tuple(row))
    return times(INSERTED, tuple(rows))


ROWS = {s: row_matrix(s) for s in SYMBOLS}


def re_pair(strings: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (pairs of symbols; rule i is symbol 256 + i) and the strings written with them.

    Strings lie one behind the other in a doubly linked list with borders between them. The places of each pair are
    kept, so a replacement touches its neighbours only; the most frequent pair comes from a heap whose stale counts
    are put right when they come up.
    """
    symbols: list[int] = []
    for s in strings:
        symbols += s.encode("latin-1")
        symbols.append(0)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        if symbols[i] and symbols[i + 1]:
            places[symbols[i], symbols[i + 1]].add(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        now = len(places.get(pair, ()))
        if now < 2:
            continue
        if -count != now:
            heapq.heappush(heap, (-now, pair))
            continue
        new, made, touched = 256 + len(rules), 0, set()
        for i in sorted(places.pop(pair)):
            j = after[i]
            # In a run of equal symbols a place may have gone with the one before it.
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue
            left, right = before[i], after[j]
            if left >= 0 and symbols[left]:
                places[symbols[left], pair[0]].discard(left)
                places[symbols[left], new].add(left)
                touched.add((symbols[left], new))
            if right < n and symbols[right]:
                places[pair[1], symbols[right]].discard(j)
                places[new, symbols[right]].add(i)
                touched.add((new, symbols[right]))
            symbols[i], symbols[j] = new, -1
            after[i] = right
            if right < n:
                before[right] = i
            made += 1
        rules.append(pair)
        for p in touched:
            if len(places[p]) > 1:
                heapq.heappush(heap, (-len(places[p]), p))
    out, held, i = [], [], 0
    while i < n:
        if symbols[i]:
            held.append(symbols[i])
        else:
            out.append(held)
            held = []
        i = after[i]
    return rules, out


def cheapest(strings: list[str]) -> list[tuple[int, str]]:
    """Cost and audit of the cheapest repair of each string of symbols."""
    rules, written = re_pair(strings)
    matrices: dict[int, Matrix] = {ord(s): m for s, m in ROWS.items()}
    for i, (a, b) in enumerate(rules):
        matrices[256 + i] = times(matrices[a], matrices[b])
    out = []
    for symbols in written:
        state: tuple[Entry, ...] = ((0, ""), None, None, None)
        for s in [*symbols, None]:
            matrix = INSERTED if s is None else matrices[s]
            state = times((state, *[(None,) * STATES] * (STATES - 1)), matrix)[0]
        best: Entry = None
        for end in ENDS:
            best = better(best, state[end])
        out.append((best[0], flat(best[1])))
    return out


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(strings: list[str]) -> pa.RecordBatch:
        costs, audits = zip(*cheapest(strings))
        return pa.RecordBatch.from_arrays([pa.array(strings), pa.array(costs, pa.int64()), pa.array(audits)], ["symbols", "cost", "audit"])

    for batch in batches:
        held, size = [], 0
        for s in batch.column("symbols").to_pylist():
            if held and (len(held) == STRINGS or size + len(s) > LENGTH):
                yield done(held)
                held, size = [], 0
            held.append(s)
            size += len(s)
        if held:
            yield done(held)


_LEGAL = {"su", "ua", "au"}


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, whose rows follow each other in order."""
    names = ["conv", "known", "gaps", "blank", "duplicate", "truncated", "illegal", "symbols"]

    def done(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    at, parts, counts, initial = None, [], {}, ""
    least = most = last = None
    turns = illegal = 0

    def row() -> tuple:
        gaps = 0 if least is None else most - least + 1 - turns
        return (*at, gaps, counts.get("b", 0), counts.get("d", 0), counts.get("t", 0), illegal, "".join(parts))

    for batch in batches:
        found = []
        for conv, known, turn, symbol, fault, own in zip(*(batch.column(c).to_pylist() for c in ("conv", "known", "turn", "symbol", "fault", "initial"))):
            if at != (conv, known):
                if at is not None:
                    found.append(row())
                at, parts, counts = (conv, known), [], {}
                least = most = last = None
                turns = illegal = 0
            elif initial + own not in _LEGAL:
                illegal += 1
            initial = own
            if turn is not None:
                least = turn if least is None else least
                most = turn
                turns += turn != last
                last = turn
            counts[fault] = counts.get(fault, 0) + 1
            parts.append(symbol)
        if found:
            yield done(found)
    if at is not None:
        yield done([row()])


_BLANKS = r"' \t\n' || char(11) || char(12) || '\r'"


def judged(rows: DataFrame) -> DataFrame:
    """Add ``fault`` (b, d, t or empty), ``initial`` and ``symbol`` to rows (conv, known, turn, role, text).

    Rows of a conversation are ordered by turn (nulls first), role, text; ``seen`` counts the rows of equal role
    and text up to a row.
    """
    same = W.partitionBy("known", "conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.right(F.rtrim(F.col("text"), F.expr(_BLANKS)), F.lit(1))
    fault = (
        F.when(end == "", "b").when(F.col("seen") > 1, "d").when(~end.isin(".", "!", "?"), "t").otherwise("")
    )
    initial = F.left(F.col("role"), F.lit(1))
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return (
        rows.withColumn("seen", F.row_number().over(same)).withColumn("fault", fault).withColumn("initial", initial)
        .withColumn("symbol", F.when(F.col("fault").isin("b", "d"), "D").when(F.col("fault") == "t", F.upper(plain)).otherwise(plain))
    )


#: Spark sorts nulls first.
_ORDER = ["known", "conv", "turn", "role", "text", "seen"]


def edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged rows and, for each conversation, its counts, ``cost`` and ``audit``.

    A conversation's rows stream through one task in order, as its digest needs them in any case; what is
    held of it are a byte for each row's symbol and one for its edit.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "known", "conv")
    faulty = stored(judged(dealt), "judged-rows")
    symbols = stored(
        faulty.select("known", "conv", "turn", "role", "text", "seen", "symbol", "fault", "initial")
        .repartition(tasks, "known", "conv").sortWithinPartitions(*_ORDER)
        .select("conv", "known", "turn", "symbol", "fault", "initial").mapInArrow(
            _symbols, "conv long, known boolean, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string"
        ),
        "symbols",
    )
    audits = symbols.select("symbols").distinct().mapInArrow(_audits, "symbols string, cost long, audit string")
    return faulty, stored(symbols.join(audits, "symbols"), "audits")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after repair, in order: each conversation's audit comes first, then its rows."""
    names = ["conv", "known", "place", "edit", "role", "text"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]
    audit, at, state, place = "", 0, START, 0
    conv = known = None
    for batch in batches:
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                role = WANTED[state]
                out.append((conv, known, place, "I", "user" if role == "u" else "assistant", ""))
                state, at, place = AFTER[role][state], at + 1, place + 1

        for *who, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "known", "audit", "role", "text"))):
            if head is not None:
                # What was inserted behind the last row of the conversation before.
                conv, known, audit, at, state, place = *who, head, 0, START, 0
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "R":
                    role = "user" if WANTED[state] == "u" else "assistant"
                out.append((conv, known, place, edit, role, text))
                state, place = AFTER[role[:1]][state], place + 1
            insert()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def repaired_rows(faulty: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows after repair (conv, known, place from 0, edit, role, text), conversations one behind the other in a task."""
    tasks = int(faulty.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = audits.select("known", "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "audit",
                          F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("seen"))
    rows = faulty.select("known", "conv", F.lit(1).alias("kind"), "turn", F.lit(None).cast("string").alias("audit"), "role", "text", "seen")
    return (
        heads.unionByName(rows).repartition(tasks, "known", "conv")
        .sortWithinPartitions("known", "conv", "kind", *_ORDER[2:])
        .select("conv", "known", "audit", "role", "text")
        .mapInArrow(_repaired, "conv long, known boolean, place long, edit string, role string, text string")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` of each conversation's rows, joined by line feeds, one row at a time."""
    at, digest = None, None

    def done(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["conv", "known", "repaired_sha256"])

    for batch in batches:
        found = []
        for conv, known, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "known", "role", "text"))):
            if at != (conv, known):
                if at is not None:
                    found.append((*at, digest.hexdigest()))
                at, digest = (conv, known), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if found:
            yield done(found)
    if at is not None:
        yield done([(*at, digest.hexdigest())])


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows under own names; a null conversation is one of its own, null roles and texts are one space."""
    return conversations.select(
        F.coalesce(F.col(conv).cast("long"), F.lit(0)).alias("conv"), F.col(conv).isNotNull().alias("known"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, known, turn, role, text) with faults put in by crc32 of ``conv:turn`` modulo 20."""
    name = F.concat(
        F.when(F.col("known"), F.col("conv").cast("string")).otherwise(" "), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    code, copies = fresh(rows, "code", "copies")
    text = (
        F.when(F.col(code) == 1, "").when(F.col(code) == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    return (
        rows.withColumn(code, F.crc32(name.cast("binary")) % 20).where(F.col(code) != 0)
        .withColumns({"text": text, "role": F.when(F.col(code) == 4, "user").otherwise(F.col("role"))})
        .withColumn(copies, F.explode(F.when(F.col(code) == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select(*rows.columns)
    )


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows of all conversations: conv, ``place`` (from 0), ``edit`` (K, R or I), role and text.

    Rows are taken by turn (nulls first), then role and text. Blank rows and rows whose role and text came
    before go; the roles left follow ``(s?(ua)+)?`` at the least cost, ties by the ASCII-least list of edits.
    A null conversation is one of its own, null roles and texts count as one space; rows repeated in full are
    duplicates. A conversation whose rows all go has no row. Other columns are ignored.
    """
    faulty, audits = edits(_rows(conversations, conv, turn, role, text))
    out = repaired_rows(faulty, audits)
    return out.select(F.when(F.col("known"), F.col("conv")).alias(conv), "place", "edit", F.col("role").alias(role), F.col("text").alias(text))


def report(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation after ``damaged``: counts of faults, cost, audit, digest of the repaired rows.

    gaps counts the turns missing between the least and the largest; illegal the neighbours whose role initials are
    not su, ua or au. Conversations that lost all rows have zeros, an empty audit and the digest of nothing.
    """
    rows = _rows(conversations, conv, turn, role, text)
    faulty, audits = edits(damaged(rows))
    digests = repaired_rows(faulty, audits).mapInArrow(_digests, "conv long, known boolean, repaired_sha256 string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    keys = ["conv", "known"]
    joined_rows = rows.select(*keys).distinct().join(audits, keys, "left").join(digests, keys, "left")
    return joined_rows.select(
        F.when(F.col("known"), F.col("conv")).alias(conv), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
