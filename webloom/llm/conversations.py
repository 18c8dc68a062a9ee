"""Conversation structure repair: tightest edits by a square-root checkpointed DP.

A conversation is its rows by turn (nulls first; rows of one turn by role, then
by the md5 of the text, so that equal rows are neighbours). A row that is blank
or repeats an earlier row's role and text must go; a row that ends without
``.!?`` may stay at a price. The cheapest edits are wanted that make the roles'
initials ``(s?(ua)+)?``, and of these the ones whose initials are ASCII-least.

The cost of what is still to come is a vector over the four states of that
pattern. Walking back over a conversation's codes (one byte a row) such vectors
are kept at every square-root-th row only; walking forward, the vectors of one
block at a time are computed again from the checkpoint behind it and decide the
edits of its rows. So n rows need n bytes and about 2 * sqrt(n) vectors.

One sorted shuffle brings both walks: a conversation's codes come first, its
texts after them in the same order, and stream through the digest one at a time.
No conversation is ever held as a whole. (Its digest and its edits are by their
definition made row after row, so one task reads a conversation; which rows
repeat is found before that, by shuffles on conversation, role and text.)

Defined cases: a null role or text counts as one space, so such a text is blank
and such a role is not allowed to stay; a null turn comes first and counts for
no gap; null conversation ids are one conversation. A conversation without rows
has zeros, an empty audit and the digest of the empty string. An empty table
gives no rows. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The white space of the contract.
SPACES = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1

#: Faults of a row, in the order in which the first counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Code of a conversation id that has no row: it makes the id known, nothing more.
NO_ROW = -1

#: States of (s?(ua)+)?: nothing yet, after s, after u, after a; the next state for
#: initials s, u, a and any other (None: not allowed).
_NEXT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: The one role that may be inserted, or given to a row, in each state, and where it leads.
_GIVEN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _behind(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from the costs behind it."""
    initial, fault = divmod(code, 4)
    out = []
    for state in range(4):
        least = DELETE + after[state]
        if fault in (SOUND, TRUNCATED):
            tail = UNFINISHED if fault == TRUNCATED else 0
            least = min(least, REROLE + tail + after[_GIVEN[state][0]])
            if _NEXT[state][initial] is not None:
                least = min(least, KEEP + tail + after[_NEXT[state][initial]])
        out.append(least)
    return _inserted(out)


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs when roles may be inserted first: a before u, u before the others."""
    u = min(costs[2], INSERT + costs[3])
    return min(costs[0], INSERT + u), min(costs[1], INSERT + u), u, min(costs[3], INSERT + costs[2])


_END = _inserted([0, 99, 99, 0])


class Edits:
    """The ASCII-least tightest edits of one conversation's row codes."""

    def __init__(self, codes: bytes | bytearray):
        self.codes = codes
        self.n = len(codes)
        self.step = isqrt(self.n) + 1
        self.checkpoints = {self.n: _END}
        costs = _END
        for i in range(self.n - 1, -1, -1):
            costs = _behind(codes[i], costs)
            if i % self.step == 0:
                self.checkpoints[i] = costs
        self.cost = costs[0]

    def _block(self, first: int) -> list[tuple[int, ...]]:
        """Vectors of rows first to the next checkpoint, which ends the list."""
        last = min(first + self.step, self.n)
        vectors = [self.checkpoints[last]]
        for i in range(last - 1, first - 1, -1):
            vectors.append(_behind(self.codes[i], vectors[-1]))
        return vectors[::-1]

    def __iter__(self) -> Iterator[tuple[str, str | None]]:
        """(edit, role it gives): D and K take a row, R takes a row, I takes none."""
        state, i, first, vectors = 0, 0, 0, self._block(0)
        while i < self.n or vectors[i - first][state]:
            if i - first == self.step and i < self.n:
                first, vectors = i, self._block(i)
            now = vectors[i - first]
            given, role = _GIVEN[state]
            if i < self.n:
                after = vectors[i - first + 1]
                initial, fault = divmod(self.codes[i], 4)
                if now[state] == DELETE + after[state]:
                    i += 1
                    yield "D", None
                    continue
            if now[state] == INSERT + now[given]:
                state = given
                yield "I", role
                continue
            tail = UNFINISHED if fault == TRUNCATED else 0
            kept = _NEXT[state][initial]
            if kept is not None and fault in (SOUND, TRUNCATED) and now[state] == KEEP + tail + after[kept]:
                state = kept
                yield "K", None
            else:
                state = given
                yield "R", role
            i += 1


class _Conversation:
    """What the stream has seen of one conversation."""

    def __init__(self, conv):
        self.conv, self.codes = conv, bytearray()
        self.faults = [0, 0, 0, 0]
        self.illegal, self.previous = 0, None
        self.low = self.high = None
        self.turns = 0
        self.edits = None

    def add(self, code: int, turn: int | None) -> None:
        if code == NO_ROW:
            return
        self.codes.append(code)
        initial, fault = divmod(code, 4)
        self.faults[fault] += 1
        self.illegal += self.previous is not None and (self.previous, initial) not in _LEGAL
        self.previous = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def begin(self) -> None:
        """All codes are known: the walk forward may begin."""
        if self.edits is None:
            self.edits = Edits(self.codes)
            self.walk, self.audit, self.digest, self.lines = iter(self.edits), [], hashlib.sha256(), 0

    def line(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update(("\n" * (self.lines > 0) + role + ":").encode())
        self.digest.update(text.encode())
        self.lines += 1
        return role, text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired rows (edit, role, text) up to the one that this row becomes."""
        self.begin()
        for edit, given in self.walk:
            self.audit.append(edit)
            if edit == "I":
                yield edit, *self.line(given, "")
                continue
            if edit != "D":
                yield edit, *self.line(given or role, text)
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        self.begin()
        for edit, given in self.walk:
            self.audit.append(edit)
            yield edit, *self.line(given, "")

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
                self.edits.cost, "".join(self.audit), self.digest.hexdigest())


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_FLUSH_ROWS, _FLUSH_BYTES = 4_096, 4 << 20


def _stream(rows_wanted: bool):
    """Rows of a partition, sorted by conversation, walk and order, to one report for
    each conversation, or to its repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size, place = None, [], 0, 0
        conv_type = None

        def flush():
            nonlocal out, size
            columns = list(zip(*out))
            if rows_wanted:
                kinds, names = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()], ["conv", "place", "edit", "role", "text"]
            else:
                kinds, names = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()], ["conv", *_REPORT, "audit", "repaired_sha256"]
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        def emit(lines):
            nonlocal size, place
            for edit, role, text in lines:
                if rows_wanted:
                    out.append((now.conv, place, edit, role, text))
                    size += len(text)
                place += 1

        def close():
            nonlocal size, place
            emit(now.rest())
            place = 0
            if not rows_wanted:
                out.append(now.report())
                size += len(out[-1][7])

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, code, turn, role, text in zip(*(batch.column(c) for c in range(5))):
                conv = conv.as_py()
                if now is None or now.conv != conv:
                    if now is not None:
                        close()
                    now = _Conversation(conv)
                if code.is_valid:
                    now.add(code.as_py(), turn.as_py())
                else:
                    emit(now.row(role.as_py(), text.as_py()))
                if len(out) >= _FLUSH_ROWS or size >= _FLUSH_BYTES:
                    yield flush()
        if now is not None:
            close()
        if out:
            yield flush()

    return run


def _walks(rows: DataFrame) -> DataFrame:
    """conv, code, turn, role, text sorted in each partition for the two walks: codes
    of a conversation first, then its texts. `rows`: conv, here, turn, role, text;
    where `here` is false only the conversation's id counts."""
    own = F.concat("role", F.lit(":"), F.md5("text"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    light = rows.filter("here").select("conv", "turn", own.alias("own"), initial.alias("initial"), end.alias("end"))
    place = F.row_number().over(Window.partitionBy("conv", "own").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("end") == "", BLANK).when(F.col("place") > 1, DUPLICATE).when(~F.col("end").isin(*ENDS), TRUNCATED).otherwise(SOUND)
    none = F.lit(None).cast("string")
    codes = light.withColumn("place", place).select(
        "conv", F.lit(0).alias("walk"), "turn", "own", F.col("place").cast("long").alias("nth"), (F.col("initial") * 4 + fault).cast("int").alias("code"), none.alias("role"), none.alias("text"))
    ids = rows.select("conv").distinct().select(
        "conv", F.lit(0).alias("walk"), F.lit(None).cast("long").alias("turn"), none.alias("own"), F.lit(0).cast("long").alias("nth"), F.lit(NO_ROW).alias("code"), none.alias("role"), none.alias("text"))
    texts = rows.filter("here").select(
        "conv", F.lit(1).alias("walk"), "turn", own.alias("own"), F.lit(0).cast("long").alias("nth"), F.lit(None).cast("int").alias("code"), "role", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = codes.unionByName(ids).unionByName(texts).repartition(parts, "conv")
    order = ["conv", "walk", F.asc_nulls_first("turn"), "own", "nth"]
    return both.sortWithinPartitions(*order).select("conv", "code", "turn", "role", "text")


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.lit(True).alias("here"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def _reported(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    return _walks(rows).mapInArrow(_stream(False), f"conv {kind}, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string")


def audit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    return _reported(_rows(rows, conv, turn, role, text)).withColumnRenamed("conv", conv)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows: conversation id, place (from 0), edit (K, R or I), role, text.
    A conversation of which nothing stays has none."""
    found = _rows(rows, conv, turn, role, text)
    kind = found.schema["conv"].dataType.simpleString()
    out = _walks(found).mapInArrow(_stream(True), f"conv {kind}, place long, edit string, role string, text string")
    return out.withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """conv, here, turn, role, text after the query's damage: by the remainder of
    crc32(conv_id:turn) by 20 a row goes (0; `here` is false), loses its text (1) or
    its ``.!?`` (2), comes twice (3), or gets the role user (4)."""
    whole = _rows(rows, "conv_id", "turn", "role", "text")
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hurt = F.crc32(name.cast("binary")) % 20
    text = F.when(hurt == 1, "").when(hurt == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = whole.select("conv", (hurt != 0).alias("here"), "turn", F.when(hurt == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                        F.explode(F.array_repeat(F.lit(0), F.when(hurt == 3, 2).otherwise(1))).alias("_copy"))
    return once.drop("_copy")


def report(rows: DataFrame) -> DataFrame:
    """The audit of the damaged conversations: conv_id and the columns of ``audit``."""
    return _reported(damaged(rows)).withColumnRenamed("conv", "conv_id")


_POLYNOMIAL = 0xEDB88320
_CRC = "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])), lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, " + str(_POLYNOMIAL) + ") ELSE c >> 1 END)"
_CRC = f"xor({_CRC}, 4294967295)"


def _sql() -> str:
    """The same by a recursive query over rows from last to first, for DuckDB: the
    least (cost, edits) from each state, with the repaired lines behind them."""
    one = lambda cost, edit, line, rest: f"{{'c': {cost} + {rest}.c, 'e': '{edit}' || {rest}.e, 'l': list_concat({line}, {rest}.l)}}"
    insert = lambda state, rest: one(INSERT, "I", f"['{_GIVEN[state][1]}:']", rest)

    def moves(state: int) -> str:
        given, role = _GIVEN[state]
        out = [one(DELETE, "D", "[]::VARCHAR[]", f"s{state}")]
        stays = "CASE WHEN fault IN (0, 3) THEN {} ELSE NULL END"
        tail = f"CASE WHEN fault = 3 THEN {UNFINISHED} ELSE 0 END"
        out.append(stays.format(one(f"{REROLE} + {tail}", "R", f"['{role}:' || text]", f"s{given}")))
        for initial, to in zip("sua", _NEXT[state]):
            if to is not None:
                out.append(f"CASE WHEN fault IN (0, 3) AND role[1] = '{initial}' THEN {one(tail, 'K', '[role || chr(58) || text]', f's{to}')} ELSE NULL END")
        return f"list_min([{', '.join(out)}])"

    end = "{'c': 0::BIGINT, 'e': '', 'l': []::VARCHAR[]}"
    a_end = "{'c': " + str(INSERT) + "::BIGINT, 'e': 'I', 'l': ['assistant:']}"
    ua_end = "{'c': " + str(2 * INSERT) + "::BIGINT, 'e': 'II', 'l': ['user:', 'assistant:']}"
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, {_CRC.format("name")} % 20 AS h FROM o),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE h <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || md5(text), copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS tail FROM d),
f AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN nth > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM p),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND coalesce(before[1], '') || coalesce(role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n FROM f GROUP BY conv_id),
w AS (SELECT conv_id, n AS i, {end} AS s0, {ua_end} AS s1, {a_end} AS s2, {end} AS s3 FROM m
  UNION ALL
  SELECT conv_id, i - 1, list_min([r0, {insert(0, "i2")}]), list_min([r1, {insert(1, "i2")}]), i2, list_min([r3, {insert(3, "r2")}]) FROM (
    SELECT *, list_min([r2, {insert(2, "r3")}]) AS i2 FROM (
      SELECT w.conv_id, w.i, {moves(0)} AS r0, {moves(1)} AS r1, {moves(2)} AS r2, {moves(3)} AS r3
      FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.i))),
r AS (SELECT conv_id, s0 FROM w WHERE i = 0)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.e, '') AS audit,
  sha256(coalesce(array_to_string(s0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id
"""


SQL = _sql()
