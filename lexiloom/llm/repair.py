"""Repair of conversation structure by a least-weight path with scalar weights.

Edits turn the roles of a conversation into ``(s?(ua)+)?``. Rows are layers of a graph whose
four nodes tell what the repaired conversation ends with so far. The weight of an edge is one
integer: its cost in the high digits and, below, the row's audit letters in a field of fixed
width at the row's place. So sums of weights compare by cost first and then by the audit, and
the ordinary minimum of integers decides everything.

A field holds the letters of the insertions before a row and of the row's own edit, padded
with zeros at its end. Insertions precede the one letter that ends a field, so no field begins
another one and comparing fields is comparing audits. More than two insertions in one place
lead nowhere that fewer do not.

Conversations are cut into segments of consecutive rows, wherever they lie. A segment's matrix
holds, for every pair of nodes it may be entered and left by, the least cost and the rank of
its fields among those of the segment: ranks compare as the fields do. Matrices are again
layers with edges of a cost and a digit, so runs of segments are combined in the same way, and
no task needs a whole conversation, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from lexiloom.llm.tables import query, sql_crc32, table
from lexiloom.operators.ordering import row_numbers, sliced
from lexiloom.session import cut_lineage

#: Rows of a segment, and segments of a run that is combined at once.
SEGMENT = 256
#: What a repaired conversation ends with so far: nothing, a system, a user or an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NODES = range(4)
ACCEPTED = (START, ASSISTANT)
#: Edit costs.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: Digits of the audit letters, in their order as text; zero pads.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER_BITS, FIELD_LETTERS = 3, 3
FIELD_BITS = LETTER_BITS * FIELD_LETTERS
#: A rank among the 16 entries of a matrix.
RANK_BITS = 4
#: Traces write insertions as u and a, new roles as U and A.
AUDIT_OF_TRACE = str.maketrans("uaUA", "IIRR")
WORD = r"[^\x20\x09-\x0D]"
LEGAL_PAIRS = ("su", "ua", "au")

_MATRIX = ArrayType(LongType())
_END = StructType().add("cost", LongType()).add("node", IntegerType()).add("closing", StringType())
_STEPS = ArrayType(StructType().add("entry", IntegerType()).add("leave", IntegerType()))

Edge = tuple[int, int, int, int]


def after(node: int, initial: str) -> int | None:
    """The node after a turn with this role's initial, where the pattern allows it."""
    if initial == "s":
        return SYSTEM if node == START else None
    if initial == "u":
        return None if node == USER else USER
    return ASSISTANT if initial == "a" and node == USER else None


def field_of(letters: str) -> int:
    """The letters as one number of fixed width, zeros at its end."""
    number = 0
    for i in range(FIELD_LETTERS):
        number = (number << LETTER_BITS) | (LETTERS[letters[i]] if i < len(letters) else 0)
    return number


def insertions(node: int) -> list[tuple[str, int]]:
    """Up to two inserted turns and the node they lead to."""
    made = [("", node)]
    for _ in range(2):
        trace, at = made[-1]
        role = "a" if at == USER else "u"
        made.append((trace + role, after(at, role)))
    return made


@lru_cache(maxsize=None)
def edges_of(code: str) -> dict[tuple[int, int], tuple[int, int, str]]:
    """Lightest edge between two nodes over a row: cost, field and trace.

    A row's code is its role's initial (``x``: another one), in upper case if its text is
    truncated, or ``d`` if it must be deleted.
    """
    found: dict[tuple[int, int], tuple[int, int, str]] = {}
    for node in NODES:
        for inserted, at in insertions(node):
            options = [("D", DELETE, at)]
            if code != "d":
                kept = LEFT_TRUNCATED if code.isupper() else 0
                options += [("K", kept, after(at, code.lower())), ("U", kept + REROLE, after(at, "u")), ("A", kept + REROLE, after(at, "a"))]
            for letter, cost, to in options:
                if to is None:
                    continue
                trace = inserted + letter
                edge = (cost + INSERT * len(inserted), field_of(trace.translate(AUDIT_OF_TRACE)), trace)
                if (node, to) not in found or edge < found[node, to]:
                    found[node, to] = edge
    return found


def lightest(entry: int, layers: list[list[Edge]], bits: int) -> tuple[dict[int, int], list[dict[int, tuple[int, int]]]]:
    """Least weight to every node behind the last layer, and per layer the edge it came by.

    An edge is (from, to, cost, digit); a digit has ``bits`` bits at its layer's place.
    """
    high = bits * len(layers)
    weights, came = {entry: 0}, []
    for place, edges in enumerate(layers, 1):
        low = high - bits * place
        reached: dict[int, int] = {}
        by: dict[int, tuple[int, int]] = {}
        for node, to, cost, digit in edges:
            if node in weights:
                weight = weights[node] + (cost << high) + (digit << low)
                if to not in reached or weight < reached[to]:
                    reached[to], by[to] = weight, (node, digit)
        weights = reached
        came.append(by)
    return weights, came


def _way_back(came: list[dict[int, tuple[int, int]]], leave: int) -> list[tuple[int, int]]:
    """(from, to) of every layer on the way that ends at ``leave``."""
    steps: list[tuple[int, int]] = []
    for by in reversed(came):
        steps.append((by[leave][0], leave))
        leave = by[leave][0]
    return steps[::-1]


def _matrix(layers: list[list[Edge]], bits: int) -> list[int]:
    """Cost and rank for every pair of nodes (-1: no way), as ``cost * 16 + rank``."""
    high = bits * len(layers)
    found = {(a, b): w for a in NODES for b, w in lightest(a, layers, bits)[0].items()}
    lows = sorted({w & ((1 << high) - 1) for w in found.values()})
    rank = {low: i for i, low in enumerate(lows)}
    return [
        ((found[a, b] >> high) << RANK_BITS) | rank[found[a, b] & ((1 << high) - 1)] if (a, b) in found else -1
        for a in NODES for b in NODES
    ]


def _row_layers(codes: str) -> list[list[Edge]]:
    return [[(a, b, cost, field) for (a, b), (cost, field, _) in edges_of(c).items()] for c in codes]


def _matrix_layers(children: list[list[int]]) -> list[list[Edge]]:
    return [
        [(i >> 2, i & 3, int(x) >> RANK_BITS, int(x) & 15) for i, x in enumerate(child) if x >= 0] for child in children
    ]


@lru_cache(maxsize=50_000)
def segment_matrix(codes: str) -> list[int]:
    return _matrix(_row_layers(codes), FIELD_BITS)


@lru_cache(maxsize=50_000)
def segment_trace(codes: str, entry: int, leave: int) -> str:
    """The edits of a segment's rows between two nodes."""
    steps = _way_back(lightest(entry, _row_layers(codes), FIELD_BITS)[1], leave)
    return "".join(edges_of(c)[step][2] for c, step in zip(codes, steps))


def ending(matrix: list[int]) -> tuple[int, int, str]:
    """Cost, last node and closing insertions of a whole conversation."""
    options = []
    for node in NODES:
        if matrix[node] < 0:
            continue
        for inserted, at in insertions(node):
            if at in ACCEPTED:
                weight = (int(matrix[node]) + ((INSERT * len(inserted)) << RANK_BITS)) << FIELD_BITS
                options.append((weight + field_of("I" * len(inserted)), node, inserted))
    weight, node, inserted = min(options)
    return weight >> (RANK_BITS + FIELD_BITS), node, inserted


@F.pandas_udf(_MATRIX)
def _segment_matrices(codes: pd.Series) -> pd.Series:
    return codes.map(segment_matrix)


@F.pandas_udf(_MATRIX)
def _combined(children: pd.Series) -> pd.Series:
    return children.map(lambda x: _matrix(_matrix_layers(list(x)), RANK_BITS))


@F.pandas_udf(_END)
def _endings(matrices: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ending(list(m)) for m in matrices], columns=["cost", "node", "closing"])


@F.pandas_udf(_STEPS)
def _choices(children: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
    return pd.Series([
        [{"entry": a, "leave": b} for a, b in _way_back(lightest(p, _matrix_layers(list(x)), RANK_BITS)[1], q)]
        for x, p, q in zip(children, entry, leave)
    ], dtype=object)


@F.pandas_udf(StringType())
def _traces(codes: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
    return pd.Series([segment_trace(c, p, q) for c, p, q in zip(codes, entry, leave)], dtype=object)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` after the damage drawn from a row's conversation and turn.

    ``conv`` is the conversation as text, a space for null, as all nulls are spaces.
    """
    blank = F.lit(" ")
    given = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), blank).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
    )
    drawn = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("drawn") == 3, 2).otherwise(1))
    return given.withColumn("drawn", drawn).where("drawn <> 0").select(
        "conv", "turn", F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """The rows in their order: ``slice`` grows with it, ``nth`` counts inside a slice.

    Order is by turn (nulls first), then role and text. Range slices split a conversation of
    any size; equal rows are told apart by a number, so they too are split.
    """
    marked = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    order = ["turn", "role", "head", "digest", "tie"]
    cut = sliced(marked.withColumn("tie", F.monotonically_increasing_id()), ["conv"], order).withColumnRenamed("__slice", "slice")
    inside = Window.partitionBy("slice").orderBy("conv", *order)
    return cut.withColumn("nth", F.row_number().over(inside)).drop("head", "tie")


def with_faults(rows: DataFrame) -> DataFrame:
    """Placed rows with ``fault`` (blank, duplicate, truncated or null)."""
    key = ["conv", "role", "digest"]
    first = F.struct("slice", "nth")
    repeated = rows.groupBy(*key).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank").when(first > F.col("first"), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    return rows.join(repeated, key, "left").withColumn("fault", fault).drop("first")


def illegal_pairs(rows: DataFrame) -> DataFrame:
    """``conv, illegal``: neighbours whose role initials may not follow each other."""
    this = F.struct("conv", F.substring("role", 1, 1).alias("initial"))

    def bad(earlier: Column, later: Column) -> Column:
        pair = F.concat(earlier["initial"], later["initial"])
        return (earlier["conv"] == later["conv"]) & ~pair.isin(*LEGAL_PAIRS)

    inside = Window.partitionBy("slice").orderBy("nth")
    within = rows.select("conv", F.lag(this).over(inside).alias("earlier"), this.alias("later"))
    ends = rows.groupBy("slice").agg(F.min_by(this, "nth").alias("later"), F.max_by(this, "nth").alias("last"))
    # One row per slice: their number is that of the shuffle's partitions.
    across = ends.select(F.col("later.conv").alias("conv"), F.lag("last").over(Window.orderBy("slice")).alias("earlier"), "later")
    pairs = within.union(across).where(bad(F.col("earlier"), F.col("later")))
    return pairs.groupBy("conv").agg(F.count(F.lit(1)).alias("illegal"))


def segments_of(rows: DataFrame) -> DataFrame:
    """``conv, idx, slice, base, codes``: runs of rows of one conversation, numbered from 0."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    coded = rows.select("conv", "slice", "nth", F.floor((F.col("nth") - 1) / SEGMENT).alias("part"), code.alias("code"))
    cut = coded.groupBy("conv", "slice", "part").agg(
        F.min("nth").alias("base"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "code"))), lambda x: x["code"]), "").alias("codes"),
    )
    numbered = row_numbers(cut_lineage(cut), ["conv"], ["slice", "part"], "n")
    return numbered.select("conv", (F.col("n") - 1).alias("idx"), "slice", "base", "codes")


def decided(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, idx, slice, base, trace`` of every segment, and ``conv, cost, closing``.

    Runs of segments are combined until a conversation is one; the choice then goes down the
    same way. The number of rounds follows from the longest conversation.
    """
    level = segments = cut_lineage(segments.withColumn("matrix", _segment_matrices("codes")))
    longest = segments.agg(F.max("idx")).first()[0] or 0
    rounds: list[DataFrame] = []
    while longest > 0:
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "matrix"))), lambda x: x["matrix"])
        level = level.groupBy("conv", F.floor(F.col("idx") / SEGMENT).alias("run")).agg(run.alias("children"))
        level = cut_lineage(level.select("conv", F.col("run").alias("idx"), "children", _combined("children").alias("matrix")))
        rounds.append(level)
        longest //= SEGMENT
    whole = cut_lineage(level.select("conv", _endings("matrix").alias("end")).select("conv", "end.*"))
    ways = whole.select("conv", F.lit(0).cast("long").alias("idx"), F.lit(START).alias("entry"), F.col("node").alias("leave"))
    for level in reversed(rounds):
        chosen = level.select("conv", "idx", "children").join(ways, ["conv", "idx"])
        steps = chosen.select("conv", "idx", F.posexplode(_choices("children", "entry", "leave")).alias("place", "step"))
        ways = steps.select("conv", (F.col("idx") * SEGMENT + F.col("place")).alias("idx"), "step.entry", "step.leave")
    traced = segments.join(ways, ["conv", "idx"]).select("conv", "idx", "slice", "base", _traces("codes", "entry", "leave").alias("trace"))
    return cut_lineage(traced), whole.select("conv", "cost", "closing")


def _lines(trace: Column, role: Column, text: Column) -> Column:
    """The repaired lines that a field of a trace leaves, null if none."""
    line = lambda c: (
        F.when(c == "K", F.concat(role, F.lit(":"), text)).when(c == "U", F.concat(F.lit("user:"), text))
        .when(c == "A", F.concat(F.lit("assistant:"), text)).when(c == "u", "user:").when(c == "a", "assistant:")
    )
    made = F.array_compact(F.transform(F.split(trace, ""), line))
    return F.when(F.size(made) > 0, F.array_join(made, "\n"))


def repaired_lines(rows: DataFrame, traces: DataFrame, whole: DataFrame) -> DataFrame:
    """``conv, slice, nth, lines``: the repaired text of every row that leaves one, in order."""
    fields = traces.select("slice", "base", F.posexplode(F.regexp_extract_all("trace", F.lit("([ua]*[DKUA])"), 1)).alias("place", "field"))
    fields = fields.select("slice", (F.col("base") + F.col("place")).alias("nth"), "field")
    own = rows.join(fields, ["slice", "nth"]).select("conv", "slice", "nth", _lines(F.col("field"), F.col("role"), F.col("text")).alias("lines"))
    closing = whole.where("closing <> ''").select(
        "conv", F.lit(2**31 - 1).alias("slice"), F.lit(0).alias("nth"), _lines(F.col("closing"), F.lit(""), F.lit("")).alias("lines")
    )
    return own.where("lines is not null").union(closing)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of every conversation's lines, which come in order; none is held."""
    current, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for conv, lines in zip(batch.column("conv").to_pylist(), batch.column("lines")):
            if state is None or conv != current:
                if state is not None:
                    done.append((current, state.hexdigest()))
                current, state = conv, sha256()
            else:
                state.update(b"\n")
            state.update(lines.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["conv", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], names=["conv", "digest"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults and edits of ``conv, turn, role, text`` rows: a row per conversation, and the repaired lines.

    A null turn comes first; equal turns are ordered by role and text; repeated rows are
    duplicates. An empty text is blank, and a text counts as a whole however long. Roles other
    than system, user and assistant (by their initial), the empty one too, can only be replaced or
    their rows deleted.
    """
    rows = with_faults(placed(rows))
    rows = cut_lineage(rows)
    counts = rows.groupBy("conv").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        *[F.sum(F.when(F.col("fault") == name, 1).otherwise(0)).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    turns = rows.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    traces, whole = decided(segments_of(rows))
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "trace"))), lambda x: x["trace"]), "")
    audits = traces.groupBy("conv").agg(trace.alias("trace")).join(whole, "conv").select(
        "conv", "cost", F.translate(F.concat("trace", "closing"), "uaUA", "IIRR").alias("audit")
    )
    found = (
        counts.join(turns, "conv", "left").join(illegal_pairs(rows), "conv", "left").join(audits, "conv")
        .withColumn("gaps", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)))
        .select("conv", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"), "cost", "audit")
    )
    return found, repaired_lines(rows, traces, whole)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row for every conversation of damaged ``rows``, in the columns of the registered query.

    A null ``conv_id`` is a conversation. One without rows after the damage has zeros, no audit
    and the hash of the empty text; an empty table gives no rows; further columns are not read.
    The digest of a conversation is one hash over all its lines, so they stream through one
    task in order, none of them held there.
    """
    found, lines = repair(damaged(rows))
    digests = lines.repartition("conv").sortWithinPartitions("conv", "slice", "nth").select("conv", "lines")
    digests = digests.mapInArrow(_digests, "conv string, digest string")
    original = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return original.join(found, "conv", "left").join(digests, "conv", "left").select(
        F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


#: The same path row by row: one least (cost, audit) for each node, insertions and role changes as tables.
_ORACLE = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), drawn AS (
  SELECT *, {sql_crc32("(conv || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS d FROM given
), hurt AS (
  SELECT conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE d <> 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM hurt
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM ranked
), inserts(node, letters, gone) AS (
  VALUES (0, '', 0), (0, 'u', 2), (0, 'ua', 3), (1, '', 1), (1, 'u', 2), (1, 'ua', 3),
    (2, '', 2), (2, 'a', 3), (2, 'au', 2), (3, '', 3), (3, 'u', 2), (3, 'ua', 3)
), turns(node, initial, goes) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), options AS (
  SELECT f.conv, f.n, t.node, t.goes, 'K' AS letter, CASE WHEN fault IS NULL THEN 0 ELSE {LEFT_TRUNCATED} END AS price, [role || ':' || text] AS line
  FROM faulty f JOIN turns t ON t.initial = left(role, 1) WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL
  SELECT f.conv, f.n, t.node, t.goes, 'R', {REROLE} + CASE WHEN fault IS NULL THEN 0 ELSE {LEFT_TRUNCATED} END,
    [CASE t.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM faulty f JOIN turns t ON t.initial <> 's' WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL
  SELECT f.conv, f.n, x.node, x.node, 'D', {DELETE}, CAST([] AS VARCHAR[]) FROM faulty f, (VALUES (0), (1), (2), (3)) x(node)
), walk AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT) AS n, 0 AS node, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM given
  UNION ALL
  SELECT w.conv, w.n + 1, o.goes, w.cost + {INSERT} * length(i.letters) + o.price,
    w.audit || repeat('I', length(i.letters)) || o.letter,
    list_concat(w.lines, list_transform(string_split(i.letters, ''), lambda x: CASE x WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' END), o.line)
  FROM walk w JOIN inserts i ON i.node = w.node JOIN options o ON o.conv = w.conv AND o.n = w.n + 1 AND o.node = i.gone
  QUALIFY row_number() OVER (PARTITION BY w.conv, o.goes ORDER BY w.cost + {INSERT} * length(i.letters) + o.price, w.audit || repeat('I', length(i.letters)) || o.letter) = 1
), ended AS (
  SELECT w.conv, cost + {INSERT} * length(i.letters) AS cost, audit || repeat('I', length(i.letters)) AS audit,
    list_filter(list_concat(lines, list_transform(string_split(i.letters, ''), lambda x: CASE x WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' END)), lambda x: x IS NOT NULL) AS lines
  FROM walk w JOIN inserts i ON i.node = w.node AND i.gone IN (0, 3)
  WHERE w.n = (SELECT count(*) FROM faulty f WHERE f.conv = w.conv)
  QUALIFY row_number() OVER (PARTITION BY w.conv ORDER BY cost + {INSERT} * length(i.letters), audit || repeat('I', length(i.letters))) = 1
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) g JOIN ended USING (conv) LEFT JOIN counts USING (conv)
"""


@query("op12_conversation_repair", _ORACLE)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))
