"""Conversation structure repair: cheapest edits by a checkpointed dynamic programme.

The rows of a conversation, by turn, should read (system)? (user assistant)+ or be none at all.  A
row is blank (nothing but white space), a duplicate (role and text seen earlier) or truncated (the
last character that isn't white space is none of ``.!?``); the first that holds is its fault.
Keep costs 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate rows must go), Insert
of an empty user or assistant row 3; a truncated row that stays costs 3 more.  Of the cheapest
edits those are taken whose initials (D, I, K, R) come first in ASCII order.

The sequence is read by four states: nothing yet, after system, after user, after assistant.  From
each state there is one role to rerole to or insert, so the edits' letters say all.  A backward pass
gives the cost of each state before each row, but stores these vectors only at every square-root-th
row; the forward walk computes one block of them again at a time and takes the first letter whose
cost is tight.

Conversations may be of any length: rows are dealt by range of (conversation, turn), so a long one
lies in many tasks, and packed into segments of at most ``SEGMENT_ROWS`` rows or ``SEGMENT_BYTES``.
What crosses segments is small: a repeat of a row's digest, the segment's least costs from each
state to each state (combined backward, one stream of 16 numbers a segment, into the vector behind it)
and its four end states (combined forward into the state it starts in).  Each segment is then walked by itself.
Only the report's SHA-256 and audit of a long conversation pass one task in order, as a stream.

Edge cases: a null role or text is one space (such a text is blank, such a role fits nowhere), as is a
null id or turn in the damage hash; null turns come first; rows of equal turn go by role, then text (its
first 64 characters, then a digest); repeated rows are duplicates; a null conversation id is a
conversation; one without rows after the damage has zeros, an empty audit and the hash of the empty
string; an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import CRC_SQL, crc32_sql
from pairlab.session import scratch_path

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
WHITE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: After which states a role's initial may stand, and the state that follows.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that Rerole and Insert give in each state, and the state that follows.
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
REROLE = INSERT = CUT_SHORT = 3
DELETE = 4
NEVER = 1 << 60


def fault(role: str, text: str, repeated: bool) -> int:
    bare = text.rstrip(WHITE)
    if not bare:
        return BLANK
    if repeated:
        return DUPLICATE
    return FINE if bare[-1] in ".!?" else TRUNCATED


def edits_of(initial: str, bad: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row without Insert, in ASCII order: (letter, cost, next state)."""
    out = []
    for state in range(4):
        options = [("D", DELETE, state)]
        if bad in (FINE, TRUNCATED):
            more = CUT_SHORT if bad == TRUNCATED else 0
            if state in STEPS.get(initial, {}):
                options.append(("K", more, STEPS[initial][state]))
            options.append(("R", REROLE + more, GIVEN[state][1]))
        out.append(options)
    return out


EDITS = {(i, bad): edits_of(i, bad) for i in ("s", "u", "a", "") for bad in range(4)}


def kind(role: str, bad: int):
    """What of a row matters to the costs."""
    return EDITS[role[:1] if role[:1] in STEPS else "", bad]


def with_inserts(cost: list[int]) -> list[int]:
    """Costs when rows may be inserted first: at most two, as a third leads back."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[GIVEN[s][1]]) for s, c in enumerate(cost)]
    return cost


#: Costs behind the last row: nothing, or a user and an assistant, may end.
END = with_inserts([0, NEVER, NEVER, 0])


def before(row, behind: list[int]) -> list[int]:
    """Costs before a row from those behind it."""
    return with_inserts([min(c + behind[t] for _, c, t in options) for options in row])


def transfer(rows: list) -> list[int]:
    """Least cost from each state before the rows to each state behind them (16 numbers)."""
    columns = []
    for t in range(4):
        cost = [0 if s == t else NEVER for s in range(4)]
        for row in reversed(rows):
            cost = before(row, cost)
        columns.append(cost)
    return [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]


def through(matrix: list[int], behind: list[int]) -> list[int]:
    """Costs before a segment from those behind it (inserts before its first row included)."""
    return [min(min(matrix[4 * s + t] + behind[t] for t in range(4)), NEVER) for s in range(4)]


def checkpoints(rows: list, behind: list[int]) -> tuple[int, list[list[int]]]:
    """The block length (about the square root), and the costs before each block's first row."""
    step = max(1, math.isqrt(len(rows)))
    kept, cost = [], behind
    for i in range(len(rows) - 1, -1, -1):
        cost = before(rows[i], cost)
        if i % step == 0:
            kept.append(cost)
    return step, kept[::-1]


def walk(rows: list, behind: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """(the edits' letters, their cost, the state behind) of the ASCII-least cheapest way on from ``state``;
    in the last segment inserts may follow the last row."""
    step, kept = checkpoints(rows, behind)
    letters, paid = [], 0
    for block in range(len(kept)):
        part = rows[block * step:(block + 1) * step]
        costs = [kept[block + 1] if block + 1 < len(kept) else behind]
        for row in reversed(part):
            costs.append(before(row, costs[-1]))
        costs.reverse()
        for row, now, then in zip(part, costs, costs[1:]):
            while True:
                tight = [(x, c, t) for x, c, t in row[state] if c + then[t] == now[state]]
                if INSERT + now[GIVEN[state][1]] == now[state]:
                    tight.append(("I", INSERT, GIVEN[state][1]))
                letter, cost, state = min(tight)
                letters.append(letter)
                paid += cost
                if letter != "I":
                    break
    while last and state not in (START, ASSISTANT):
        letters.append("I")
        paid, state = paid + INSERT, GIVEN[state][1]
    return "".join(letters), paid, state


def repaired(roles: list[str], texts: list[str], letters: str, state: int) -> list[tuple[str, str]]:
    """The rows that the edits leave."""
    out, rows = [], iter(zip(roles, texts))
    for x in letters:
        role, text = ("", "") if x == "I" else next(rows)
        if x == "D":
            continue
        if x == "K":
            state = STEPS[role[0]][state]
        else:
            role, state = GIVEN[state]
        out.append((role, text))
    return out


# ---------------------------------------------------------------- Spark

def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) of conversation rows after the damage, chosen by the crc32 of
    ``conv_id:turn`` modulo 20: dropped (there is false), text emptied, ``.!?`` removed, repeated, made
    the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                        F.when(h == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                        (h != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))).alias("copy")).drop("copy")


SEGMENT = "conv_id long, seg long, turns array<long>, roles array<string>, texts array<string>"
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("turns", pa.list_(pa.int64())),
                      ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def segments(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, there) in order, packed; seg rises along a conversation."""
    tie = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))
    keyed = rows.select("conv_id", "turn", F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 64).alias("t"),
                        tie.alias("tie"), F.monotonically_increasing_id().alias("salt"), "role", "text", "there")
    order = ["conv_id", "turn", "r", "t", "tie", "salt"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "there")

    def run(batches):
        number, now, held, size = TaskContext.get().partitionId() << 33, None, None, 0

        def full():
            return pa.RecordBatch.from_pylist([{"conv_id": now[0], "seg": number, "turns": held[0], "roles": held[1], "texts": held[2]}], _SEGMENT)

        for batch in batches:
            for conv, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv,) or len(held[0]) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                    if now is not None:
                        yield full()
                        number += 1
                    now, held, size = (conv,), ([], [], []), 0
                if there:
                    for to, value in zip(held, (turn, role, text)):
                        to.append(value)
                    size += len(role) + len(text)
        if now is not None:
            yield full()

    return dealt.mapInArrow(run, SEGMENT)


def kinds_of(roles: list[str], texts: list[str], repeats: list[int] | None) -> tuple[list[int], list]:
    """Faults and edits of a segment's rows; ``repeats``: the rows whose like stands in an earlier segment."""
    seen, repeats, faults = set(), set(repeats or ()), []
    for i, row in enumerate(zip(roles, texts)):
        faults.append(fault(*row, row in seen or i in repeats))
        seen.add(row)
    return faults, [kind(r, f) for r, f in zip(roles, faults)]


def crossing(parts: DataFrame, path: str) -> DataFrame:
    """(seg, repeats, behind, state, last) for the segments of conversations that have several."""
    spark = parts.sparkSession
    many = (parts.groupBy(F.col("conv_id").alias("whole")).agg(F.min("seg").alias("first"), F.max("seg").alias("final"))
            .where("first < final"))
    parts.join(many, F.col("conv_id").eqNullSafe(F.col("whole"))).select(
        "conv_id", "seg", "roles", "texts", (F.col("seg") == F.col("final")).alias("last")).write.parquet(f"{path}/long")
    long = spark.read.parquet(f"{path}/long")

    rows = long.select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts")))
    digest = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("col.roles"), F.lit(":"),
                            "col.roles", "col.texts").cast("binary"))
    rows = rows.select("seg", "pos", digest.alias("digest"))
    twice = rows.groupBy("digest").agg(F.min("seg").alias("first"), F.max("seg").alias("final")).where("first < final")
    again = (rows.join(twice, "digest").where("seg > first").groupBy("seg").agg(F.collect_set("pos").alias("repeats")))
    long.join(again, "seg", "left").write.parquet(f"{path}/known")
    known = spark.read.parquet(f"{path}/known")

    def costs(batches):
        for b in batches:
            rows = [{"conv_id": conv, "seg": seg, "last": last, "matrix": transfer(kinds_of(roles, texts, repeats)[1])}
                    for conv, seg, last, roles, texts, repeats in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("last", pa.bool_()),
                                                              ("matrix", pa.list_(pa.int64()))]))

    def backward(batches):
        cost = END
        for b in batches:
            rows = []
            for seg, last, matrix in zip(*(c.to_pylist() for c in b.columns)):
                cost = END if last else cost
                rows.append({"seg": seg, "behind": cost})
                cost = through(matrix, cost)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("seg", pa.int64()), ("behind", pa.list_(pa.int64()))]))

    matrices = known.select("conv_id", "seg", "last", "roles", "texts", "repeats").mapInArrow(
        costs, "conv_id long, seg long, last boolean, matrix array<long>")
    (matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")).select("seg", "last", "matrix")
     .mapInArrow(backward, "seg long, behind array<long>").write.parquet(f"{path}/behind"))
    behind = spark.read.parquet(f"{path}/behind")

    def ends(batches):
        for b in batches:
            rows = []
            for conv, seg, last, roles, texts, repeats, cost in zip(*(c.to_pylist() for c in b.columns)):
                row_kinds = kinds_of(roles, texts, repeats)[1]
                rows.append({"conv_id": conv, "seg": seg, "ends": [walk(row_kinds, cost, s, last)[2] for s in range(4)]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    def forward(batches):
        now, state = None, START
        for b in batches:
            rows = []
            for conv, seg, end in zip(*(c.to_pylist() for c in b.columns)):
                if now != (conv,):
                    now, state = (conv,), START
                rows.append({"seg": seg, "state": state})
                state = end[state]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("seg", pa.int64()), ("state", pa.int64())]))

    states = (known.join(behind, "seg").select("conv_id", "seg", "last", "roles", "texts", "repeats", "behind")
              .mapInArrow(ends, "conv_id long, seg long, ends array<long>")
              .repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(forward, "seg long, state long"))
    known.select("seg", "repeats", "last").join(behind, "seg").join(states, "seg").write.parquet(f"{path}/crossing")
    return spark.read.parquet(f"{path}/crossing")


def prepare(rows: DataFrame) -> DataFrame:
    """Segments of rows (conv_id, turn, role, text, there) with all that each needs to be walked by itself:
    repeats, behind, state, last, and whether the conversation is this segment alone."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "conversations")
    segments(rows).write.parquet(f"{path}/segments")
    parts = spark.read.parquet(f"{path}/segments")
    more = crossing(parts, path)
    whole = F.col("state").isNull()
    return parts.join(more, "seg", "left").select(
        "conv_id", "seg", "turns", "roles", "texts", "repeats",
        F.coalesce("behind", F.array(*(F.lit(c).cast("long") for c in END))).alias("behind"),
        F.coalesce("state", F.lit(START)).alias("state"), F.coalesce("last", F.lit(True)).alias("last"), whole.alias("alone"))


WALKED = ("conv_id long, seg long, edits string, cost long, faults array<int>, turns array<long>, initials array<string>, "
          "roles array<string>, texts array<string>")


def walked(prepared: DataFrame) -> DataFrame:
    """Per segment, in order of (conv_id, seg): the edits' letters and cost, faults, turns and initials of
    its rows, and roles and texts after the repair."""
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("edits", pa.string()), ("cost", pa.int64()),
                        ("faults", pa.list_(pa.int32())), ("turns", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())),
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                for conv, seg, turns, roles, texts, repeats, behind, state, last in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    faults, row_kinds = kinds_of(roles, texts, repeats)
                    letters, cost, _ = walk(row_kinds, behind, state, last)
                    left = repaired(roles, texts, letters, state)
                    rows.append({"conv_id": conv, "seg": seg, "edits": letters, "cost": cost, "faults": faults, "turns": turns,
                                 "initials": [r[:1] for r in roles], "roles": [r for r, _ in left], "texts": [t for _, t in left]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return prepared.select("conv_id", "seg", "turns", "roles", "texts", "repeats", "behind", "state", "last").mapInArrow(run, WALKED)


REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


class _Report:
    """What is told of one conversation, from its segments in order."""

    def __init__(self, conv):
        self.conv, self.least, self.turn, self.distinct, self.initial = conv, None, None, 0, None
        self.faults, self.illegal, self.cost, self.letters, self.sha, self.lines = [0] * 4, 0, 0, [], hashlib.sha256(), 0

    def add(self, letters, cost, faults, turns, initials, roles, texts) -> None:
        for t in turns:
            if t is not None and t != self.turn:
                self.least, self.turn, self.distinct = t if self.least is None else self.least, t, self.distinct + 1
        for f in faults:
            self.faults[f] += 1
        for x in initials:
            self.illegal += self.initial is not None and self.initial + x not in ("su", "ua", "au")
            self.initial = x
        self.cost += cost
        self.letters.append(letters)
        for role, text in zip(roles, texts):
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> dict:
        gaps = self.turn - self.least + 1 - self.distinct if self.distinct else 0
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
                "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.letters), "repaired_sha256": self.sha.hexdigest()}


def reports(prepared: DataFrame) -> DataFrame:
    """A row a conversation: turns that are missing, rows by fault, adjacent roles that don't fit, cost
    and letters of the edits, and the SHA-256 of the repaired rows."""
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for conv, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Report(conv)
                now.add(*cells)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    told = lambda parts: parts.drop("seg").mapInArrow(run, REPORT)
    split = walked(prepared.where("NOT alone")).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return told(walked(prepared.where("alone"))).unionByName(told(split))


def oracle() -> str:
    """DuckDB SQL for the query: the cheapest, then ASCII-least way to each state, row by row."""
    steps = ", ".join(f"('{i}', {s}, {t})" for i, to in STEPS.items() for s, t in to.items())
    given = ", ".join(f"({s}, '{role}', {t})" for s, (role, t) in GIVEN.items())
    return f"""WITH RECURSIVE {CRC_SQL},
steps_of(initial, s, t) AS (VALUES {steps}), given(s, role, t) AS (VALUES {given}),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS c,
  {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, crc),
damaged AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
marked AS (SELECT *, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final,
  row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS repeated FROM placed),
rows_ AS MATERIALIZED (SELECT c, i, turn, role, text, substr(role, 1, 1) AS initial,
  CASE WHEN final = '' THEN 1 WHEN repeated THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS former FROM marked),
edits AS (SELECT c, i, s.s, 'D' AS x, {DELETE} AS cost, s.s AS t, CAST(NULL AS VARCHAR) AS line FROM rows_, (SELECT DISTINCT s FROM given) s
  UNION ALL SELECT c, i, s, 'K', CASE WHEN fault = 3 THEN {CUT_SHORT} ELSE 0 END, t, role || ':' || text FROM rows_ JOIN steps_of USING (initial) WHERE fault IN (0, 3)
  UNION ALL SELECT c, i, s, 'R', CASE WHEN fault = 3 THEN {REROLE + CUT_SHORT} ELSE {REROLE} END, t, given.role || ':' || text FROM rows_, given WHERE fault IN (0, 3)),
inserts AS (SELECT s, s AS t, 0 AS cost, '' AS x, CAST([] AS VARCHAR[]) AS lines FROM given
  UNION ALL SELECT s, t, {INSERT}, 'I', [role || ':'] FROM given
  UNION ALL SELECT a.s, b.t, {2 * INSERT}, 'II', [a.role || ':', b.role || ':'] FROM given a JOIN given b ON a.t = b.s),
ways AS (SELECT c, 0::BIGINT AS i, t AS s, cost, x AS audit, lines FROM (SELECT DISTINCT c FROM raw), inserts WHERE inserts.s = {START}
  UNION ALL SELECT c, i, s, cost, audit, lines FROM (
    SELECT w.c, e.i, n.t AS s, w.cost + e.cost + n.cost AS cost, w.audit || e.x || n.x AS audit,
      list_concat(w.lines, list_concat(CASE WHEN e.line IS NULL THEN CAST([] AS VARCHAR[]) ELSE [e.line] END, n.lines)) AS lines,
      row_number() OVER (PARTITION BY w.c, n.t ORDER BY w.cost + e.cost + n.cost, w.audit || e.x || n.x) AS place
    FROM ways w JOIN edits e ON e.c = w.c AND e.i = w.i + 1 AND e.s = w.s JOIN inserts n ON n.s = e.t) WHERE place = 1),
lengths AS (SELECT raw.c, any_value(raw.conv_id) AS conv_id, coalesce(max(rows_.i), 0) AS n FROM raw LEFT JOIN rows_ USING (c) GROUP BY raw.c),
best AS (SELECT c, cost, audit, lines FROM ways JOIN lengths USING (c) WHERE ways.i = n AND ways.s IN ({START}, {ASSISTANT})
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1),
told AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
  count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM lengths JOIN best USING (c) LEFT JOIN told USING (c)"""
