"""Repair of conversations to [system] (user assistant)+ at least cost, by products of min-plus matrices.

The output so far is in one of four states: nothing, after system, after user, after assistant. A turn is a 4 x 4 matrix
of (cost, audit): what it costs to go from one state to another by keeping, re-roling or deleting the turn, after any
inserts. "Add costs and join audits", with "less cost, then the ASCII-least audit" as sum, is associative, because two
audits of the same turns that cost the same are never one the other's prefix. So a conversation's matrix is a tree of
products, and a long conversation is cut into segments whose products are taken apart and then combined in rounds.
What is counted along the way (faults, gaps, illegal neighbours) combines the same way.

Conversations of ordinary length go to one task each, many to a task, streamed in order. Longer ones are range-sorted
over all tasks, repeats are found by an aggregate, segments are multiplied where they are, and only segment summaries
meet. The digest of a repaired conversation is one running SHA-256, which cannot be cut: one task streams the repaired
turns of such a conversation in order, in bounded memory.

Defined results: a null role or text is one space; turns are taken by turn (nulls first), then role, then text, so
repeated rows stay next to each other; a null conv_id is a conversation of its own; a role counts by its first character
(an empty one by none); missing columns are null, other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, store, tune

#: Costs of the edits (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
#: White space, as a set for Python and as a pattern (fixed values).
WHITE, NOT_WHITE = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]"
#: A segment holds up to 2^SEGMENT_BITS turns; conversations of more turns or text than that, or of more bytes, are cut.
SEGMENT_BITS, LONG_BYTES = 12, 8 << 20
#: How many segments one task combines in a round, as a power of two.
FAN_BITS = 6

FINE, CUT, DEAD = "fine", "cut", "dead"
Matrix = list[list[tuple[int, str] | None]]

SUMMARY_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS_DDL = "conv_id long, position long, role string, text string, edit string"
NAMES = ("conv_id", "turn", "role", "text", "present")


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; entries are (cost, audit), None where there is no way."""
    out: Matrix = []
    for row in a:
        best: list[tuple[int, str] | None] = [None] * 4
        for k, left in enumerate(row):
            if left is None:
                continue
            for j, right in enumerate(b[k]):
                if right is None:
                    continue
                cost, old = left[0] + right[0], best[j]
                if old is None or cost < old[0]:
                    best[j] = (cost, left[1] + right[1])
                elif cost == old[0]:
                    best[j] = min(old, (cost, left[1] + right[1]))
        out.append(best)
    return out


def _no_way() -> Matrix:
    return [[None] * 4 for _ in range(4)]


@cache
def closure() -> Matrix:
    """Any number of inserted turns: an assistant after a user, else a user."""
    one = _no_way()
    for state in range(4):
        one[state][state] = (0, "")
        one[state][ASSISTANT if state == USER else USER] = (INSERT, "I")
    return times(one, one)


@cache
def turn_matrix(initial: str, fault: str) -> Matrix:
    """Inserts, then the turn kept, re-roled or deleted."""
    m = _no_way()
    for state in range(4):
        m[state][state] = (DELETE, "D")
        if fault == DEAD:
            continue
        extra = TRUNCATED if fault == CUT else 0
        to, wants = (ASSISTANT, "a") if state == USER else (USER, "u")
        m[state][to] = (extra, "K") if initial == wants else (REROLE + extra, "R")
    if fault != DEAD and initial == "s":
        m[NOTHING][SYSTEM] = (TRUNCATED if fault == CUT else 0, "K")
    return times(closure(), m)


@dataclass
class Part:
    """What is known of consecutive turns of a conversation; `join` combines two, the earlier one first."""

    n: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first_role: str
    last_role: str
    #: Smallest and largest turn, and how many different ones; nulls are not counted.
    first_turn: int | None
    last_turn: int | None
    turns: int
    matrix: Matrix

    def join(self, b: Part) -> Part:
        if not self.n or not b.n:
            return self if self.n else b
        return Part(
            self.n + b.n,
            self.blank + b.blank,
            self.duplicate + b.duplicate,
            self.truncated + b.truncated,
            self.illegal + b.illegal + (self.last_role + b.first_role not in LEGAL),
            self.first_role,
            b.last_role,
            b.first_turn if self.first_turn is None else self.first_turn,
            self.last_turn if b.last_turn is None else b.last_turn,
            self.turns + b.turns - (self.last_turn is not None and self.last_turn == b.first_turn),
            times(self.matrix, b.matrix),
        )

    def best(self) -> tuple[int, str]:
        """The cheapest edits that end with nothing or after an assistant."""
        if not self.n:
            return 0, ""
        row = times([self.matrix[NOTHING]], closure())[0]
        return min(x for x in (row[NOTHING], row[ASSISTANT]) if x is not None)

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def none() -> Part:
    return Part(0, 0, 0, 0, 0, "", "", None, None, 0, [[(0, "") if i == j else None for j in range(4)] for i in range(4)])


def of_turn(turn: int | None, initial: str, fault: str | None) -> Part:
    """fault: "blank", "duplicate", "truncated" or None."""
    kind = {None: FINE, "truncated": CUT}.get(fault, DEAD)
    return Part(
        1, int(fault == "blank"), int(fault == "duplicate"), int(fault == "truncated"), 0, initial, initial, turn, turn, int(turn is not None), turn_matrix(initial, kind)
    )


def reduced(parts: list[Part]) -> Part:
    """All parts, in order, combined as a tree."""
    while len(parts) > 1:
        parts = [parts[i].join(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else none()


def fault_of(text: str, repeated: bool) -> str | None:
    body = text.rstrip(WHITE)
    if not body:
        return "blank"
    if repeated:
        return "duplicate"
    return None if body[-1] in ".!?" else "truncated"


def edited(audit: str, turns: list[tuple[str, str]], state: int = NOTHING) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the turns that an audit leaves, from (role, text); state: the output before them."""
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else turns[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = STATES[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            role = "assistant" if state == ASSISTANT else "user"
        yield role, text, edit


def _given(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present); rows that are not present only tell that there is such a conversation."""
    has = set(turns.columns)
    col = lambda c, kind: (F.col(f"`{c}`") if c in has else F.lit(None)).cast(kind)
    return turns.select(
        col("conv_id", "long").alias("conv_id"),
        col("turn", "long").alias("turn"),
        F.coalesce(col("role", "string"), F.lit(" ")).alias("role"),
        F.coalesce(col("text", "string"), F.lit(" ")).alias("text"),
        F.coalesce(col("present", "boolean"), F.lit(True)).alias("present"),
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: int, *names: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbouring rows that agree in their first `keys` columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if row[:keys] != now:
                if now is not None:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if now is not None:
        yield now, rows


def _batched(ddl: str, rows: Iterator[tuple], many: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of up to `many` rows and about `size` bytes of text."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    got, held = [], 0
    for row in rows:
        got.append(row)
        held += sum(len(x) for x in row if isinstance(x, str))
        if len(got) == many or held >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)
            got, held = [], 0
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)


def _summary(conv_id: int | None, all_of: Part) -> tuple:
    cost, audit = all_of.best()
    return conv_id, all_of.gaps(), all_of.blank, all_of.duplicate, all_of.truncated, all_of.illegal, cost, audit


def _judged(conv_id: int | None, rows: list[tuple]) -> tuple[tuple, list[tuple[str, str]]]:
    """A whole conversation's summary, and its turns."""
    seen: set[tuple[str, str]] = set()
    parts, turns = [], [(role, text) for _, role, text, present in rows if present]
    for turn, role, text, present in rows:
        if present:
            parts.append(of_turn(turn, role[:1], fault_of(text, (role, text) in seen)))
            seen.add((role, text))
    return _summary(conv_id, reduced(parts)), turns


def _short_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv_id,), got in _groups(batches, 1, *NAMES):
            summary, turns = _judged(conv_id, got)
            text = "\n".join(f"{role}:{text}" for role, text, _ in edited(summary[-1], turns))
            yield *summary, hashlib.sha256(text.encode()).hexdigest()

    return _batched(f"{SUMMARY_DDL}, repaired_sha256 string", rows())


def _short_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv_id,), got in _groups(batches, 1, *NAMES):
            summary, turns = _judged(conv_id, got)
            yield from ((conv_id, i, *x) for i, x in enumerate(edited(summary[-1], turns)))

    return _batched(TURNS_DDL, rows())


def _in_order(turns: DataFrame) -> DataFrame:
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions(*order)


def _split(turns: DataFrame, segment_bits: int) -> tuple[DataFrame, DataFrame | None]:
    """Turns of conversations that fit a task, and of those that do not (None if there are none)."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text") + 64).alias("size"))
    long = store(sizes.filter((F.col("n") > 1 << segment_bits) | (F.col("size") > LONG_BYTES)).select(F.col("conv_id").alias("of")), "long")
    if long.isEmpty():
        return turns, None
    same = turns.conv_id.eqNullSafe(long.of)
    return turns.join(bounded(long, 8), same, "left_anti"), turns.join(bounded(long, 8), same, "left_semi")


# ---- conversations that are cut into segments


def _placed(turns: DataFrame, segment_bits: int) -> DataFrame:
    """Present turns of long conversations in one global order, with their place and the segment it falls into.

    Places rise by row inside a partition and by partition in between, so a segment is always inside one partition.
    """
    here = turns.filter("present").withColumn("head", F.substring("text", 1, 64))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    n = max(2, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = here.repartitionByRange(n, *order, F.col("head").asc()).sortWithinPartitions(*order, "text").drop("head", "present")
    placed = sorted_.withColumn("place", F.monotonically_increasing_id())
    return store(placed.withColumn("segment", F.shiftright("place", segment_bits)), "placed")


def _initials(placed: DataFrame) -> DataFrame:
    """(conv_id, segment, place, turn, initial, fault): a turn is a duplicate unless it is the first with its role and text."""
    firsts = placed.groupBy("conv_id", "role", F.sha2("text", 256).alias("text")).agg(F.min("place").alias("f_place")).select("f_place")
    end = F.rtrim("text", F.lit(WHITE))
    small = placed.select("conv_id", "segment", "place", "turn", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), end.rlike(r"[.!?]\z").alias("ended"))
    fault = F.when(F.col("blank"), "blank").when(F.col("f_place").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    return small.join(firsts, small.place == firsts.f_place, "left").select("conv_id", "segment", "place", "turn", "initial", fault.alias("fault"))


PART_FIELDS = ("n", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns")
PART_DDL = (
    "conv_id long, segment long, n long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "first_turn long, last_turn long, turns long, matrix string"
)


def _packed(p: Part) -> tuple:
    """The fields of a part; its matrix as lines of cost and audit."""
    return *(getattr(p, f) for f in PART_FIELDS), "\n".join("" if x is None else f"{x[0]} {x[1]}" for row in p.matrix for x in row)


def _unpacked(row: tuple) -> Part:
    cells = [None if not c else (int((x := c.split(" ", 1))[0]), x[1]) for c in row[-1].split("\n")]
    return Part(*row[:-1], [cells[i : i + 4] for i in range(0, 16, 4)])


def _segment_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = _groups(batches, 2, "conv_id", "segment", "turn", "initial", "fault")
    return _batched(PART_DDL, ((*key, *_packed(reduced([of_turn(*r) for r in rows]))) for key, rows in got))


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = _groups(batches, 2, "conv_id", "of", *PART_FIELDS, "matrix")
    return _batched(PART_DDL, ((*key, *_packed(reduced([_unpacked(r) for r in rows]))) for key, rows in got))


def _whole(parts: DataFrame) -> DataFrame:
    """Parts combined in rounds of 2^FAN_BITS neighbours until each conversation is one."""
    n_convs = parts.select("conv_id").distinct().count()
    while parts.count() > n_convs:
        by = parts.withColumn("of", F.shiftright("segment", FAN_BITS))
        parts = store(by.repartition("conv_id", "of").sortWithinPartitions("conv_id", "of", "segment").mapInArrow(_joined_parts, PART_DDL), "parts")
    return parts


def _summaries_of_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for _, got in _groups(batches, 1, "conv_id", "conv_id", *PART_FIELDS, "matrix") for r in got)
    return _batched(SUMMARY_DDL, (_summary(r[0], _unpacked(r[1:])) for r in rows))


PIECE_DDL = "conv_id long, segment long, state int, position long, piece string"


def _cut_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's piece of its conversation's audit, the state before it and the position of its first turn.

    A row is a conversation: its audit and its segments in order, each with its number of turns and their initials.
    """

    def rows():
        for batch in batches:
            for conv_id, audit, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "segments")), strict=True):
                at, state, position = 0, NOTHING, 0
                for i, s in enumerate(segments):
                    start, left = at, s["n"]
                    while at < len(audit) and (left or i == len(segments) - 1):
                        left -= audit[at] != "I"
                        at += 1
                    piece = audit[start:at]
                    yield conv_id, s["segment"], state, position, piece
                    for role, _, _ in edited(piece, [(c, "") for c in s["initials"]], state):
                        state, position = STATES[role[0]], position + 1

    return _batched(PIECE_DDL, rows())


def _long_turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of segments, turn by turn: each takes its own letter of the piece and the inserts before it."""

    def rows():
        now, state, position, left = None, NOTHING, 0, ""
        for batch in batches:
            for conv_id, segment, first_state, start, piece, role, text in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if (conv_id, segment) != now:
                    if now is not None:
                        yield from ((now[0], position + i, *x) for i, x in enumerate(edited(left, [], state)))
                    now, state, position, left = (conv_id, segment), first_state, start, piece
                own = len(left) - len(left.lstrip("I")) + 1
                for made in edited(left[:own], [(role, text)], state):
                    yield conv_id, position, *made
                    state, position = STATES[made[0][0]], position + 1
                left = left[own:]
        if now is not None:
            yield from ((now[0], position + i, *x) for i, x in enumerate(edited(left, [], state)))

    return _batched(TURNS_DDL, rows())


def _long(turns: DataFrame, segment_bits: int) -> tuple[DataFrame, DataFrame]:
    """(summaries, repaired turns) of long conversations."""
    placed = _placed(turns, segment_bits)
    marked = store(_initials(placed), "initials")
    parts = store(marked.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place").mapInArrow(_segment_parts, PART_DDL), "parts")
    summaries = store(_whole(parts).mapInArrow(_summaries_of_whole, SUMMARY_DDL), "summaries")
    letter = F.when(F.col("initial") == "", " ").otherwise(F.col("initial"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", letter.alias("c")))), lambda x: x.c), "")
    pieces_in = marked.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), lines.alias("initials"))
    cut = pieces_in.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "n", "initials"))).alias("segments"))
    with_audit = cut.join(summaries.select(F.col("conv_id").alias("of"), "audit"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    pieces = store(with_audit.mapInArrow(_cut_audits, PIECE_DDL), "pieces").withColumnsRenamed({"conv_id": "p_conv", "segment": "p_segment"})
    # a segment number is never in two conversations' segments of one place, but both may share one: match on both
    both = placed.join(pieces, placed.conv_id.eqNullSafe(F.col("p_conv")) & (placed.segment == F.col("p_segment"))).drop("p_conv", "p_segment")
    sorted_ = both.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    fixed = sorted_.select("conv_id", "segment", "state", "position", "piece", "role", "text").mapInArrow(_long_turns_of, TURNS_DDL)
    return summaries, fixed


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired turns, which come in order; one running digest is all that is held."""

    def rows():
        now, digest = None, None
        for batch in batches:
            for conv_id, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if digest is not None:
                        yield now, digest.hexdigest()
                    now, digest = conv_id, hashlib.sha256()
                digest.update((f"{role}:{text}" if position == 0 else f"\n{role}:{text}").encode())
        if digest is not None:
            yield now, digest.hexdigest()

    return _batched("conv_id long, repaired_sha256 string", rows())


def summaries(turns: DataFrame, *, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: (conv_id, turn, role, text), and optionally present; rows with present = false are no turns.
    """
    tune(turns.sparkSession)
    short, long = _split(_given(turns), segment_bits)
    out = _in_order(short).mapInArrow(_short_summaries, f"{SUMMARY_DDL}, repaired_sha256 string")
    if long is None:
        return out
    found, fixed = _long(long, segment_bits)
    digests = fixed.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "d_conv")
    every = long.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    told = every.join(found.withColumnRenamed("conv_id", "f_conv"), every.conv_id.eqNullSafe(F.col("f_conv")), "left")
    told = told.join(digests, told.conv_id.eqNullSafe(F.col("d_conv")), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.unionByName(told.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")))


def repaired_turns(turns: DataFrame, *, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I)."""
    tune(turns.sparkSession)
    short, long = _split(_given(turns), segment_bits)
    out = _in_order(short).mapInArrow(_short_turns, TURNS_DDL)
    return out if long is None else out.unionByName(_long(long, segment_bits)[1])


def damaged(turns: DataFrame) -> DataFrame:
    """Planted faults, one turn in four, by crc32 of "conv_id:turn": dropped, emptied, unpunctuated, repeated, made a user's."""
    t = _given(turns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said: Column = F.when(what == 1, "").when(what == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times_ = F.when(what == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.select("conv_id", "turn", F.when(what == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (what != 0).alias("present"), F.explode(times_).alias("copy")).drop("copy")
