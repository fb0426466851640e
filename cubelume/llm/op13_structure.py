"""Repair of conversations' structure by iterative-deepening A*.

A conversation is right if its roles' initials are nothing, or ua repeated, with one s before it at most. Edits: keep (0), rerole to user or
assistant (1), delete (2; blank and repeated rows must be deleted), insert an empty user or assistant row (5); a truncated row that stays costs 5 more.
The state after any edits says which role comes next, so that the string of edits' initials says all. It is searched depth first, edits in ASCII order, under
a bound on the cost that rises to the least cost that was cut off; a table holds for each failed state the cost that it needs at least. The first
path that is accepted is thus the cheapest, and the least string of the cheapest.

Rows are ordered by a range shuffle and written, numbered in that order; BLOCK consecutive numbers are searched by one task. A conversation that lies within a block
is searched once. A piece at a block's edge, whose conversation may go on, is searched for each state that it may begin and end in; a row for each piece
then decides the states, so a conversation of any length is many tasks. (Pieces never end in an insertion but for the last of a conversation; so none of a piece's
strings begins another, and the least string is the least in each piece in turn.)

Defined results: null role and text are one blank; conversations without conv_id are one conversation; rows stand by turn (nulls first), rows of one
turn by role and then by their text's SHA-256; equal rows are repetitions of the first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ready, table, written

#: Rows of a block are 2 to this.
BLOCK_BITS = 9
ROWS_A_PART = 100_000
BLANKS = " \t\n\x0b\f\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
DELETE, INSERT, REROLE, STAYS = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a. The end, as a goal: state 0 or 3, insertions may come last.
START, END = 0, 4
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}


def lower_bounds(initials: list[str], faults: list[int]) -> list[tuple[int, int]]:
    """For each place, what the rest costs at least: from the start state, and from any other.

    A row that must go, or is truncated, costs a deletion; a role that isn't one of the three, or s other than first, costs 1; so do two sound rows of one role
    with nothing but faulty ones between (each row counts in one such pair)."""
    n = len(initials)
    pairs, out = [0] * (n + 1), [(0, 0)] * (n + 1)
    base = systems = 0
    after = None  # the next sound row
    for i in range(n - 1, -1, -1):
        pairs[i] = pairs[i + 1]
        if faults[i] != SOUND:
            base += DELETE
        else:
            c = initials[i]
            if c == "s":
                systems += 1
            elif c not in ("u", "a"):
                base += REROLE
            elif after is not None and initials[after] == c:
                pairs[i] = max(pairs[i], 1 + pairs[after + 1])
            after = i
        out[i] = (base + pairs[i] + max(0, systems - 1), base + pairs[i] + systems)
    return out


def search(initials: list[str], faults: list[int], entry: int = START, goal: int = END) -> tuple[int, str, str] | None:
    """Cost, edits and the states after each of the first accepted path from entry to goal; None if there is no path."""
    n = len(initials)
    if goal < min(entry, 2) or goal == 1 and entry == START and not any(c == "s" and f in (SOUND, TRUNCATED) for c, f in zip(initials, faults, strict=True)):
        return None
    least = lower_bounds(initials, faults)
    needs: dict[tuple[int, int], int] = {}  # of failed states

    def need(i: int, state: int) -> int:
        return needs.get((i, state), least[i][state > 0])

    def steps(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        wanted = WANTED[state]
        if i == n:
            if goal == END:
                yield INSERT, "I", i, wanted
            return
        yield DELETE, "D", i + 1, state
        yield INSERT, "I", i, wanted
        if faults[i] in (SOUND, TRUNCATED):
            more = STAYS if faults[i] == TRUNCATED else 0
            if (to := KEPT[state].get(initials[i])) is not None:
                yield more, "K", i + 1, to
            yield REROLE + more, "R", i + 1, wanted

    bound = need(0, entry)
    while True:
        path: list[tuple[str, int]] = []
        stack = [[0, entry, 0, steps(0, entry), None]]  # place, state, cost so far, edits left, least cost that was seen from here
        while stack:
            i, state, cost, edits, seen = top = stack[-1]
            if i == n and (state in (0, 3) if goal == END else state == goal):
                return cost, "".join(e for e, _ in path), "".join(str(to) for _, to in path)
            for c, edit, j, to in edits:
                whole = c + need(j, to)
                if cost + whole <= bound:
                    path.append((edit, to))
                    stack.append([j, to, cost + c, steps(j, to), None])
                    break
                if top[4] is None or whole < top[4]:
                    top[4] = whole
            else:
                failed = top[4] if top[4] is not None else 1 << 40
                needs[i, state] = max(failed, need(i, state))
                stack.pop()
                if stack:
                    path.pop()
                    above = stack[-1]
                    whole = cost - above[2] + needs[i, state]
                    if above[4] is None or whole < above[4]:
                        above[4] = whole
        bound = needs[0, entry]


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> these with id (numbered in order, without gaps inside a part), sha (of role and text), written once."""
    text, role = (F.coalesce(col(rows, c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    r = rows.select(col(rows, "conv_id").cast("long").alias("conv_id"), col(rows, "turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    r = r.withColumn("sha", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))).withColumn("any", F.monotonically_increasing_id())  # equal rows go to many parts, too
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_PART))
    order = ["conv_id", "turn", "role", "sha", "any"]
    return written(r.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("any").withColumn("id", F.monotonically_increasing_id()), "conv-rows")


def faults(rows: DataFrame) -> DataFrame:
    """ordered rows -> id, conv_id, initial, fault; no texts."""
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    own = F.when(seen == "", BLANK).when(~F.substring(seen, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    small = rows.select("id", "conv_id", "sha", F.substring("role", 1, 1).alias("initial"), own.alias("own"))
    again = small.groupBy("conv_id", "sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("sha").alias("s"), "first")
    joined = small.join(again, F.col("sha").eqNullSafe(F.col("s")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return joined.select("id", "conv_id", "initial", F.when((F.col("own") != BLANK) & (F.col("id") > F.col("first")), DUPLICATE).otherwise(F.col("own")).alias("fault"))


PIECE = "conv_id long, start long, open boolean, entry int, goal int, cost long, turn_of int, audit string, states string, first string, last string, illegal long"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _illegal(initials: list[str]) -> int:
    return sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))


def _searched(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, each wholly in this task and in order -> pieces. turn_of: where a string stands among those of its piece and entry."""
    names = [f.split()[0] for f in PIECE.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]]) for n, f in zip(names, PIECE.split(", "), strict=True)])

    def pieces(ids: list, convs: list, initials: list, marks: list) -> Iterator[tuple]:
        a, n = 0, len(ids)
        while a < n:
            b = a + 1
            while b < n and convs[b] == convs[a] and ids[b] >> bits == ids[a] >> bits:
                b += 1
            left = a == 0 or ids[a - 1] >> bits != ids[a] >> bits  # its conversation may have begun in an earlier block
            right = b == n or ids[b] >> bits != ids[a] >> bits
            mine, marked = initials[a:b], marks[a:b]
            for entry in range(4) if left else (START,):
                found = [(goal, r) for goal in (range(END + 1) if right else (END,)) if (r := search(mine, marked, entry, goal))]
                turns = sorted(audit for _, (_, audit, _) in found)
                for goal, (cost, audit, states) in found:
                    yield convs[a], ids[a], left or right, entry, goal, cost, turns.index(audit), audit, states, mine[0], mine[-1], _illegal(mine)
            a = b

    waiting: list[list] = [[], [], [], []]
    for batch in batches:
        for have, c in zip(waiting, ("id", "conv_id", "initial", "fault"), strict=True):
            have += batch.column(c).to_pylist()
        if not waiting[0]:
            continue
        last = waiting[0][-1] >> bits
        cut = next(i for i in range(len(waiting[0]), 0, -1) if i == 1 or waiting[0][i - 2] >> bits != last) - 1  # where the last block begins
        rows = list(pieces(*(w[:cut] for w in waiting)))
        waiting = [w[cut:] for w in waiting]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
    if rows := list(pieces(*waiting)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces in the order of conv_id and start -> for each the states that it begins and ends in, and whether it joins the piece before against the rule."""

    def chosen(rows: list[tuple]) -> Iterator[tuple]:
        pieces: list[tuple] = []  # start, {entry: [(goal, cost, turn_of)]}, first, last
        for start, entry, goal, cost, turn_of, first, last in rows:
            if not pieces or pieces[-1][0] != start:
                pieces.append((start, {}, first, last))
            pieces[-1][1].setdefault(entry, []).append((goal, cost, turn_of))
        rest: list[dict] = [{}] * len(pieces)  # cheapest from a piece's entry to the end
        for k in range(len(pieces) - 1, -1, -1):
            final, ahead = k == len(pieces) - 1, rest[k + 1] if k + 1 < len(pieces) else {}
            cheapest = {e: [c + (0 if final else ahead[g]) for g, c, _ in ways if (g == END if final else g in ahead)] for e, ways in pieces[k][1].items()}
            rest[k] = {e: min(c) for e, c in cheapest.items() if c}
        state = START
        for k, (start, ways, first, _) in enumerate(pieces):
            final = k == len(pieces) - 1
            _, goal = min((turn_of, g) for g, c, turn_of in ways[state] if (g == END and c == rest[k][state] if final else g in rest[k + 1] and c + rest[k + 1][g] == rest[k][state]))
            yield start, state, goal, int(k > 0 and (pieces[k - 1][3], first) not in LEGAL)
            state = goal

    def result(rows: list[tuple]) -> pa.RecordBatch:
        found = list(chosen(rows))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["start", "entry", "goal", "joins"])

    waiting, conv = [], None
    for batch in batches:
        for c, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "start", "entry", "goal", "cost", "turn_of", "first", "last")), strict=True):
            if waiting and c != conv:
                yield result(waiting)
                waiting = []
            conv = c
            waiting.append(tuple(row))
    if waiting:
        yield result(waiting)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen pieces -> an edit a row, of the row `id` (an insertion's is the row that it comes before, or the last row where it comes at the end)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for conv, start, audit, states in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "start", "audit", "states")), strict=True):
            at, last = start, start + sum(e != "I" for e in audit) - 1
            for step, (edit, state) in enumerate(zip(audit, states, strict=True)):
                for have, x in zip(out, (conv, min(at, last), step, edit, ROLE[int(state)] if edit in "IR" else None), strict=True):
                    have.append(x)
                at += edit != "I"
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["conv_id", "id", "step", "edit", "new_role"])


def repair(conversations: DataFrame, block_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """conversations (conv_id, turn, role, text) -> the edits in order (conv_id, id, step, edit, role, text; deleted rows have a null text) and
    the counts (a row for each piece: conv_id, cost, blank, duplicate, truncated, illegal, to be added)."""
    spark, bits = ready(conversations.sparkSession), block_bits or BLOCK_BITS
    rows = ordered(conversations)
    marks = written(faults(rows), "conv-faults")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = marks.repartition(parts, F.shiftright("id", bits)).sortWithinPartitions("id")
    pieces = written(blocks.mapInArrow(lambda batches: _searched(batches, bits), PIECE), "conv-pieces")
    edge = pieces.where("open").select("conv_id", "start", "entry", "goal", "cost", "turn_of", "first", "last").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "start", "entry")
    decided = edge.mapInArrow(_decided, "start long, entry int, goal int, joins long")
    chosen = pieces.where("NOT open").withColumn("joins", F.lit(0).cast("long")).unionByName(pieces.where("open").join(decided, ["start", "entry", "goal"]))
    chosen = written(chosen, "conv-chosen")
    edits = chosen.select("conv_id", "start", "audit", "states").mapInArrow(_edits, "conv_id long, id long, step int, edit string, new_role string")
    kept = edits.where("edit != 'I'").join(rows.select("id", "role", "text"), "id")
    kept = kept.select("conv_id", "id", "step", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") != "D", F.col("text")).alias("text"))
    inserted = edits.where("edit = 'I'").select("conv_id", "id", "step", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    one = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
    counts = marks.groupBy("conv_id").agg(one(BLANK).alias("blank"), one(DUPLICATE).alias("duplicate"), one(TRUNCATED).alias("truncated"))
    counts = counts.select("conv_id", F.lit(0).cast("long").alias("cost"), "blank", "duplicate", "truncated", F.lit(0).cast("long").alias("illegal"))
    nought = [F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    return kept.unionByName(inserted), counts.unionByName(chosen.select("conv_id", "cost", *nought, (F.col("illegal") + F.col("joins")).alias("illegal")))


def digests(edits: DataFrame) -> DataFrame:
    """Edits -> conv_id, audit, repaired_sha256 of `role:text` joined by newlines. A hash of a sequence is read in sequence: a task streams a conversation's
    rows in order and holds the hash and the initials only."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array(["".join(d[1]) for d in done], pa.string()), pa.array([d[2].hexdigest() for d in done], pa.string())], ["conv_id", "audit", "repaired_sha256"])

        now, done = None, []
        for batch in batches:
            for conv, edit, line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "line")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = (conv, [], hashlib.sha256(), [])
                now[1].append(edit)
                if line is not None:
                    now[2].update((b"\n" if now[3] else b"") + line.encode())
                    now[3][:] = [True]
            if done:
                yield result(done)
                done = []
        if now is not None:
            yield result([now])

    line = F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text")).alias("line")
    parts = int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_edits = edits.select("conv_id", "id", "step", "edit", line).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "id", "step")
    return sorted_edits.mapInArrow(digest, "conv_id long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults that the query plants, by a hash of conversation and turn."""
    conv, turn = (col(conversations, c).cast("long").alias(c) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(col(conversations, c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = conversations.select(conv, turn, role, text)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("h", F.crc32(key.cast("binary")) % 20).where("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times: Column = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    edits, counts = repair(rows)
    wide = "decimal(38,0)"
    turns = rows.select("conv_id", F.col("turn").cast(wide).alias("turn")).where("turn IS NOT NULL").distinct()
    nothing = {c: F.lit(None).cast(t) for c, t in (("turn", wide), ("cost", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("audit", "string"), ("repaired_sha256", "string"))}
    filled = lambda df: df.select("conv_id", *(df[c] if c in df.columns else x.alias(c) for c, x in nothing.items()))
    parts = (given.select(col(given, "conv_id").cast("long").alias("conv_id")).distinct(), turns, counts, digests(edits))
    whole = filled(parts[0]).unionByName(filled(parts[1])).unionByName(filled(parts[2])).unionByName(filled(parts[3]))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).try_cast("long").alias("gaps")
    return whole.groupBy("conv_id").agg(
        gaps, *(total(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )


SQL: dict[str, str] = {}
QUERIES = {"op13_structure": op13_structure}
