import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cubelume.llm import op13_structure as op

WS = set(" \t\n\x0b\f\r")
SCHEMA = "conv_id long, turn long, role string, text string"


def marks(rows):
    """(role, text) in order -> initials and faults, plainly."""
    seen, out = set(), []
    for role, text in rows:
        left = [c for c in text if c not in WS]
        out.append((role[:1], op.BLANK if not left else op.DUPLICATE if (role, text) in seen else op.SOUND if left[-1] in ".!?" else op.TRUNCATED))
        seen.add((role, text))
    return [i for i, _ in out], [f for _, f in out]


def cheapest(initials, faults):
    """Dijkstra over (place, what has been said): cost, then the string."""
    nexts = lambda said: {"": "su", "s": "u", "u": "a", "a": "u"}[said]
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        if i == len(initials) and said in ("", "a"):
            return cost, audit
        if (i, said) in done:
            continue
        done.add((i, said))
        wanted = nexts(said)[-1]
        heapq.heappush(heap, (cost + 5, audit + "I", i, wanted))
        if i < len(initials):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, said))
            if faults[i] not in (op.BLANK, op.DUPLICATE):
                more = 5 * (faults[i] == op.TRUNCATED)
                if initials[i] and initials[i] in nexts(said):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i]))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, wanted))


def expected(rows):
    """conversations' rows -> {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)}."""
    out = {}
    key = lambda x: (x is not None, x)
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: key(r[0])), key=lambda r: r[0]):
        after = []
        for _, turn, role, text in group:
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            after += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        after.sort(key=lambda r: (key(r[0]), r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in after if t is not None}
        said = [(role, text) for _, role, text in after]
        initials, faults = marks(said)
        cost, audit = cheapest(initials, faults)
        lines, i, last = [], 0, ""
        for edit in audit:
            wanted = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{wanted}:")
            elif edit != "D":
                lines.append(f"{said[i][0] if edit == 'K' else wanted}:{said[i][1]}")
            last = last if edit == "D" else lines[-1][0]
            i += edit != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(op.BLANK), faults.count(op.DUPLICATE), faults.count(op.TRUNCATED), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def held(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = op.op13_structure(spark, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    return got


def test_search_against_dijkstra():
    dice = random.Random(5)
    for _ in range(3000):
        n = dice.randrange(0, 12)
        initials, faults = [dice.choice("suaut x"[: dice.choice((3, 7))]) for _ in range(n)], [dice.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
        assert op.search(initials, faults)[:2] == cheapest(initials, faults), (initials, faults)


def test_bounds_are_never_above_the_cost():
    dice = random.Random(6)
    for _ in range(2000):
        n = dice.randrange(0, 10)
        initials, faults = [dice.choice("suaux") for _ in range(n)], [dice.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
        assert op.lower_bounds(initials, faults)[0][0] <= cheapest(initials, faults)[0]


def test_pieces_have_paths_between_all_states_that_can_follow():
    for n in (1, 2, 3):
        for initials in itertools.product("sua", repeat=n):
            for entry in range(4):
                for goal in range(5):
                    found = op.search(list(initials), [0] * n, entry, goal)
                    possible = goal == 4 or goal == entry or goal >= 2 or (goal == 1 and entry == 0 and "s" in initials)
                    assert (found is not None) == possible, (initials, entry, goal)


def test_whole_table(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held(spark, rows, tmp_path)


def test_nulls_ties_repetitions_and_odd_roles(spark, tmp_path):
    dice = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ünknown"], ["Yes.", "No!", "hm", "", None, " \t\n", "é?  ", "x" * 50_000, "a\x0b.\x0b", "　"]
    rows = [(dice.choice((None, 1, 2, 3, 4, 5)), dice.choice((None, 0, 1, 2, 2, 9, -(1 << 62), 1 << 62)), dice.choice(roles), dice.choice(texts)) for _ in range(300)]
    held(spark, [r for r in rows if r[0] != 5 or (r[1] or 0) in (0, 1, 2, 9)] + [(7, t, "user", None) for t in range(3)], tmp_path)


def test_a_conversation_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "ROWS_A_PART", 700)
    monkeypatch.setattr(op, "BLOCK_BITS", 5)
    dice = random.Random(8)
    rows = [(1, t, dice.choice(("user", "assistant", "assistant", "system")), dice.choice(("Yes.", f"{t}.", f"{t}", " "))) for t in range(3000)] + [(c, t, r, f"{c} {t}.") for c in range(2, 200) for t, r in enumerate(("user", "assistant"))]
    got = held(spark, rows, tmp_path)
    assert max(len(r.audit) for r in got) > 2500


def test_a_conversation_whose_rows_are_all_dropped(spark, tmp_path):
    gone = [(c, 0) for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = held(spark, [(c, t, "user", "Yes.") for c, t in gone], tmp_path)
    assert got and all(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256().hexdigest() for r in got)


@pytest.mark.parametrize("extra", ["id", "h", "FAULT", "copy", "turn_of"])
def test_clashing_columns_and_an_empty_table(spark, tmp_path, extra):
    df = spark.createDataFrame([(1, 0, "user", "Yes."), (1, 1, "assistant", "No.")], SCHEMA).withColumn(extra, F.lit("x"))
    df.write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert op.op13_structure(spark, f"{tmp_path}/a").count() == 1
    df.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert op.op13_structure(spark, f"{tmp_path}/b").count() == 0
