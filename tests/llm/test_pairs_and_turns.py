"""Hard negatives and conversation repair against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from waymeet.llm import conversations, negatives

VECTORS = "vec_id long, embedding array<float>, label int, score double, `row` string"
TURNS = "conv_id long, turn long, role string, text string, place string, n_chars int"


# ---- hard negatives


def vectors():
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(0, 0.2), 3) for _ in range(6)], rng.randrange(3)) for i in range(260)]
    rows += [(100, rows[100][1], rows[100][2]), (100, [0.5] * 6, 1), (None, [0.3] * 6, 1), (None, [0.3] * 6, 1), (301, [0.5] * 3, 2), (302, [], 0)]
    rows += [(303, None, 1), (304, [0.1] * 6, None), (305, [float("nan")] * 6, 1), (306, [None, *[0.1] * 5], 1), (307, [float("inf")] * 6, 0), (308, [0.5] * 6, 0), (309, [0.5] * 6, 2)]
    return rows


def mined(rows, scale=256, n_pos=5, n_neg=10):
    fine = [
        (n, i, [math.floor(scale * x) for x in v], lab)
        for n, (i, v, lab) in enumerate(rows)
        if v is not None and lab is not None and all(x is not None and math.isfinite(x * scale) for x in v)
    ]
    out = []
    for n, i, v, lab in fine:
        if i is None or i % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w, strict=False)), j, m, other) for m, j, w, other in fine if m != n), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for score, j, _, _ in [r for r in scored if r[3] == lab][:n_pos]:
            hit = [r for r in scored if r[3] != lab and 30 * score <= 100 * r[0] <= 90 * score][:n_neg]
            out += [(i, j, k + 1, r[1], score, r[0]) for k, r in enumerate(hit)]
    return sorted(map(str, out))


def as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 150])
def test_negatives_match_brute_force(spark, anchor_bytes):
    df = spark.createDataFrame([(i, v, lab, 0.5, "clash") for i, v, lab in vectors()], VECTORS).repartition(3)
    got = negatives.mine(df, anchor_bytes=anchor_bytes)
    assert sorted(str(tuple(r)) for r in got.collect()) == mined(as_float32(vectors()))


def test_negatives_of_vectors_beyond_float64(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1.0, 3.0, 2.0**30, 2.0**27 + 1]) * rng.choice([1, 1, -1]) for _ in range(3)], rng.randrange(2)) for i in range(0, 600, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, got = mined(rows, scale=1), sorted(str(tuple(r)) for r in negatives.mine(df, scale=1).collect())
    assert got == want and len(want) > 20
    huge = [(i, [x * 2.0**40 for x in v], lab) for i, v, lab in rows]
    told = negatives.mine(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int"), scale=1).collect()
    ids = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"]) for r in told)
    assert ids == sorted(tuple(int(x) for x in re.findall(r"-?\d+", w)[:4]) for w in mined(huge, scale=1))
    assert max(r["positive_score"] for r in told) == (1 << 63) - 1


def test_negatives_of_an_empty_table_and_without_anchors(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, [0.5], 1, 0.0, "")], VECTORS)).collect() == []


def test_a_task_sends_few_rows_and_dealing_does_not_matter(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.normal(size=8).tolist(), int(rng.integers(4))) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    one, many = (sorted(map(tuple, negatives.mine(df.repartition(n)).collect())) for n in (1, 8))
    assert one == many and len(one) > 500


# ---- conversations


def brute(turns):
    """The least (cost, audit) over all edits of a few turns with up to two inserts at each place."""
    best = None
    seen, faults = set(), []
    for role, text in turns:
        body = text.strip(conversations.WHITE)
        faults.append("dead" if not body or (role, text) in seen else "" if body[-1] in ".!?" else "cut")
        seen.add((role, text))
    gap = [(5 * n, "I" * n, "".join(r)) for n in (0, 1, 2) for r in itertools.product("ua", repeat=n)]
    choices = [gap]
    for (role, _), fault in zip(turns, faults, strict=True):
        more = 5 if fault == "cut" else 0
        alive = [(more, "K", role[:1] or "?"), (1 + more, "R", "u"), (1 + more, "R", "a")] if fault != "dead" else []
        choices += [[(2, "D", ""), *alive], gap]
    for way in itertools.product(*choices):
        cost, audit = sum(w[0] for w in way), "".join(w[1] for w in way)
        if (best is None or (cost, audit) < best) and re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in way)):
            best = cost, audit
    return best


def test_matrix_products_find_the_cheapest_edits():
    rng = random.Random(8)
    for _ in range(150):
        turns = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", "c!", "d?"])) for _ in range(rng.randrange(4))]
        summary, _ = conversations._judged(1, [(i, *t, True) for i, t in enumerate(turns)])
        assert summary[-2:] == brute(turns), turns


def test_products_are_associative():
    rng = random.Random(9)
    parts = [conversations.of_turn(i, rng.choice("suat"), rng.choice([None, "blank", "truncated"])) for i in range(9)]
    left = parts[0]
    for p in parts[1:]:
        left = left.join(p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = p.join(right)
    assert left == right == conversations.reduced(parts)
    assert conversations.none().join(left) == left == left.join(conversations.none())


def hard_turns():
    rng = random.Random(10)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 60) if conv % 5 == 0 else rng.randrange(1, 7)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No", "", " \t", None, "Why?", f"Line {turn}.", f"Line {turn}."])))
    rows += [(77, t, "user", "the very same words.") for t in range(40)] + [(78, 3, "user", "x" * 100_000 + "."), (78, 9, "assistant", "ü \n.")]
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (5, 1, "user", "again."), (5, 1, "user", "again.")]
    return [(*r, "clash", 3) for r in rows]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " ").encode(), (r[3] if r[3] is not None else " ").encode()) for r in rows if r[0] == conv)
        turns = [(r[2].decode(), r[3].decode()) for r in mine]
        summary, _ = conversations._judged(conv, [(r[1] if r[0] else None, *t, True) for r, t in zip(mine, turns, strict=True)])
        text = "\n".join(f"{role}:{text}" for role, text, _ in conversations.edited(summary[-1], turns))
        out[conv] = (*summary[1:], hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment_bits", [12, 3])
def test_cut_conversations_are_repaired_as_whole_ones(spark, segment_bits):
    df = spark.createDataFrame(hard_turns(), TURNS).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.summaries(df, segment_bits=segment_bits).collect()}
    assert got == expected(hard_turns())


def test_repaired_turns_are_legal_and_the_same_when_cut(spark):
    df = spark.createDataFrame(hard_turns(), TURNS).repartition(3)
    whole, cut = (sorted((str(r["conv_id"]), *tuple(r)[1:]) for r in conversations.repaired_turns(df, segment_bits=b).collect()) for b in (12, 3))
    assert whole == cut
    for _, mine in itertools.groupby(whole, key=lambda r: r[0]):
        mine = list(mine)
        assert [r[1] for r in mine] == list(range(len(mine)))
        assert re.fullmatch("s?(ua)+", "".join(r[2][0] for r in mine))


def test_conversations_without_turns(spark):
    rows = [(1, 0, "user", "hi.", False), (2, 0, "user", "hi.", True)] + [(3, t, "user", "gone", False) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean")
    empty = hashlib.sha256(b"").hexdigest()
    for bits in (12, 3):
        got = {r["conv_id"]: tuple(r)[1:] for r in conversations.summaries(df, segment_bits=bits).collect()}
        assert got[1] == got[3] == (0, 0, 0, 0, 0, 0, "", empty) and got[2][-2] == "D"
    assert conversations.summaries(spark.createDataFrame([], TURNS)).collect() == []
    assert conversations.summaries(conversations.damaged(spark.createDataFrame([], TURNS))).collect() == []


def test_damage_is_as_stated(spark):
    rows = [(i, t, "assistant", "One. Two!") for i in range(40) for t in range(3)] + [(None, None, None, None)]
    got = {}
    for r in conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["present"]))
    for i, t, role, text in rows:
        role, text = role or " ", text or " "
        what = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        want = {0: [(role, text, False)], 1: [(role, "", True)], 2: [(role, re.sub("[.!?]", "", text), True)], 3: [(role, text, True)] * 2, 4: [("user", text, True)]}
        assert got[i, t] == want.get(what, [(role, text, True)])
