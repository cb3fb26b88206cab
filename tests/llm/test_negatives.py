"""Hard negatives against all pairs in plain Python, Strassen products against numpy."""

import math
import random

import numpy as np
import pytest

from pavelens.llm.negatives import Heaps, mine_hard_negatives, strassen, window

SCHEMA = "det_id long, class_name string, embedding array<double>, is_anchor boolean, _group int, rank string"


@pytest.mark.parametrize("n,k,m", [(1, 1, 1), (3, 5, 2), (17, 33, 18), (64, 64, 64), (100, 7, 129), (40, 0, 40), (0, 20, 20)])
def test_strassen_equals_the_plain_product(n, k, m):
    r = np.random.default_rng(n + k + m)
    a, b = r.integers(-(2**27), 2**27, (n, k)), r.integers(-(2**27), 2**27, (k, m))
    for leaf in (1, 4, 16):
        assert (strassen(a, b, leaf) == a @ b).all()


def test_windows_are_exact():
    top = 2**62 - 1
    for s in [*range(-60, 400), top, -top, top // 3]:
        lo, hi = window(np.array([s]))
        assert lo[0] == -((-50 * s) // 100) and hi[0] == 95 * s // 100


def test_heaps_merge_in_any_order():
    r = random.Random(2)
    rows = [(r.randrange(5), r.randrange(8), r.randrange(30)) for _ in range(300)]
    want = []
    for slot in range(5):
        best = {}
        for s, score, i in rows:
            if s == slot:
                best[i] = max(best.get(i, -1), score)
        want += [(slot, v, i) for i, v in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]]
    for cut in (1, 150, 299):
        a, b = Heaps(5, 4), Heaps(5, 4)
        for h, part in ((a, rows[:cut]), (b, rows[cut:])):
            for row in part:
                h.add(*(np.array([x]) for x in row))
        b.add(a.slot, a.score, a.id)
        assert list(zip(b.slot, b.score, b.id)) == want


def plainly(rows, positives=5, negatives=3):
    good = {}
    for i, label, v, anchor in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**31 for x in v):
            continue
        good.setdefault(i, []).append((label, tuple(math.floor(256 * x) for x in v), bool(anchor)))
    out = []
    for i, copies in good.items():
        mine = sorted((c[0], c[1], len(c[1])) for c in copies if c[2])
        if not mine:
            continue
        label, v, _ = mine[0]
        like, other = {}, {}
        for j, them in good.items():
            for l, w, _ in them:
                if j != i and len(w) == len(v):
                    side = like if l == label else other
                    side[j] = max(side.get(j, -(2**70)), sum(x * y for x, y in zip(v, w)))
        for p, ps in sorted(like.items(), key=lambda x: (-x[1], x[0]))[:positives]:
            hits = {j: max(s for s in [sum(x * y for x, y in zip(v, w)) for l, w, _ in good[j] if l != label and len(w) == len(v)]) for j in other}
            hits = sorted(((s, j) for j, s in hits.items() if 50 * ps <= 100 * s <= 95 * ps), key=lambda x: (-x[0], x[1]))
            out += [(i, p, n, j, ps, s) for n, (s, j) in enumerate(hits[:negatives], 1)]
    return sorted(out)


def test_negatives_equal_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for k in range(240):
        v = [r.gauss(0.1, 0.2) for _ in range(9)] if k % 5 else [0.1] * 9
        rows.append((k, "pothole" if k % 3 else f"c{k % 4}", v, k % 12 == 0))
    rows += [(300, None, [0.1] * 9, True), (301, "pothole", None, True), (302, "pothole", [0.1] * 8 + [None], True), (303, "c1", [0.1] * 8 + [math.nan], True), (304, "c1", [math.inf] * 9, True),
             (305, "pothole", [0.2, 0.1], True), (306, "c1", [0.2, 0.05], None), (307, "pothole", [0.1, 0.1], False), (308, "c1", [], True), (None, "c1", [0.1] * 9, True), (310, "c1", [1e30] * 9, True),
             (0, "c0", [0.1] * 9, True), rows[12]]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA.replace("rank", "rank_")).repartition(5)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for sizes in ({}, {"candidates": 7, "anchors": 3, "shard_blocks": 2}):
        got = sorted(tuple(x[n] for n in names) for x in mine_hard_negatives(df, **sizes).collect())
        assert got == plainly(rows)
    assert mine_hard_negatives(df.where("false")).count() == 0 and mine_hard_negatives(df.where("not is_anchor")).count() == 0
    with pytest.raises(ValueError):
        mine_hard_negatives(df.withColumnRenamed("det_id", "negative_id"), det="negative_id")
