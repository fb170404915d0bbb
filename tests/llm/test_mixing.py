"""Targets, rates and copies against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from caseweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, h long, n long, number string"


@pytest.fixture(scope="module")
def sourced(spark, tmp_path_factory):
    from caseweave.llm.common import prepared

    def make(rows):
        path = str(tmp_path_factory.mktemp("mix") / "documents.parquet")
        prepared(spark).createDataFrame([(i, t, s, 1, 2, 3, "x") for i, t, s in rows], SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    """Deal by weight, stop at twice the source, deal the excess again."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += words(t)
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    got, left, still = dict.fromkeys(order, 0.0), 1.5 * sum(size.values()), [s for s in order]
    while still and left > 1e-9:
        share = left / sum(weight[s] for s in still)
        over = 0.0
        for s in still:
            got[s] += weight[s] * share
            over += max(0.0, got[s] - 2 * size[s])
            got[s] = min(got[s], 2.0 * size[s])
        still, left = [s for s in still if got[s] < 2 * size[s]], over
    return size, got


def rates(sizes, target, steps=200):
    """Bisection on the multiplier of one source."""
    if target <= 0:
        return [0.0] * len(sizes)
    if target >= 2 * sum(sizes):
        return [2.0] * len(sizes)
    mean = sum(sizes) / max(1, sum(s > 0 for s in sizes))
    low, high = -500.0, 500.0
    rate = lambda m: [min(2.0, math.exp(max(-700.0, min(2.0, m * s / mean)))) for s in sizes]
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(r * s for r, s in zip(rate(mid), sizes, strict=True)) < target else (low, mid)
    return rate((low + high) / 2)


def corpus(seed, n):
    rng = random.Random(seed)
    pick = ["b", "a", None, "", "zß", "Z", "日本", "big"]
    rows = []
    for i in range(n):
        k = int(rng.lognormvariate(3, 1.2))
        rows.append((i, " ".join(rng.choice(["x", "yy", "z"]) for _ in range(k)), "big" if rng.random() < 0.4 else rng.choice(pick)))
    return rows


ODD = [(1, None, "a"), (1, None, "a"), (None, "one two\tthree\n four", None), (2, "", "only empty"), (3, "a b c " * 20_000, "long"), (4, "same", "b"), (4, "same", "b"), (4, "same", "b"), (5, "a\x1cb \x0b c\x85d", "b")]


@pytest.mark.parametrize("rows", [corpus(1, 600), corpus(2, 40) + ODD, ODD])
def test_mix(sourced, rows):
    out = mixing.mix(sourced(rows)).collect()
    size, goal = targets(rows)
    want = Counter((i, words(t), size[s]) for i, t, s in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in out) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2) for r in out)
    of = {}
    for i, t, s in rows:
        of[i, words(t)] = s
    taken, told = Counter(), {}
    for r in out:
        s = of[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        told[s] = r["target"]
    for s in size:
        assert told[s] == pytest.approx(goal[s], abs=1e-6) and abs(taken[s] - goal[s]) <= 0.5 + 1e-6
    # Whole copies follow the rates: sorted by size, their running sum is never a copy away.
    for s in size:
        mine = sorted((words(t) for _, t, x in rows if x == s))
        copies = Counter()
        for r in out:
            if of[r["doc_id"], r["size"]] == s:
                copies[r["size"]] += r["copies"]
        expected = Counter()
        for k, r in zip(mine, rates(mine, goal[s]), strict=True):
            expected[k] += r
        run = 0.0
        for k in sorted(expected):
            run += copies[k] - expected[k]
            assert abs(run) <= 0.6


def test_mix_again(sourced, spark):
    rows = corpus(3, 300) + ODD
    one = mixing.mix(sourced(rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = mixing.mix(sourced(rows[::-1])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))


def test_nothing_to_mix(sourced):
    assert mixing.mix(sourced([])).count() == 0
    assert [tuple(r) for r in mixing.mix(sourced([(1, " ", "a"), (2, None, None)])).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2
