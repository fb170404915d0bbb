"""The trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, path string, ts long"


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    from caseweave.llm.common import prepared

    def make(rows):
        path = str(tmp_path_factory.mktemp("talk") / "conversations.parquet")
        prepared(spark).createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()), (role or "", text or "")))
    said = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, t in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(said.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def talks(seed, n, length=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 4 * n), n):
        for t in range(rng.randint(1, length)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "yes", "é" * 9, None, "", "x y"])))
    return rows


ODD = [(None, 0, "user", "no id"), (7, None, "user", "first"), (7, None, "user", "first"), (7, 3, None, None), (7, -2, "", ""), (8, 5, "user", "a" * 20_000), (2**60, 1, "u", "z"), (500, 0, "us", "erx"), (501, 0, "user", "x")]
COPIES = [(c, t, "user", f"turn {t}") for c in range(1000, 1400) for t in range(7)] + [(c, 7, "user", f"own {c % 7}") for c in range(1000, 1400, 3)]
LONG = [(c, t, "user", f"t{t}" if t < 70 + c else f"t{t} of {c}") for c in (3, 40, 41, 42, 100, 201) for t in range(100 + c % 50)]


@pytest.mark.parametrize("sizes", [{}, {"segment": 8, "block_turns": 40, "hot_turns": 60}, {"segment": 16, "block_turns": 7, "hot_turns": 1000}])
@pytest.mark.parametrize("rows", [talks(1, 150) + ODD, COPIES + LONG + ODD], ids=["short", "copies"])
def test_trie(told, rows, sizes):
    got = Counter(tuple(r) for r in trie.prefix_trie(told(rows), **sizes).collect())
    want = expected(rows)
    assert got == want


def test_turnless_and_single_conversations(told):
    short = [(c, 0, "user", "only") for c in range(1, 12)]
    for rows in ([], short, short[:1], [(100, 0, "u", "x")], [(None, 0, "u", "x")]):
        assert Counter(tuple(r) for r in trie.prefix_trie(told(rows)).collect()) == expected(rows)


def test_double_array_holds_exactly_its_paths():
    rng = np.random.default_rng(3)
    for _ in range(30):
        many = int(rng.integers(2, 60))
        paths = [tuple(rng.integers(0, many, rng.integers(1, 6)).tolist()) for _ in range(80)]
        flat = np.array([c for p in paths for c in p], np.int64)
        lengths = np.array([len(p) for p in paths])
        tree = trie.DoubleArray(flat, np.cumsum(lengths) - lengths, lengths)
        known = {p[:d] for p in paths for d in range(len(p) + 1)}
        states = {(): 0}
        for p in sorted(known, key=len):
            if p:
                states[p] = int(tree.step(np.array([states[p[:-1]]]), np.array([p[-1]]))[0])
                assert states[p] > 0
        assert len(set(states.values())) == len(known)
        for p, s in states.items():
            for c in range(many):
                assert (int(tree.step(np.array([s]), np.array([c]))[0]) > 0) == ((*p, c) in known)
