"""Shards, personal data, fingerprints, scores and duplicates against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import fingerprint, hnsw, minhash, pii, sharding, suffix_tree, toxicity
from caseweave.llm.common import remainder
from caseweave.llm.components import components


# ------------------------------------------------------------------ sharding
def test_shards_are_even_and_stable(stored, odd):
    rows = [(10_000 + i, f"text {i}") for i in range(700)] + odd
    out = {n: sharding.assign(stored(rows), n, vnodes=16).collect() for n in (16, 17)}
    for n, got in out.items():
        count = Counter(r["shard"] for r in got)
        assert len(got) == len(rows) and set(count) == set(range(n)) and max(count.values()) - min(count.values()) <= 1
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict(rows)
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in out[16])
    before = {r["doc_id"]: r["shard"] for r in out[16]}
    moved = sum(before[r["doc_id"]] != r["shard"] for r in out[17])
    assert moved < len(rows) / 2  # a plain modulus moves 16 of 17
    assert sharding.assign(stored([])).count() == 0


def test_a_document_stays_home_while_there_is_room(stored):
    out = sharding.assign(stored([(i, "t") for i in range(400)]), 4, vnodes=32).collect()
    home = Counter(r["home_shard"] for r in out)
    for s in range(4):
        stayed = sum(r["shard"] == r["home_shard"] == s for r in out)
        assert stayed == min(home[s], 100)


# ------------------------------------------------------------------ personal data
def luhn(m):
    d = [int(x) for x in re.sub("[^0-9]", "", m)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def digits(m):
    return len(re.sub("[^0-9]", "", m))


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= digits(m) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15),
]
PARTS = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "é", "😀", "00", "7", "x@y", "..", "0001.02.3.255", "\n"]


def test_base_spans_equal_the_plain_patterns(stored):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))) for i in range(800)] + [(900, None), (901, "9" * 50_000), (902, "a" * 50_000 + "@"), (903, "1 " * 20_000)]
    got = {r["doc_id"]: r for r in pii.report(pii.detect(stored(rows))).collect()}
    for i, text in rows:
        spans = [(k, m.start(), m.end()) for k, p, f in BASE for m in (re.finditer(p, text or "") if i < 900 else ()) if f(m.group())]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k, _, _ in BASE] == [sum(s[0] == k for s in spans) for k, _, _ in BASE]


def test_cards_without_adjacent_digits(stored):
    """A separator may follow every digit; no other pair of digits in the text."""
    rows = [(i, f"pin {sep.join('4111111111111111'[:15] + last)} end") for i, (sep, last) in enumerate([(" ", "1"), ("-", "1"), (" ", "2")])] + [(3, "1 2 3"), (4, "0-" * 12 + "0")]
    docs = stored(rows)
    got = {r["doc_id"]: r for r in pii.report(pii.detect(docs)).collect()}
    for i, text in rows:
        spans = [(k, m.start(), m.end()) for k, p, f in BASE for m in re.finditer(p, text) if f(m.group())]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), text
    assert [got[i]["n_card"] for i in range(5)] == [1, 1, 0, 0, 1]
    assert docs.where("doc_id = 0").select(pii.redacted(F.col("text")).alias("t")).first()["t"] == "pin [CARD] end"


def test_added_spans_and_redaction(stored):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32 end"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "number 123-45-6789"), (5, "mail é@x a@b.c, 1.2.3.4."), (6, None)]
    out = {r["doc_id"]: r for r in stored(rows).select("doc_id", pii.redacted(F.col("text")).alias("t"), pii.spans(F.col("text")).alias("s")).collect()}
    assert out[1]["t"] == "iban [IBAN] end" and out[2]["s"] == [] and out[3]["t"] == "ssn [SSN]" and out[4]["s"] == []
    assert out[5]["t"] == "mail é@x [EMAIL], [IP]." and out[6]["t"] is None and out[6]["s"] == []
    assert out[5]["s"][0]["score"] == 1.0 and pii.detect(stored([])).count() == 0


# ------------------------------------------------------------------ fingerprints
def test_fingerprints(stored):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    rows = [(i * 3, " ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 400])))) for i in range(60)] + [(1000, None), (1001, "q" * 9000)]
    got = {r["doc_id"]: r for r in fingerprint.edited_and_next(stored(rows)).collect()}
    keys = lambda t: set(fingerprint.chunk_keys(t.encode(), fingerprint.cuts(t.encode())))
    for at, (i, text) in enumerate(rows):
        a, b = text or "", rows[(at + 1) % len(rows)][1] or ""
        q = len(a) // 4
        edited = a[: len(a) - q] + b[:q]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(a)
        assert r["fingerprint"] == fingerprint.written(keys(a)) and r["edited_fingerprint"] == fingerprint.written(keys(edited))
        assert r["near_edited"] == fingerprint.containment(keys(a), keys(edited)) and r["near_next"] == fingerprint.containment(keys(a), keys(b))
        if len(a) > 1000 and i < 1000:
            assert 0.6 < r["near_edited"] < 0.85 and r["near_next"] < 0.1
    assert fingerprint.edited_and_next(stored([])).count() == 0
    assert fingerprint.edited_and_next(stored([(1, "only one")])).first()["near_next"] == 1.0


def test_cuts_survive_a_shift():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)).encode()
    keys = lambda d: set(fingerprint.chunk_keys(d, fingerprint.cuts(d)))
    assert fingerprint.containment(keys(text), keys(b"inserted " + text)) > 0.99
    sizes = np.diff([0, *fingerprint.cuts(text)])
    assert sizes[:-1].min() >= fingerprint.LEAST and sizes.max() <= fingerprint.MOST + fingerprint.LEAST


# ------------------------------------------------------------------ toxicity
def test_toxicity_finds_marked_texts(spark, stored):
    rng = random.Random(4)
    common = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    bad = ["grumpkin", "snarfle", "bozzwit"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        w = [rng.choice(bad) if toxic and rng.random() < 0.05 else rng.choice(common) for _ in range(120)]
        rows.append((i, " ".join(w + [bad[0]] * toxic)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 5000)]
    docs = stored(rows)
    model = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.REJECT) == (i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held) and all(got[i] < toxicity.REJECT for i in (1000, 1001, 1002))
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < toxicity.REJECT}
    none = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, none).collect())


def test_toxic_dictionary_grows_with_the_toxic_vocabulary():
    rng = random.Random(8)

    def word(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    common = [word("aeioulmnrst", rng.randint(2, 8)) for _ in range(3000)]

    def texts(bad, n):
        plain = [[rng.choice(common) for _ in range(150)] for _ in range(n)]
        return [" ".join(w) for w in plain], [" ".join(w[:60] + rng.sample(bad, 15) + w[60:]) for w in ([rng.choice(common) for _ in range(150)] for _ in range(n))]

    sizes = []
    for n_bad in (20, 300):
        bad = [word("bcdfghkpvwxz", 9) for _ in range(n_bad)]
        ordinary, toxic = texts(bad, 450)
        model = toxicity.fit([(t, 0) for t in ordinary] + [(t, 1) for t in toxic])
        sizes.append(len(model.toxic))
        unseen, marked = texts(bad, 100)
        gains_of = model.gains()
        scores = model.score(np.array([toxicity.features(gains_of(t), model.threshold) for t in unseen + marked])) >= toxicity.REJECT
        assert scores[:100].sum() <= 5 and scores[100:].sum() >= 95
    # Three hundred words of eleven bytes with the blanks around them.
    assert sizes[0] < sizes[1] and sizes[1] > 300 * 9


def test_one_sample_per_id(spark, stored):
    docs = stored([(1, "b text"), (1, "a text"), (1, None), (3, "c text"), (4, "d" * 60), (None, "e text")])
    marks = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (4, 1), (None, 1), (3, 0), (9, 1)], "doc_id long, toxic int")
    rows, share = toxicity.sample(docs, marks, chars=50)
    learnt = [i for i in (1, 3, 4, 9) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(rows) == sorted((t, y) for i, t, y in ((1, "", 1), (3, "c text", 0)) if i in learnt)
    assert share == pytest.approx(np.mean([{1: 1, 3: 0, 4: 1, 9: 1}[i] for i in learnt]))


def test_nothing_is_toxic_without_toxic_examples(spark, stored):
    docs = stored([(1, "some text"), (2, None), (3, "word " * 400)])
    none = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.accepted(docs, none).count() == 3
    assert all(0 <= r["score"] < toxicity.REJECT for r in toxicity.score(docs, none).collect())


# ------------------------------------------------------------------ language model
def test_suffix_tree(stored, odd):
    rng = random.Random(6)
    rows = [(10_000 + i, " ".join(rng.choice(["A b", "c d e", "f"]) for _ in range(60))) for i in range(300)] + odd
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    count = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    got = sorted((tuple(r) for r in suffix_tree.score(stored(rows), remainder(F.col("doc_id"), 5) == 1, p_min=1e-3, block_tokens=2000).collect()), key=str)
    want = []
    for i, t in rows:
        x = tokens(t)
        want.append((i, held(i), len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    score = {r[0]: (r[6], r[5]) for r in got}
    assert all(score[i][0] > score[i][1] + 5 for i in range(10_000, 10_300))
    assert suffix_tree.score(stored([]), F.lit(False)).count() == 0


class PlainTree:
    """The tree by its definition, over dictionaries."""

    def __init__(self, texts, depth):
        runs = [[w for w in re.split(r"[ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + ["$"] for t in texts]
        self.c = Counter(w for r in runs for w in r)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.held, self.follow = Counter(), defaultdict(Counter)
        for r in runs:
            for i in range(len(r)):
                for k in range(1, depth + 1):
                    if i + 1 >= k:
                        self.held[tuple(r[i + 1 - k : i + 1])] += 1
                    if i >= k:
                        self.follow[tuple(r[i - k : i])][r[i]] += 1
        self.tree = {}
        for k in range(1, depth + 1):
            for context in [x for x in self.follow if len(x) == k and self.held[x] >= 5]:
                self.judge(context)

    def root(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def judge(self, context):
        t, n = self.held[context], {w: x for w, x in self.follow[context].items() if x >= 5}
        if not n:
            return
        shorter = {w: self.p(context[1:], w) for w in n}
        other, other_shorter = max(t - sum(n.values()), 0), max(1 - sum(shorter.values()), 1e-12)
        divergence = sum(x / t * math.log(x / t / shorter[w]) for w, x in n.items())
        if other:
            divergence += other / t * math.log(other / t / other_shorter)
        if t * divergence > (len(n) + 1) * math.log(t):
            own = {w: (x + 5 * shorter[w]) / (t + 5) for w, x in n.items()}
            self.tree[context] = own, max(1 - sum(own.values()), 1e-12) / other_shorter

    def p(self, context, w):
        if not context:
            return self.root(w)
        if context not in self.tree:
            return self.p(context[1:], w)
        own, rest = self.tree[context]
        return own[w] if w in own else rest * self.p(context[1:], w)

    def score(self, text, depth):
        r = [w for w in re.split(r"[ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w] + ["$"]
        return sum(math.log10(self.p(tuple(r[max(0, i - depth) : i]), w)) for i, w in enumerate(r))


def test_suffix_tree_scores_equal_the_plain_definition(stored):
    rng = random.Random(12)
    names = [f"W{i}" for i in range(9)]
    # What follows depends on up to four earlier words.
    after = defaultdict(lambda: rng.choices(names, k=2))

    def text(n):
        out = []
        for i in range(n):
            back = tuple(out[-rng.choice((1, 2, 4, 4)) :])
            out.append(f"rare{rng.randint(0, 400)}" if rng.random() < 0.02 else rng.choice(names) if rng.random() < 0.1 else rng.choice(after[back]))
        return rng.choice((" ", "\n", "  ")).join(out)

    rows = [(i, text(rng.randint(1, 120))) for i in range(400)] + [(400, None), (401, ""), (402, "w1 never\u00a0seen W2"), (403, "w1 " * 900)]
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    plain = PlainTree([t or "" for i, t in rows if i not in out], suffix_tree.DEPTH)
    assert {len(x) for x in plain.tree} == set(range(1, suffix_tree.DEPTH + 1))
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(stored(rows), remainder(F.col("doc_id"), 5) == 1, block_tokens=4000).collect()}
    assert got == pytest.approx({i: plain.score(t or "", suffix_tree.DEPTH) for i, t in rows}, rel=1e-9)


@pytest.mark.parametrize("bucket_windows", [40, 400, 3000])
def test_heavy_contexts_are_parted_without_a_change(stored, bucket_windows):
    """Frequent words, frequent runs of words and copies are more than one task takes."""
    rng = random.Random(13)
    names = [f"w{i}" for i in range(6)] + ["the"] * 6
    texts = [" ".join(x for _ in range(rng.randint(0, 40)) for x in ([rng.choice(names)] if rng.random() < 0.6 else ["Go", "to", "the", rng.choice(names)])) for _ in range(150)]
    texts += ["the " * 300] * 3 + ["go to the w1 " * 9] * 40 + ["rare the the seen the once", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "go to the w2"), (3, "the the w1")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    plain = PlainTree([t or "" for i, t in rows if not held(i)], suffix_tree.DEPTH)
    assert {len(x) for x in plain.tree} == set(range(1, suffix_tree.DEPTH + 1))
    got = suffix_tree.score(stored(rows), remainder(F.col("doc_id"), 5) == 1, block_tokens=1000, bucket_windows=bucket_windows).select("doc_id", "held_out", "score").collect()
    key = lambda r: (str(r[0]), r[2])
    want = sorted(((i, held(i), plain.score(t or "", suffix_tree.DEPTH)) for i, t in rows), key=key)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_the_suffix_tree_stores_each_token_once(spark, stored, tmp_path, monkeypatch):
    """Nothing is stored again for each length of context: less than four bytes a token in all."""
    monkeypatch.setattr("caseweave.session.shared_dir", lambda _: str(tmp_path))
    rng = random.Random(14)
    rows = stored([(i, " ".join(f"w{min(int(rng.expovariate(0.004)), 3000)}" for _ in range(400))) for i in range(400)])
    scored = suffix_tree.score(rows, remainder(F.col("doc_id"), 5) == 1, block_tokens=20_000).agg(F.sum("n_tokens")).first()[0]
    assert scored == 400 * 401
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 4 * scored


def test_next_token_probabilities_sum_to_one(stored):
    rows = stored([(i, "a b c a b d " * 30) for i in range(20)]).select("doc_id", "text")
    counts = rows.sparkSession.createDataFrame([(b"a", 1200), (b"b", 1200), (b"c", 600), (b"d", 600), (b"", 20)], "word binary, c long")
    tree = suffix_tree.learn(rows, counts, 3620, 5, p_min=1e-3)
    total = 3620 + 0.5 * 6
    root = {w: (c + 0.5) / total for w, c in ((b"a", 1200), (b"b", 1200), (b"c", 600), (b"d", 600), (b"", 20))}
    for context in ([b"a"], [b"a", b"b"], [b"c"], [b"zz"]):
        codes = [tree.words.get(w, 0) for w in context]
        p = [root[w] * 10 ** tree.gains(np.array([*codes, tree.words.get(w, 0)]), np.array([0]))[-1] for w in root]
        unseen = 0.5 / total * 10 ** tree.gains(np.array([*codes, 0]), np.array([0]))[-1]
        assert sum(p) + unseen == pytest.approx(1, abs=1e-6)


def test_contexts_do_not_depend_on_the_size_of_the_corpus(stored):
    """Rare words and contexts of three tokens count, however many other tokens there are."""
    rng = random.Random(11)
    rare = [f"{x} q r {y}" for x, y in (("a", "one"), ("b", "two"))]
    rows = [(i, " ".join(rng.choice(rare) for _ in range(6))) for i in range(12)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(1500))) for i in range(200)]
    docs = rows + [(5000, "a q r one"), (5001, "a q r two"), (5002, "q r one")]
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in suffix_tree.score(stored(docs), F.col("doc_id") >= 5000, block_tokens=20_000).collect()}
    assert got[5000] > got[5001] + 1 and got[5000] > got[5002] + 1


# ------------------------------------------------------------------ near duplicates
def groups_of(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == groups_of([p for p in pairs if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("counted", [False, True])
def test_signatures_estimate_weighted_similarity(counted):
    rng = random.Random(8)
    words = [f"w{rng.randrange(300)}" for _ in range(400)]
    a, b = " ".join(words), " ".join(words[:330] + words[:40] + ["new"] * 5)
    (e, v), (f, w) = minhash.weighted(a, counted=counted), minhash.weighted(b, counted=counted)
    weight = {x: min(v[i], w[list(f).index(x)]) for i, x in enumerate(e) if x in set(f)}
    exact = sum(weight.values()) / (v.sum() + w.sum() - sum(weight.values()))
    s = minhash.signatures([(e, v), (f, w)], 2000)
    assert abs((s[0] == s[1]).mean() - exact) < 0.05


@pytest.mark.parametrize("small", [24, 1])
def test_near_duplicates_equal_brute_force(stored, odd, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(90)] for _ in range(12)]
    rows = list(odd)
    for i in range(160):
        w = list(base[i % 12 if i % 3 else 0])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(w)))
    key = lambda r: (r[0] if r[0] is not None else minhash.NO_ID)
    sets = [set(minhash.runs(t or "").tolist()) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] or "") == (rows[b][1] or "") or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups_of(pairs, range(len(rows)))
    least = defaultdict(lambda: minhash.NO_ID)
    for k, r in enumerate(rows):
        least[root[k]] = min(least[root[k]], key(r))
    want = Counter((r[0], least[root[k]] if least[root[k]] != minhash.NO_ID else None) for k, r in enumerate(rows))
    docs = stored(rows)
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(root.values()))
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert minhash.near_duplicates(stored([])).count() == 0


# ------------------------------------------------------------------ vectors
def test_near_vectors_equal_brute_force(stored):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    x = np.concatenate([rng.normal(size=(600, 16)), np.repeat(centre, 8, 0) + rng.normal(size=(320, 16)) * 0.05, np.tile(centre[0], (200, 1)) + rng.normal(size=(200, 16)) * 0.03, np.tile(centre[1], (50, 1))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0, None] * 8, 1), (5004, x[0].tolist(), None), (5005, [], 0), (5006, (x[0] * 1e200).tolist(), 0), (5007, [1.0, 2.0], 0), (None, [9.0] * 16, 1)]
    docs = stored(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in hnsw.near_vectors(docs, shard=300).collect()}
    ids, v, label = [r[0] for r in rows[: len(x)]] + [5006], np.concatenate([x, x[:1]]), np.array([r[2] for r in rows[: len(x)]] + [0])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (v @ v.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    root = groups_of([(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)], ids)
    assert sum(got[i]["n_links"] != n for i, n in zip(ids, linked.sum(1), strict=True)) <= 0.01 * len(ids)
    assert sum(got[i]["component_id"] != root[i] for i in ids) <= 0.01 * len(ids)
    for i in (5000, 5001, 5002, 5003, 5004, 5005, 5007):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert len(got) == len(rows) and hnsw.near_vectors(stored([], "vec_id long, embedding array<double>, label int")).count() == 0
