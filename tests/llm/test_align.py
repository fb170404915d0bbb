"""Alignment against comparing all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from caseweave.llm import align

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SAMPLES = [
    (11, "<s> </s> <|endoftext|> <unk> <0x41>"),
    (12, "a▁b is not given back"),
    (13, "日本語のテキスト と español,\tcafé\n\n  \x00 über"),
    (14, " " * 12_000 + "x"),
    (15, "same words same words"),
    (16, "same words same words"),
    (17, "👩‍👩‍👧 🇫🇷 ﬁ ǅ ​"),
]


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def both_sides(text):
    """Ids and bytes of the tokens of both sides, by the libraries and the definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    letters = {c: b for b, c in align.BYTE_LETTERS.items()}
    a = t.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    b = sp.encode(text)
    pieces = [sp.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    return a, spans(map(len, a_bytes)), b, spans(map(len, b_bytes))


def expected(texts):
    sides = [both_sides(t) for t in texts]
    linked, held = [], Counter()
    for s in sides:
        # A document's spans are short enough to compare each with the few that can touch it.
        pairs = [(x, y) for x, (i, j) in zip(s[0], s[1], strict=True) for y, (k, m) in zip(s[2], s[3], strict=True) if i < m and k < j] if s else []
        linked.append(pairs)
        held.update(set(pairs))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for s, pairs in zip(sides, linked, strict=True):
        if s is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, sa, b, sb = s
        common = sorted({j for _, j in sa} & {j for _, j in sb})
        groups, lo = [], 0
        for hi in common:
            groups.append(",".join(str(x) for x, (i, j) in zip(a, sa, strict=True) if lo <= i and j <= hi) + "|" + ",".join(str(y) for y, (i, j) in zip(b, sb, strict=True) if lo <= i and j <= hi))
            lo = hi
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), digest))
    return out


@pytest.mark.parametrize("block_pairs", [align.BLOCK_PAIRS, 60])
def test_alignment(stored, odd, block_pairs):
    rows = [(i, t if t is None or len(t) < 5000 else t[:1500]) for i, t in odd] + SAMPLES
    got = align.alignment(stored(rows), BYTES, PIECES, block_pairs=block_pairs).collect()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((i, *x) for (i, _), x in zip(rows, expected([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == want


def test_groups(stored, odd):
    for r in align.aligned(stored(odd + SAMPLES), BYTES, PIECES).collect():
        assert len(r["a_ends"]) == len(r["b_ends"]) and (not r["a_ids"] or (r["a_ends"][-1], r["b_ends"][-1]) == (len(r["a_ids"]), len(r["b_ids"])))


def test_links_of_random_cuts():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 60)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in range(2))
        if rng.random() < 0.3:
            b = list(a)
        starts = [0, *a], [0, *b]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        assert list(zip(*align.links(a, b), strict=True)) == want


def test_a_worker_uses_ranks_that_equal_the_library():
    both = align.Pair(BYTES, PIECES)
    marks = [chr(c) for c in [*range(0x20, 0x300), 0x85, 0x2028, 0x3000, 0x1680, 0x10FFFF, 0x1F600, 0x663, 0x2167, 0xA66E]]
    texts = [f"a{c}1 {c}{c}b  {c}" for c in marks] + ["it's DON'T we've", "x  \n\n y", "<|endoftext|>"]
    assert all(both.a_ids(t) == both.library.encode(t, add_special_tokens=False).ids for t in texts)


def test_no_documents(stored):
    assert align.alignment(stored([]), BYTES, PIECES).count() == 0
