"""Tokens, files and packing against the libraries themselves."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from caseweave.llm import bpe, packing, token_files, word_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (200, 40), (90, 10)])
def test_byte_bpe_equals_the_library(stored, odd, chunk, overlap):
    enc = bpe._encoder(RANKS, public_tokenizers.PATTERN)
    out = bpe.digests(bpe.decode(bpe.encode(stored(odd), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), RANKS)).collect()
    want = Counter()
    for i, t in odd:
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in out) == want


def test_byte_bpe_of_paragraphs_cut_at_any_place(stored):
    """Cuts that fall after a blank line, a CRLF or a space and a line end."""
    enc = bpe._encoder(RANKS, public_tokenizers.PATTERN)
    rows = [(100 * k + i, "x" * i + gap.join(["para graph."] * 40)) for k, gap in enumerate(["\n\n", "\r\n", " \n", "\n \n", " " * 30 + "\n"]) for i in range(45)]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(stored(rows), RANKS, public_tokenizers.PATTERN, chunk=120, overlap=15).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in rows}


def test_word_ids_equal_the_library(odd):
    enc = word_bpe.Encoder(WORDS, kept=5)
    texts = [t or "" for _, t in odd] + ["ﬁ ſt ΣΑΣ á x\x1cy z\x85q ...! a.. 's we've DON'T", "Été, été. ß ẞ Å ŉ"]
    special = "<|endoftext|>"
    texts += [f"a {special} b", f"A{special}B don't", special.upper(), f"é{special}'s {special}{special}", f"x <|endof\ntext|> {special}\n", "<|startoftext|>Mixed CASE text", f"{special.upper()} and {special}"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [plain_ids(t) for t in texts]


def in_order(odd):
    return sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files(spark, stored, odd, tmp_path):
    path = str(tmp_path / "tokens.orc")
    token_files.write(stored(odd), WORDS, 1, path)
    out = sorted(token_files.checked(token_files.read(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [i for i, _ in in_order(odd)]
    at = 0
    for r, (_, t) in zip(out, in_order(odd), strict=True):
        ids = np.array([*plain_ids(t), 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r["ids"][-1] for r in token_files.lookup(spark, path, [4]).collect()] == [1]


def scanned_rows(df):
    """Rows that each scan of an executed plan hands on, by the columns it reads."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    out = {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        out[tuple(sorted(leaf.schema().fieldNames()))] = leaf.metrics().apply("numOutputRows").value()
    return out


def test_a_lookup_skips_rows(spark, stored, tmp_path):
    from pyarrow import orc

    path = str(tmp_path / "many.orc")
    token_files.write(stored([(i, f"document number {i} of many") for i in range(40_000)]), WORDS, 1, path)
    files = [orc.ORCFile(f) for f in tmp_path.glob("many.orc/*.orc")]
    assert sum(f.nrows for f in files) == 40_000 and all(f.row_index_stride == 1000 and f.compression == "ZSTD" for f in files)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = token_files.lookup(spark, path, [17_123])
        read = scanned_rows(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r["doc_id"] for r in found.collect()] == [17_123]
    with_ids = {c: n for c, n in read.items() if "ids" in c}
    # Only row groups that may hold the id are read with their ids; the totals need two small columns.
    assert list(with_ids.values()) == [n for n in with_ids.values() if n <= 2000] and len(with_ids) == 1
    assert all(set(c) <= {"part", "n"} for c in read if "ids" not in c)


@pytest.mark.parametrize("length", [4096, 64])
def test_packing(stored, odd, length):
    pieces = packing.pack(stored(odd), WORDS, 2, length=length, with_ids=True)
    rows = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    flat = [x for r in rows for x in r["ids"]]
    assert flat == [x for _, t in in_order(odd) for x in [*plain_ids(t), 2]]
    at = 0
    for r in rows:
        assert r["sequence_id"] * length + r["offset"] == at and r["offset"] + r["length"] <= length
        assert r["opens"] == (r["start"] == 0) and r["closes"] == (r["start"] + r["length"] == r["doc_tokens"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["length"]
    whole = packing.sequences(pieces, length=length).collect()
    assert all(len(r["ids"]) == length for r in whole) and len(whole) == -(-at // length)


def test_empty_tables(spark, stored, tmp_path):
    none = stored([])
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, WORDS, 2).count() == 0
    token_files.write(none, WORDS, 1, str(tmp_path / "none.orc"))
    assert token_files.checked(token_files.read(spark, str(tmp_path / "none.orc"))).count() == 0
