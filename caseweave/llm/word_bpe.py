"""Word-wise encoding with a BPE file whose pre-tokens never span white space.

White space separates pre-tokens and is dropped, so a text's ids are the ids of its
space-separated words, one after the other.  A special token in a text has its own id, as the
library gives it by default.  Each worker keeps the ids of the words it has met
as packed integers; the tokenizers library encodes the words it meets for the first time.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_order, int_lists, map_batches, plain

# Words kept by a worker; beyond it the memory starts anew.
KEPT_WORDS = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def _stem(word: str) -> str | None:
    """The lower-case form of a word of Latin letters, which is one pre-token; ``None`` for any other word."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    if not word.isalpha() or max(word) >= "\u0250" or not is_normalized("NFC", word):
        return None
    low = word.lower()
    return low if len(low) == len(word) else None


class Encoder(dict):
    """Packed little-endian 32-bit ids of words, learnt when they are first asked for."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        # The library finds these in a text as it stands, before lower-casing, also inside a word.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.kept = kept

    def __missing__(self, word: str) -> bytes:
        """A word of Latin letters is one pre-token, which the model merges at once; so is a mark after it."""
        if word[-1] in ".,;:!?" and _stem(word[:-1]) is not None and len(word) > 1:
            ids = self[word[:-1]] + self[word[-1]]
        elif (stem := _stem(word)) is None:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif stem != word:
            ids = self[stem]
        else:
            letters = stem if stem.isascii() else stem.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
        self[word] = ids
        return ids

    def _lowered(self, text: str) -> str:
        """An ASCII text may be lowered at once, since no letter changes its ids by that, unless this could make a special token."""
        low = text.lower() if text.isascii() else text
        return text if any(s.lower() in low for s in self.special) else low

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self) > self.kept:
            self.clear()
            self[""] = b""
        split = [self._lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        return [b"".join(map(self.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ordered_ids(docs: DataFrame, path: str, end_id: int, *, packed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, start_in_part, n, ids`` in ascending document order; ``end_id`` closes each document.

    Ids of NULL documents come first; rows with the same id are ordered by a hash of their text.
    ``packed`` gives the ids as little-endian 32-bit integers in one binary value.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(path), 0
        for b in batches:
            raw = [x + end for x in enc.encode(b.column("text").to_pylist())]
            starts = at + np.cumsum([0, *(len(x) >> 2 for x in raw)])
            at = int(starts[-1])
            ids = pa.array(raw, pa.binary()) if packed else int_lists([np.frombuffer(x, "<u4") for x in raw])
            columns = [b.column("doc_id"), b.column("part"), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "n", "ids"])

    rows = in_order(plain(docs, id_col, text_col)).select("doc_id", "part", "text")
    return map_batches(rows, encoded, f"doc_id long, part int, start_in_part long, n long, ids {'binary' if packed else 'array<int>'}")
