from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, row int, size string, ids string"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A table of ``(doc_id, text)`` rows, written as Parquet, with more columns whose names operators use inside."""
    from caseweave.llm.common import prepared

    def make(rows, schema=DOCS):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        if schema == DOCS:
            rows = [(i, t, "en", "s", None if t is None else len(t), 1, 2, "x", "y") for i, t in rows]
        prepared(spark).createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


LONG = "Ab cd's éß 12,  ..\n\n" * 400 + "z" * 3000 + " \t " * 50 + "日本 text. " * 300
ODD = [
    (1, "The quick brown fox jumps over the lazy dog, it's 3.14!"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "same text here for two"),
    (6, "same text here for two"),
    (6, "same text here for two"),
    (None, "no id at all"),
    (-7, "<|endoftext|> É été İ ǅ"),
    (2**40, " \n\t "),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
