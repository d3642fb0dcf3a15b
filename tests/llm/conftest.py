"""Rows that every operator and every stage must bear."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, root string, found int, text_hash string, spans int, `key` int"


def _row(i, text, lang="en"):
    return (i, text, lang, None if i is None else "s", None if text is None else len(text), 7, "x", "r", 1, "h", 2, 3)


@pytest.fixture(scope="session")
def edge(spark):
    """Null id, null and empty texts, a very long text, ties, repeated rows, white space alone, odd characters, clashing columns."""
    long_ = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    rows = [_row(1, "The same text, more than once."), _row(1, "The same text, more than once."), _row(2, "The same text, more than once."), _row(3, None), _row(4, ""), _row(5, "  \n\t "), _row(None, "No id here at all."), _row(6, long_), _row(7, "a"), _row(8, "Ünïcödé ΑΒΓ текст 文字 \x00\x1c\x1f end", None), _row(9, "A" * 500), _row(10, "write to a.b@c.org now")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (7, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "word0 and0 word1 and1 word2 and2 word3 and3 word4 and4 word5 and5"), (2, None), (3, ""), (4, "same text"), (5, "!!")], "item_id long, text string")


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
