"""Documents with the awkward cases every operator of this folder must take."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, _key string, _row int, size string, score string"
PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names used inside of the operators."""
    full = [(i, t, "en", s, len(t) if t is not None else None, "x", "y", "z", 1, "w", "v") for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def awkward(spark):
    prose = " ".join(f"word{k % 37} thing{k % 11}" for k in range(120))
    rows = [
        (1, prose, "a"), (1, prose, "a"), (2, prose, "b"), (3, None, None), (None, "only one here", "a"), (None, None, None),
        (4, "", "b"), (5, " \n\t ", "c"), (6, "x", "a"), (7, "é" * 3000, "b"), (8, "long " * 60_000, "c"), (9, "A B c\nA B c\n", "c"),
        (10, "mail a.b@c.org now 10.0.0.1 or +1 (200) 555-0100, 4111 1111 1111 1111", "a"), (11, "<|endoftext|> 漢字 ñandú ½ 's", "b"),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
