"""Frames that every text operator must take: nulls, blanks, long texts, copies, clashing columns."""

import pytest

LONG = " ".join(f"wort{i % 977} and{i % 13}" for i in range(30_000))
PROSE = "The quick brown fox walked over the hill and saw the river, the trees and the small houses."


def rows():
    texts = [None, "", " \t\n ", "a", "Ä ö. 中文", LONG, PROSE, PROSE, PROSE + " Indeed.", "?! ... 12 34\x00\x1f"]
    found = [(i, t, "en", "s", 7) for i, t in enumerate(texts)]
    found += [(None, PROSE, None, None, None), (None, None, None, None, None), (6, PROSE, "en", "s", 7)]
    found += [(20, "x", "fr", "s", 1), (20, "other words of another text " * 3, "fr", "s", 1)]
    return found


@pytest.fixture(scope="session")
def edge(spark):
    """Columns of ``documents`` and others whose names operators use themselves."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "score double, kept boolean, fp long, root long, n_words string, label int, hit int, __salt int, count long"
    return spark.createDataFrame([(*r, None, True, 1, 2, "w", 3, 4, 5, 6) for r in rows()], f"{ddl}, {clash}")


@pytest.fixture(scope="session")
def labels(spark):
    found = [(i, i % 2, (i + 1) % 2) for i in range(10)] + [(None, 1, 1), (5, None, None), (6, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    found = [(1, PROSE), (1, PROSE), (2, "short item"), (3, None), (4, ""), (None, "another text other"), (5, "...")]
    return spark.createDataFrame(found, "item_id long, text string")


def same_rows(df, want):
    return sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want), key=repr)
