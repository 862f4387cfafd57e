import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, w string, fp long"


def _docs():
    long_line = "This one line is long enough to be counted by everyone"
    base = " ".join(f"word{i} thing{i * 7 % 31}" for i in range(60))
    texts = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en"),  # repeated row
        (3, "", "en"), (4, None, None), (None, "text of a row without an id", "en"), (None, None, None),
        (5, f"{long_line}\nsecond\n\n  {long_line.upper()}  \n", "en"), (6, f"{long_line}\nother", "en"),
        (7, f"\t{long_line}", "de"), (8, long_line, "de"), (9, long_line + "\n" + long_line, "de"), (9, "another text of nine", "de"),
        (10, "Licensed under the Apache License, Version 2.0. All rights reserved. CC-BY cc by", "en"),
        (11, "the GNU General Public License and the general public license", "en"),
        (12, base, "en"), (13, base + " end", "en"), (14, "x" * 50_000, "xx"), (15, " ".join(["again"] * 20_000), "en"),
        (16, "!!! 123 ...", None), (17, "naïve façade Ünïcode 日本語   \x00 ퟿", "fr"), (18, "one", "en"), (19, "two words", "en"),
        (20, base, "en"),
    ]
    return [(i, t, lang, None if i is None else f"s{i % 3}", None if t is None else len(t), -1, "clash", "clash", 7) for i, t, lang in texts]


@pytest.fixture(scope="session")
def nasty_rows():
    return _docs()


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
