"""Documents with the odd cases that every operator has to take."""

import os

import pytest

SF = os.environ.get("FACTWEAVE_TEST_SF", "/root/testdata/sf0.001")

LONG_LINE = "This line is long enough to be counted as a boilerplate line of text"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "word"), (6, "word"), (7, "  two  spaces \t and\ttabs \n"), (8, "<|endoftext|> inside <|startoftext|>text<|endoftext|>"),
    (9, "É́ é ﬁ Ḱ İ ß ſ 中文字 😀   　 ▁▁ x"), (10, "a" * 5000), (11, "a b " * 4000), (12, f"{LONG_LINE}\nother"), (13, f"  {LONG_LINE.upper()} \nmore\n"), (14, f"{LONG_LINE}\n{LONG_LINE}"),
    (15, f"x\n{LONG_LINE}"), (16, f"{LONG_LINE}"), (17, f"y\n{LONG_LINE}\t"), (-3, "negative key"), (None, "null key"), (None, None), (18, "repeated row"), (18, "repeated row"), (18, "same key, other text"),
    (19, "Licensed under the Apache License, Version 2.0."), (20, "cc by nc cc by nc"), (21, "Released under the MIT License. under-the MIT license"), (22, "12345 !!! ..."), (23, "²½Ⅷ"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Extra columns carry names that operators use themselves."""
    rows = [(i, t, "en" if i and i % 2 else None, "src", 5, i, "w", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, words string, _gone double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
