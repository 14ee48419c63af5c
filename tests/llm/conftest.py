import glob
import os

import duckdb
import pytest

from longfeat.llm.queries import reach


@pytest.fixture(scope="session")
def lspark(spark):
    reach(spark)
    return spark


#: Nulls, empty and odd texts, ties, repeated rows; ids are out of order.
LINE = "The shared line that many documents hold\tin them."
PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (7, None),
    (3, ""),
    (3, ""),
    (12, "  \n\t \n"),
    (None, PASSAGE + "\n" + LINE),
    (5, PASSAGE + " tail of five\n" + LINE + "\n" + LINE.upper() + " \nshort\nshort"),
    (2, "head of two " + PASSAGE + "\n  " + LINE),
    (2, "head of two " + PASSAGE + "\n  " + LINE),
    (9, PASSAGE.replace("word30 ", "") + "\nshort\n" + LINE),
    (20, ("again " * 400 + PASSAGE + " ") * 20),
    (21, "x" * 3000 + " " * 40 + "é" * 300 + " <|endoftext|> ΣΑΣ İ don't 12,5 ## ###"),
    (22, PASSAGE),
    (23, PASSAGE.upper()),
    (24, "one two"),
    (25, "one  two"),
    (26, "\x00   \x1c   odd ▁ white"),
]
DDL = "doc_id long, text string"
CLASHING = "n_lines string, n_words string, kept string, leaks string, block string, `key` string, lang string"


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture
def odd_docs(lspark):
    """The odd rows with columns that clash with the operators' own."""
    rows = [(d, t, *["x"] * 6, None if i % 2 else "en") for i, (d, t) in enumerate(ODD)]
    return lspark.createDataFrame(rows, f"{DDL}, {CLASHING}").repartition(3)


@pytest.fixture
def no_docs(lspark):
    return lspark.createDataFrame([], f"{DDL}, {CLASHING}")


@pytest.fixture
def duck():
    def connect(root):
        con = duckdb.connect()
        for path in glob.glob(f"{root}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        return con

    return connect
