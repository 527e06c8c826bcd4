import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names the operators use inside
CLASHING = "size string, target string, fp string, doc string, shard string, start long, word string, score string"


def documents(spark, rows, extra=False):
    rows = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
    if extra:
        return spark.createDataFrame([(*r, "s", "t", "f", "d", "h", 1, "w", "x") for r in rows], f"{DOCS}, {CLASHING}")
    return spark.createDataFrame(rows, DOCS)


LONG = "the cat sat on a mat and saw the dog run far away " * 3000
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\r", "en", None), (None, "no id here, but words", None, "b"),
    (None, None, None, None), (4, "one", "fr", "a"), (5, LONG, "en", "a"), (6, "x" * 200_000, "en", "b"),
    (7, "1" * 50_000 + " " + "1-" * 30_000, "en", "b"), (8, "same text in two rows\nand a line", "en", "c"),
    (8, "same text in two rows\nand a line", "en", "c"), (9, "same text in two rows\nand a line", "de", "c"),
    (10, "été \U0001f600 ß İ mail me@x.org now", "fr", "é"), (11, "#" * 70_000 + "a", None, "z"), (12, "\n\n\n", "es", "z"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE, extra=True)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
