import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, row int, bucket string, score double, component long, words string, body string, start int"


def prose(rng, n):
    return " ".join("".join(rng.choice("an be ca do en fi ga he in jo ka lo".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    import random

    rng = random.Random(5)
    long_ = prose(rng, 30_000)
    texts = [None, "", "  \n\t \x0b", "a", "one two three four five six", "one two three four five six", "Zwei  Räume.\n\nund ä ö\r\nmehr", "x" * 70_000, long_, "日本語 テキスト 😀 \x00 nul", "same line\nsame line\nother\nsame line", "*** $$$ ### %%% &&& ||| <> " * 30, "STOP!! NOW!! " * 60, "word " * 300]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "en", "s1", 27), (4, texts[4], "en", "s1", 27), (None, "text without an id here it is", None, None, None), (None, None, None, None, None), (50, prose(rng, 120), None, None, None), (51, prose(rng, 80), "fr", "ä", 1)]
    return [(*r, 1, 2, "b", 0.5, 3, "w", "x", 4) for r in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows, with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def corpus(spark):
    """500 documents of the small table and their labels."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
