import pytest

#: Rows that every operator over documents must take: nulls, empty and very long texts, repeats, other columns with clashing names.
LONG = "word and other words in one very long text " * 6000
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "a", 1, "x"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "a", 1, "x"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "a", 1, "x"),
    (3, None, "b", 2, "x"),
    (4, "", None, 3, None),
    (5, " \t\n\x0b ", "b", 4, "x"),
    (None, "no id here but some words so that it is a text like others are", "a", 5, "x"),
    (6, LONG, "b", 6, "x"),
    (7, "one", "b", 7, "x"),
    (8, "Grüße 😀 naïve café nbsp\nline two here\nline two here\n", "c", 8, "x"),
]
SCHEMA = "doc_id long, text string, source string, size long, shard string"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that the operators' own columns had or have.
CLASH = ["__t", "__d", "__s", "__id", "__hash", "__nth", "__part", "__n", "__keep", "key_text", "row", "T", "h", "node", "Root", "first", "size", "shard", "slot", "taken", "rounds"]


@pytest.fixture(scope="session")
def clashing(spark):
    """A table of (doc_id, text) rows with a source and one more column for each name of CLASH; its value tells rows and columns apart."""

    def make(rows, source="src"):
        data = [(*r[:2], r[2] if len(r) > 2 else source, *(f"{c}{i}" for c in CLASH)) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))

    return make
