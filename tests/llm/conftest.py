import random

import pytest

# Names that operators use inside; as columns of the input they must not matter.
CLASHES = ["k", "row", "fp", "hash", "score", "position", "ranges", "_id", "tie", "h", "n", "first", "root", "docs"]


def words(rng, n, size=4000):
    return " ".join("w%d" % int(size * rng.random() ** 2) for _ in range(n))


def awkward_rows():
    """Ids and texts: null, empty, blank, very long, repeated rows, one id twice, special strings, four-byte characters."""
    rng = random.Random(5)
    shared = words(rng, 90)
    base = words(rng, 120)
    return [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (None, words(rng, 60)), (None, None),
        (5, words(rng, 40)), (5, words(rng, 40)), (6, base), (6, base), (7, base + " changed"),
        (8, words(rng, 30) + " " + shared + " " + words(rng, 30)), (9, shared + "."), (10, "the " * 700),
        (11, "a" * 1500), (12, "x"), (13, "Ü😀 ẞé " * 90), (14, "<|endoftext|> and <|endoftext|>, don't"),
        (15, words(rng, 30_000, 10**9)), (16, "tab\tand\u00a0space\u2003  double \n\n\nlines\r\n end  "), (-3, words(rng, 55)),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, *("clash" for _ in CLASHES)) for r in awkward_rows()]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(5).persist()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def sf01():
    from pathlib import Path

    path = "/root/testdata/sf0.01"
    if not Path(path).exists():
        pytest.skip("no test tables")
    return path
