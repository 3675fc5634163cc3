import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, slot string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "an", "ha", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    """Documents with every odd case: nulls, empty and long texts, copies, near copies, repeated rows, a hot source."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(5, 80)), "en", f"s{i % 4}") for i in range(60)]
    long = prose(rng, 6000)
    out += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n ", "en", None), (103, long, "en", "s1"), (104, long.replace(" ", "\n", 5) + " ", "en", "s2")]
    base = prose(rng, 120).split()
    out += [(200 + i, " ".join([*base[:i], "changed", *base[i + 1 :]]), "en", "s0") for i in range(30)]
    out += [(300 + i, out[3][1].upper() if i % 2 else "  " + out[3][1], "en", "s9") for i in range(20)]
    out += [out[0], out[0], (None, "a row without id", "en", "s0"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), "x", "y") for r in out]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
