from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that helpers inside the operators use too.
CLASHES = "row long, salt string, _key string, fp string, size long, h string, kept int, component_id string, _c0 string, block string"


def frame(spark, rows, clash=False):
    """Documents (doc_id, text, source) as a table, with clashing extra columns if asked for."""
    full = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
    if not clash:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([r + (1, "x", "x", "x", 7, "x", 1, "x", "x", "x") for r in full], f"{SCHEMA}, {CLASHES}")


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(30), text(9000)
    rows = [(k, text(rnd.randint(1, 60)), f"s{k % 3}") for k in range(40)]
    rows += [(100, "", "s0"), (101, None, "s1"), (102, " \n\t", None), (None, text(5), "s1"), (None, None, None), (103, long, "s2"), (104, long, "s2"), (105, long + " end", "s2")]
    rows += [(110 + k, f"{text(4)} {shared} {text(4)}", "s0") for k in range(6)]
    rows += [(120, "Same  Text", "s0"), (121, "SameText", "s0"), (122, "Same Text ", "s1"), (123, "same text", "s1"), (124, "Same\nText  ", "s1")]
    rows += [(130, rows[0][1], "s0"), (130, rows[0][1], "s0"), (131, "é ü 日本 " * 30, "s1"), (132, "x" * 300, "s1"), (133, "y" + "x" * 299, "s1")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def odd_clash(spark):
    return frame(spark, odd_rows(), clash=True)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
