"""Every catalog query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

from prismcat.plans import catalog_queries, job_queries, review_queries, scan_queries, store_queries, text_queries  # noqa: F401
from prismcat.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"video_vote_edges", "constraint_violations"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert (check(spark, con, QUERIES[name], ORACLE_SQL[name], SF) if name in ORACLE_SQL else QUERIES[name](spark, SF).count()) > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("prismcat.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
