"""Queries against the SQL oracle on the smallest data; the full run is
``python -m checks.compare /root/testdata/sf0.01``."""

from pathlib import Path

import pytest

from checks import compare, oracle
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
QUICK = [
    "ingest_json", "dedup_latest", "parse_date", "strip_quotes", "assign_period", "assign_period_equal",
    "log_histogram", "union_entries", "repair_orphans", "next_stance", "direct_replies_by_stance",
    "all_replies_by_stance", "parent_stance", "thread_closure", "ancestors", "f2_training", "f3_training",
    "top_clusters", "top_terms_per_doc", "clean_tokens", "nb_tokens", "doc_term_counts", "cosine_distance",
    "k_medoids_round", "density_clusters", "distinct_vectors", "vector_transition", "majority_collapse",
]


@pytest.fixture(scope="module")
def connection():
    if not Path(SF).exists():
        pytest.skip("no test data")
    return compare.connect(SF)


@pytest.mark.parametrize("key", QUICK)
def test_query_equals_sql(spark, connection, key):
    ours = compare.spark_rows(QUERIES[key](spark, SF))
    theirs = compare.sql_rows(connection, oracle.statements()[key])
    assert ours[1]
    assert compare.difference(ours, theirs) is None


def test_every_statement_has_a_query():
    assert set(oracle.statements()) <= set(QUERIES)
