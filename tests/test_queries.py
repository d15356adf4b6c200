"""Registered queries against their SQL. By default a few per module; RULESPAN_ALL=1 runs all of them."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
from verify import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = (
    "strict_pass_rate", "check_dispatch", "stream_checks", "sentence_split", "normalize", "conflict_pairs", "run_metrics",
    "selective_round", "split_iid", "split_atomic", "cluster_length_sample", "pass_rate_grouping_sets", "chi_square",
    "tfidf", "mlm_mask", "label_build",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("RULESPAN_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    verdict = compare(got, con.sql(entry.oracle_sql()[name]).df())
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
