"""Registered queries against their SQL, on the smallest tables; without the tables they are skipped."""

import os

import pytest

import __spark_entry__ as entry
from causeway.plans.catalogue import ORACLE_SQL, QUERIES
from oracle import connect, difference

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not there")
#: Queries whose graphs need several rounds; the others run in seconds.
SOME = [
    "keyword_match", "degree_stats", "paths_forward", "cycles", "rank_paths", "mechanisms", "completeness", "load_edges", "from_legacy", "validate_edges", "merge_edges", "node_layer", "node_layer_alt", "required_layers",
    "normalize_units", "constraints", "extract_json", "kv_pairs", "route_forward", "cosine_topk", "diversity", "gaps", "compare", "eval_join", "judge_summary", "lit_dedupe", "leaderboard", "interpolate", "answer_metrics", "task_grid",
    "prompts", "responses", "naive_inverse", "scc_members", "pair_extremes", "nearest_node", "source_diversity", "judge_cases", "judge_records", "causal_edges", "entailment_overlap", "key_terms", "lit_search", "edge_driven_layer", "search_queries", "node_samples",
]


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, TABLES), con, ORACLE_SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
