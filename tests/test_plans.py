"""Plan checks: operators declared native never reach Python,
no window runs without partition keys, filters reach the scan."""

import re

import pytest

from codepref.plans.catalog import QUERIES, load_all
from tests.conftest import SF_SMALL

load_all()

PYTHON_ALLOWED = {  # the Python boundary: compile check, AST normaliser, predictor, token encoder, n-gram counts, subsequences
    "a01_valid_rate", "a02_sample_rate", "a03_model_tokens", "e01_model_chunks", "a07_corpus_bleu", "a07_rouge_l", "a07_bleu", "a07_bleu_counts", "a07_rouge_n", "c03_corrupt", "c04_corrupt_compat", "c06_recheck",
    "f11_all_filters", "f11_compat", "f11_from_raw", "j01_rejected", "j01_rejected_pred", "j02_score_join", "n03_python_parts", "n04b_outermost",
    "n10_normalize", "n16_predict_stub", "n17_sanitise_predictions", "p01_dpo", "p02_kto",
    "p06_counters", "p01_dpo_compat", "st1_incremental", "v01_py_valid", "v06_fail_count",
}
NATIVE = sorted(set(QUERIES) - PYTHON_ALLOWED)


_PLANS: dict[str, str] = {}


def _plan(spark, name):
    """A query's plan, made once: several tests look at it."""
    if name not in _PLANS:
        _PLANS[name] = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    return _PLANS[name]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_stay_in_the_jvm(spark, name):
    plan = _plan(spark, name)
    assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"e05_pair_fit"}))
def test_no_window_without_partition_keys(spark, name):
    plan = _plan(spark, name)
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan):
        assert m.group(1).strip(), f"unpartitioned window in {name}"


def test_filters_reach_the_scan(spark):
    plan = _plan(spark, "f11_all_filters")
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(function_def\)", plan)
    plan = _plan(spark, "x04_split_exact")
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


@pytest.mark.parametrize("name", ["p02_kto", "p01_dpo", "x01_take", "x01_take_per_lang", "x02_skip", "x04_split_exact"])
def test_quotas_move_no_text(spark, name):
    """The rows are scanned and compared with a cutoff: no exchange, sort or window
    carries a text column."""
    plan = _plan(spark, name)
    for node in re.findall(r"(?:Exchange|Sort|Window)[^\n]*", plan):
        assert not re.search(r"\b(prompt|code|reference|text|completion|rejected|chosen)#", node), node
    assert not re.search(r"(?<!Broadcast)Exchange hashpartitioning", plan), plan


def test_sample_is_taken_before_the_check(spark):
    """A2: the Python stage reads the written sample, not the base table."""
    plan = _plan(spark, "a02_sample_rate")
    below = plan[plan.index("ArrowEvalPython"):plan.index("Union") if plan.index("Union") > plan.index("ArrowEvalPython") else None]
    assert "/tables/" in below.split("FileScan", 1)[1].split("\n", 1)[0]
