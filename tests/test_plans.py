"""What the physical plans of queries must and must not hold."""

import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["block_v1_bounded", "block_approx_name", "capped_examples"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith("block_") or n.endswith("_recall")])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, SF))


def test_scans_read_what_is_used(spark):
    text = plan(catalog.QUERIES["profile_source"](spark, SF))
    assert "n_chars" not in text and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text


def test_joins_are_on_keys(spark):
    text = plan(catalog.QUERIES["block_e"](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "Join" in text
