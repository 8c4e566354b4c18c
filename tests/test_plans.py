"""Plan shape: pushdown, no single-partition windows on facts, top-k,
partial aggregation, no cartesian products."""

import re

import pytest

from __spark_entry__ import queries
from salesledger.operators import sales as S
from salesledger.operators.dedup import keep_first
from salesledger.plans import adapters as A
from tests.plans import plan_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def qs():
    return queries()


def test_no_cartesian_or_nested_loop_anywhere(spark, qs):
    for name, fn in qs.items():
        plan = plan_text(fn(spark, SF))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_no_single_partition_window_over_facts(spark, qs):
    for name in ("sales_clean", "sales_first_line_per_order", "sales_quality_metrics", "ledger_batch_update"):
        plan = plan_text(qs[name](spark, SF))
        assert "Window" not in plan, name


def test_dedup_is_partial_aggregate(spark):
    plan = plan_text(keep_first(A.sales_lines(spark, SF, with_seq=True), "order_id", ["row_seq"]))
    assert re.search(r"partial_min", plan)


def test_top_products_is_take_ordered(spark):
    plan = plan_text(S.top_products(A.sales_lines(spark, SF)))
    assert "TakeOrderedAndProject" in plan


def test_lookup_pushes_filter_and_prunes(spark, qs):
    plan = plan_text(qs["ledger_lookup"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,42)]" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double,props:string>" in plan


def test_regional_share_reads_facts_once(spark, qs):
    plan = plan_text(qs["sales_regional_share"](spark, SF))
    assert plan.count("orders.parquet") == 0  # frozen grouped rows, no fact rescan in the subquery


def test_line_rows_shuffle_twice_when_nothing_is_broadcast(spark):
    # as at scale, where orders, customer and part are too large to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(A.sales_lines(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    line_keys = sorted(k for k in keys if k.startswith("l_"))
    assert line_keys == ["l_orderkey", "l_partkey"], keys


def test_first_line_dedup_reuses_the_order_join_partitioning(spark, qs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(qs["sales_first_line_per_order"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    # line rows are shuffled once, by order key; the dedup adds no shuffle
    assert sorted(k for k in keys if k.startswith("l_")) == ["l_orderkey", "l_partkey"], keys
    assert "order_id" not in keys
