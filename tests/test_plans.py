"""Physical-plan properties the design relies on."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from support import SF_SMALL

RELATIONAL = ["rel_count", "rel_count_filtered", "rel_select_price", "rel_join_count", "rel_workload",
              "returns_by_store", "returns_by_store_correlated", "frequent_items", "max_customer_sales", "best_customers",
              "final_cross_channel", "outer_to_inner_equiv", "split_counts", "user_item_counts",
              "anti_subtract", "top_items_per_customer", "labelled_point_parse", "delimited_parse",
              "java_hash_code", "split_stats", "covariance", "tfidf_terms", "binary_range_bucket",
              "review_ratings", "page_corpus", "event_log_summary", "run_report"]


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(E.queries()["returns_by_store"](spark, SF_SMALL))
    assert "EqualTo(l_returnflag,R)" in p
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01T00:00)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_returnflag:string>" in p


def test_top_n_is_limited_before_the_shuffle(spark):
    p = plan(E.queries()["top_items_per_customer"](spark, SF_SMALL))
    assert p.count("WindowGroupLimit (") >= 2
