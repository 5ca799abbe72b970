"""Plans are what they are meant to be: filters and columns reach the scan, no needless shuffle, no Python."""

from conftest import SF
from plexar.queries import QUERIES


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pushdown(spark):
    p = plan(spark, "scan_pushed")
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity), LessThan(l_shipdate" in p and "GreaterThan(l_quantity,45.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in p and "Exchange" not in p
    assert "StartsWith(p_type" in plan(spark, "key_prefix_scan")


def test_columns_are_pruned(spark):
    p = plan(spark, "aggregate_global")
    assert "ReadSchema: struct<text:string>" in p and "partial_count" in p


def test_top_k_is_partial(spark):
    for name in ("vector_knn_l2", "vector_knn_filtered", "order_multi", "cypher_nearest"):
        assert "TakeOrderedAndProject" in plan(spark, name), name
    assert "WindowGroupLimit" in plan(spark, "top_k_per_group")


def test_no_python_where_columns_do(spark):
    for name in QUERIES:
        if name.startswith(("vector_knn_l", "vector_dist", "filter_", "join_", "cypher_", "event_freq", "trigger_", "rule_", "percentiles")):
            p = plan(spark, name)
            assert "Python" not in p and "Pandas" not in p and "Arrow" not in p, name


def test_filters_meet_their_node_before_joins(spark):
    p = plan(spark, "cypher_hop")
    assert "GreaterThan(o_totalprice,150000.0)" in p and "EqualTo(c_mktsegment,BUILDING)" in p and "CartesianProduct" not in p
