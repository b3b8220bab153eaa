"""What the plans of the large scans must look like."""

from tracewright.operators import features, hierarchy, skew
from tracewright.session import load


def plan(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(spark, hierarchy.parent_table(load(spark, data, "prov_events")))
    assert "PushedFilters: [In(etype, [EVENT_CLONE,EVENT_FORK]), IsNotNull(srcid), IsNotNull(dstid)]" in text
    assert "ReadSchema: struct<seq:bigint,srcid:bigint,etype:string,dstid:bigint>" in text


def test_profile_reads_three_columns_once(spark, data):
    text = plan(spark, skew.entity_profile(load(spark, data, "prov_events")))
    assert text.count("ReadSchema: struct<srcid:bigint,dstid:bigint,ts:bigint>") == 1
    assert "rangepartitioning(side" in text and "Python" not in text and "Arrow" not in text


def test_features_shuffle_once_after_reducing(spark, data):
    text = plan(spark, features.feature_table(load(spark, data, "prov_events"), load(spark, data, "etype_catalog")))
    assert text.count("Exchange (") == 1 and "hashpartitioning(entity_id" in text
    assert "ReadSchema: struct<srcid:bigint,etype:string,ts:bigint,byte_size:bigint>" in text


def test_no_cross_join_anywhere(spark, data):
    for df in (
        skew.entity_profile(load(spark, data, "prov_events")),
    ):
        text = plan(spark, df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
