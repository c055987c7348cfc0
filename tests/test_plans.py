"""Plans that would hold on a large cluster, and streams that equal their batch form."""

import pytest
from pyspark.sql import functions as F

from merchlens.operators import content
from merchlens.operators.search import build_index
from merchlens.session import scratch_path
from merchlens.streaming import folds
import registry.all  # noqa: F401
from registry.core import QUERIES
from registry.roles import Data
from tests.conftest import SMALL, answers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in QUERIES if not n.startswith(("stream_", "bm25", "fallback", "search_index_inc", "load_csv", "cart_", "processing"))]


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(QUERIES[name](spark, SMALL)) for name in LAZY}


def test_no_query_pairs_everything(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_python_only_where_declared(plans):
    declared = ("vector_", "similar_", "batch_infer")
    for name, text in plans.items():
        python = any(word in text for word in ("PythonUDF", "InPandas", "InArrow", "BatchEvalPython"))
        assert not python or name.startswith(declared), name


def test_windows_have_partitions(plans):
    for name, text in plans.items():
        for line in text.splitlines():
            if "Window [" in line and name != "category_scorecard":
                assert not line.rstrip().endswith("[], [], []"), name


def test_columns_and_filters_reach_the_files(spark):
    text = plan(QUERIES["dash_revenue"](spark, SMALL))
    assert "o_totalprice" in text.split("ReadSchema")[1] and "o_orderpriority" not in text
    text = plan(QUERIES["vq_review_summary"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in text


def test_filter_on_content_type_drops_the_other_branches(spark):
    d = Data(spark, SMALL)
    every = content.label_search_content(d.products, d.ingredients, d.warnings)
    one = plan(every.filter("content_type = 'warning'"))
    assert "Union" in plan(every) and "Union" not in one


def test_facts_shrink_before_they_meet_products(spark):
    text = plan(QUERIES["dash_top_rated"](spark, SMALL))
    join = text.index("Join")
    assert "HashAggregate(keys=[l_partkey" in text[join:] or "HashAggregate(keys=[product_id" in text[join:]


def test_facts_of_distinct_metrics_shrink_first(plans):
    for name in ("mv_social", "mv_variant", "mv_trending", "mv_inventory", "mv_social_by_brand", "orders_by_customer"):
        lines = plans[name].splitlines()
        for i, line in enumerate(lines):
            if "Join" in line and "LeftOuter" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                below = [x for x in lines[i + 1 :] if len(x) - len(x.lstrip(" :+-")) > depth]
                assert any("HashAggregate" in x or "SortAggregate" in x for x in below), (name, line)


def test_index_stream_sees_late_files_once(spark, rows):
    docs = rows("id long, text string", *[(i, f"w{i % 4} w{i % 3} x") for i in range(20)])
    path, sink, checkpoint = scratch_path(spark, "docs"), scratch_path(spark, "index"), scratch_path(spark, "check")

    def run():
        folds.stream_index(spark.readStream.schema(docs.schema).parquet(path), "id", "text", sink, checkpoint).awaitTermination()

    docs.filter("id < 12").write.parquet(path)
    run()
    run()
    docs.filter("id >= 12").write.mode("append").parquet(path)
    run()
    want = build_index(docs, "id", "text")
    assert answers(spark.read.parquet(f"{sink}/postings").drop("batch")) == answers(want.postings)
    assert answers(spark.read.parquet(f"{sink}/docs").drop("batch")) == answers(want.docs)
