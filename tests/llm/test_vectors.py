"""Vector search ships images by shuffles alone."""
import numpy as np
import pytest

from helixspan.llm import balltree, hnsw


@pytest.mark.parametrize("method", ["balltree", "hnsw"])
def test_no_image_is_broadcast(spark, method):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=3 + i % 2).tolist()) for i in range(400)], "vec_id bigint, embedding array<double>").repartition(2)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    if method == "balltree":
        out = balltree.top_k(balltree.scaled(rows), k=4, shard_rows=150, block_rows=8)
    else:
        out = hnsw.top_k(rows, k=4, shard_rows=150, block_rows=8)
    assert out.count() == 20 * 4
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert len(plans) > 4 and not any("BroadcastExchange" in p for p in plans)
