import os

import pytest

import __spark_entry__ as entry
from graphdrift.operators import cluster_ops as C
from graphdrift.operators.snapshot_diff import current_edges, named_edges
from graphdrift.plans.runtime import Scratch, unsized
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_delivered_links_are_links_of_the_weights_that_count(spark):
    rows = [
        ("r", "1", "a", "x/b", 2, "2024-01-01"), ("r", "1", "a", "x/b", 7, "2024-01-02"), ("r", "1", " a", "x\\b", 3, "2024-01-02"),  # corrected
        ("r", "1", "a", "a", 5, "2024-01-01"), ("r", "1", "a", "gone", 5, "2024-01-01"), ("r", "1", "gone", "a", 5, "2024-01-01"),
        ("r", "1", "c", "a", None, None), ("r", "1", "c", "x/b", 4, None), ("r", "1", "a", " ", 9, None), ("r", "2", "a", "x/b", 9, None),
    ]
    stored = spark.createDataFrame(rows, "repo_id string, commit_hash string, from_module string, to_module string, weight bigint, at string").withColumn("delivered_at", F.to_timestamp("at"))
    at = F.concat_ws("@", "repo_id", "commit_hash").alias("snapshot_id")
    members = spark.createDataFrame([("r@1", "a", "A"), ("r@1", "c", "A"), ("r@1", "x/b", "B")], "snapshot_id string, module_name string, cluster string")
    got = C.delivered_links(named_edges(stored).select(at, "from_module", "to_module", "delivery"), members)
    plain = C.links(current_edges(stored).where("from_module != to_module").select(at, "from_module", "to_module", "weight"), members)
    assert got.columns == plain.columns and got.dtypes == plain.dtypes
    assert sorted(got.collect()) == sorted(plain.collect()) == [("r@1", "A", "A", 1, 1), ("r@1", "A", "B", 11, 2)]


def test_kept_frames_are_not_broadcast_by_the_size_of_their_files(spark):
    kept = Scratch(spark)
    a, b = (kept.keep(n, spark.range(300_000).withColumn(n, F.lit("the same long text in all rows"))) for n in "ab")
    plan = lambda x, y: x.join(y, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(a, b) and "Broadcast" not in plan(unsized(a), unsized(b))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["rp_bridge_rank", "rp_map_summary", "rp_overview_edges"])
def test_links_are_ranked_without_joins_of_all_edges(spark, monkeypatch, name):
    """Neither the edges nor the links of all snapshots are joined, so that none of them can be broadcast through the driver."""
    seen = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, n, df: (seen.append((n, df._jdf.queryExecution().optimizedPlan().toString())), keep(self, n, df))[1])
    assert entry.queries()[name](spark, SF).count()
    plans = dict(seen)
    assert {"members", "links", "clusters"} <= set(plans)
    assert not [n for n in ("members", "links", "ranked") if "Join" in plans.get(n, "")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_overview_edges_are_chosen_without_joins(spark):
    """What is left to run of the query has windows only, so that nothing of it goes through the driver."""
    plan = entry.queries()["rp_overview_edges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan
