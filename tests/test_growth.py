"""What a task holds does not grow with the input, and what is dear is made once: seen in the plans."""

from __future__ import annotations

import re

import pytest
from conftest import SF

from sightline.operators import gates
from sightline.plans.queries import QUERIES
from sightline.scratch import spread


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_counts_rows(spark):
    rows = spark.range(95)
    assert spread(rows, 95, "id", each=10).rdd.getNumPartitions() == 10
    assert spread(rows, 0, "id").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", ["io7_exif_ingest", "d1_metadata", "d4_input_classes", "a1_image_quality", "j3_cosine_pairs", "j10_shared_tracks", "j11_pixel_deltas", "io11_extraction", "sc2_artifact_keys"])
def test_tasks_by_rows(spark, monkeypatch, name):
    if name == "j3_cosine_pairs":
        from sightline.plans import pair_queries

        monkeypatch.setattr(pair_queries, "scratch", lambda df, label: df)
    # by a key: the tables of rasters and metadata are dealt out by turns besides, whatever their rows
    assert re.search(r"(hashpartitioning\(|SinglePartition)[^\n]*REPARTITION_BY_NUM", plan_of(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["g1_scene_clusters", "g6_components", "s1_merged_candidates", "d11_scene_relations"])
def test_pairs_are_compared_once(spark, monkeypatch, name):
    from sightline.operators import pairs

    calls = []
    monkeypatch.setattr(pairs, "cosine_neighbours", lambda *a, f=pairs.cosine_neighbours, **b: calls.append(1) or f(*a, **b))
    assert "InArrow" not in plan_of(QUERIES[name](spark, SF)).replace("MapInArrow", "") and len(calls) == 1


def test_keys_and_orders_are_made_once(spark):
    assert "sha2" not in plan_of(QUERIES["io18_find_by_key"](spark, SF))
    assert plan_of(QUERIES["sc2_artifact_keys"](spark, SF)).count("schema_version") == 1
    assert "o_orderkey" not in plan_of(QUERIES["g5_route_graphs"](spark, SF))


def test_unknown_members_equal_none(spark):
    table = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    found = gates.membership_problems(table("a", "a", "b", None), table("b", "b", "c", None), ["k"]).collect()
    assert sorted((r.k or "", r.problem) for r in found) == [("", "missing"), ("", "unexpected"), ("a", "missing"), ("b", "repeated"), ("c", "unexpected")]
