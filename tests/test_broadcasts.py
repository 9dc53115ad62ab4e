"""Joins whose exploded side Spark takes for small: none may be broadcast, whatever the sizes on disk."""

import corpus_pipeline
import pytest

from lattica.llm import simhash
from lattica.operators import graph, grid, joins, mesh, regions, walls
from lattica.plans import catalog, pipelines
from lattica.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_fingerprints_are_not_broadcast(spark):
    fps = materialize(spark.range(1000).withColumnRenamed("id", "fp"), "fps")
    text = plan(simhash.fingerprint_links(fps))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_probes_of_cells_are_not_broadcast(spark):
    rows = spark.range(1000).selectExpr("id AS point_id", "id * 0.01D AS x", "id * 0.02D AS y", "id * 0.03D AS z")
    points = materialize(rows, "points")
    for df in (joins.radius_pairs(points, 0.1), joins.range_pairs(points, points, "x", 0.1)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def exploded_and_broadcast(text):
    """Whether a broadcast in a plan holds exploded rows."""
    depth = None
    for line in text.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if "BroadcastExchange" in line and depth is None:
            depth = at
        if depth is not None and "Generate" in line:
            return True
    return False


@pytest.mark.parametrize("name", ["path_to_door", "interior_triangles"])
def test_queries_broadcast_no_exploded_rows(spark, monkeypatch, name):
    seen = []

    def noted(df, *args):
        seen.append(plan(df))
        return materialize(df, *args)

    for module in (graph, grid, joins, mesh, regions, walls, pipelines):
        monkeypatch.setattr(module, "materialize", noted, raising=False)
    seen.append(plan(catalog.queries()[name](spark, "/root/testdata/sf0.001")))
    assert any("Generate" in text for text in seen) and not any(map(exploded_and_broadcast, seen))


@pytest.mark.parametrize("query", ["regions_min_size", "hull_enlarged", "regions_large", "roof_filter"])
def test_points_meet_the_labels_of_cells_in_a_shuffle(spark, query):
    """The labels are small on disk, but not in memory; only hot ones, which are few, are broadcast."""
    text = plan(catalog.queries()[query](spark, "/root/testdata/sf0.001"))
    broadcasts = [line for line in text.splitlines() if "BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint" in line and "input[1, bigint" in line and "input[2, bigint" in line]
    assert 0 < len(broadcasts) == 2 * text.count("LeftAnti")


def test_near_dedup_stage_broadcasts_no_exploded_rows(spark, monkeypatch):
    """The third stage of the pipeline, whose 31 tables of fingerprints the driver once collected."""
    seen = []

    def noted(df, *args):
        seen.append(plan(df))
        return materialize(df, *args)

    monkeypatch.setattr(simhash, "materialize", noted)
    monkeypatch.setattr(graph, "materialize", noted)
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen.append(plan(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir)))
    assert any("Generate" in text for text in seen) and not any(map(exploded_and_broadcast, seen))


def test_near_dedup_stage_shuffles_what_grows_with_the_documents(spark, monkeypatch):
    """Roots and heads, one for each document that stays, are small on disk only; just hot groups are broadcast."""
    seen = {}

    def noted(df, label):
        seen[label] = plan(df)
        return materialize(df, label)

    monkeypatch.setattr(simhash, "materialize", noted)
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = plan(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir))
    labelled = plan(simhash.near_duplicates(docs))
    assert "SortMergeJoin" in seen["rooted"] and "BroadcastHashJoin" not in seen["rooted"]
    assert "SortMergeJoin" in kept and "BroadcastHashJoin" not in kept
    for text in (seen["heads"], seen["labels"], labelled):
        assert "SortMergeJoin" in text and text.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("query", ["hull_enlarged", "regions_large", "roof_filter"])
def test_points_carry_what_is_needed_to_their_labels(spark, query):
    """No join by the ids of points, whose one side may be broadcast, and none of all labels with the sizes of regions."""
    text = plan(catalog.queries()[query](spark, "/root/testdata/sf0.001"))
    joins_by_id = [line for line in text.splitlines() if "Join [point_id" in line or query != "hull_enlarged" and "Join [region_id" in line]
    assert "Join [" in text and not joins_by_id


def test_ends_of_cells_are_not_broadcast(spark, monkeypatch):
    """Six points a cell, which take a small part of their size in memory on disk."""
    seen = {}

    def noted(df, label):
        seen[label] = plan(df)
        return materialize(df, label)

    monkeypatch.setattr(joins, "materialize", noted)
    monkeypatch.setattr(regions, "materialize", noted)
    rows = spark.range(1000).selectExpr("id AS point_id", "id * 0.01D AS x", "id * 0.02D AS y", "id * 0.03D AS z")
    regions.regions(materialize(rows, "points"), 0.1)
    for label in ("pairs", "open", "asked"):
        assert "SortMergeJoin" in seen[label]
    assert "BroadcastHashJoin" not in seen["pairs"] + seen["open"]
    assert "SortMergeJoin [head" in seen["labels"]
