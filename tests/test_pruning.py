"""Probed cells prune a stored index, whether they go in as literals or as a joined list."""

import pytest

from nearfield.operators import ann
from nearfield.plans import vectors
from nearfield.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("literals, mark", [(2_000, "cell#"), (0, "dynamicpruning")])
def test_partition_filter(spark, monkeypatch, literals, mark):
    docs = vectors.corpus(spark, SF_DIR)
    pivots = ann.sample_pivots(docs, vectors.PIVOTS)
    path = scratch_path(spark, "index")
    ann.write_index(ann.assign_cells(docs, pivots), path, files=2)
    monkeypatch.setattr(ann, "_PRUNE_LITERALS", literals)
    hits = ann.ann_search(spark.read.parquet(path), vectors.as_queries(docs.limit(3)), pivots, 5, 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters: [" in line]
    assert any(mark in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)
    monkeypatch.setattr(ann, "_PRUNE_LITERALS", 2_000)
    want = ann.ann_search(ann.assign_cells(docs, pivots), vectors.as_queries(docs.limit(3)), pivots, 5, 2)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
