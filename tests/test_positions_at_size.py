"""Rows of positions are many more than the compressed texts let the planner expect: no join may broadcast them."""

from __future__ import annotations

import os

import pytest

from strandlight.operators import matching
from strandlight.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["ms_at", "range_profile", "range_sum_rrr_indexed", "range_sum_succinct_indexed", "range_max_rrr_indexed", "ms_seed", "ms_naive"])
def test_no_position_is_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 0, raising=False)  # what was counted as few may be
    df = registry.QUERIES[name](spark, DATA)
    df.collect()
    assert "Broadcast" not in plan(df)


@pytest.mark.parametrize("strategy", ["seed", "prefix"])
@pytest.mark.parametrize("most", [0, 500_000])
def test_merged_and_broadcast_prefixes_agree(spark, monkeypatch, strategy, most):
    monkeypatch.setattr(matching, "BROADCAST_ROWS", most)
    texts = spark.createDataFrame([("abcab" * 20,), ("größe x",), ("",), (None,)], "text string")
    queries = spark.createDataFrame([(1, "abcab" * 25), (None, "xbcab" + "abcab" * 9), (2, ""), (3, "é größe"), (4, None)], "qid long, text string")
    want = {(r.qid, r.pos, r.ms) for r in matching.ms_build(texts, queries, ["qid"], strategy="automaton").collect()}
    got = [(r.qid, r.pos, r.ms) for r in matching.ms_build(texts, queries, ["qid"], strategy=strategy).collect()]
    assert len(got) == len(want) and set(got) == want


def test_vectors_without_frequencies(spark):
    texts, queries = spark.createDataFrame([("abcab",)], "text string"), spark.createDataFrame([(1, "cabx")], "qid long, text string")
    assert matching.ms_vectors(texts, queries, ["qid"], counted=False).columns == ["qid", "ms"]
    assert matching.ms_arrays(texts, queries, ["qid"]).collect() == [(1, [3, 2, 1, 0])]
