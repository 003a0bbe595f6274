"""The command line over small files."""

from __future__ import annotations

import pytest

from strandlight import cli
from strandlight.operators import matching


def test_vector_ranges_and_codes(spark, tmp_path):
    for folder, texts in (("s", ["abracadabra", "alakazam"]), ("t", ["cadabrak", "zzz"])):
        (tmp_path / folder).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / folder / f"{i}.txt").write_text(text)
    p = lambda x: str(tmp_path / x)
    assert cli.main(["ms", "--texts", p("s"), "--queries", p("t"), "--out", p("v"), "--avg"])["positions"] == 11
    rows = spark.read.parquet(p("v")).orderBy("query_id", "pos").collect()
    automaton = matching.SuffixAutomaton(["abracadabra", "alakazam"])
    assert [r.ms for r in rows] == automaton.match("cadabrak")[0] + automaton.match("zzz")[0]
    (tmp_path / "r.csv").write_text("query_id,range_id,from_idx,to_idx\n" + f"{rows[0].query_id},0,0,8\n{rows[0].query_id},1,2,4\n")
    assert cli.main(["ranges", "--vector", p("v"), "--ranges", p("r.csv"), "--out", p("o"), "--block", "4"])["ranges"] == 2
    assert {r.range_id: r.sum for r in spark.read.parquet(p("o")).collect()} == {0: sum(r.ms for r in rows[:8]), 1: sum(r.ms for r in rows[2:4])}
    assert cli.main(["compress", "--vector", p("v"), "--out", p("c"), "--codec", "rrr"])["bits"] == 22
    assert cli.main(["generate", "--out", p("g")])["pairs"] == 8
    assert len(cli.main(["time", "--texts", p("s"), "--queries", p("t"), "--times", "1"])["seconds"]) == 1
    with pytest.raises(ValueError):
        cli.main(["ms", "--texts", p("s"), "--queries", p("t"), "--out", p("v"), "--answer", "--avg"])
