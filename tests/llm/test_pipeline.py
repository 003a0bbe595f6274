"""The pipeline's stages one after the other, on documents whose fate is known."""

from __future__ import annotations

import random

import corpus_pipeline
from strandlight.llm import packing


def test_each_stage_does_its_part(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    item = line(30)
    a = "\n".join(line(20) for _ in range(6))
    b = line(120).split()
    near = list(b)
    near[3], near[77] = "changed", "changed"
    rows = [(0, a), (1, a), (2, " ".join(b)), (3, " ".join(near)), (4, line(60) + " " + item + " " + line(60)), (5, "123 !!"), (6, line(90)), (7, None), (8, line(70)), (8, None)]
    rows.append(rows[8])  # the same row twice
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert now.columns == docs.columns
        left.append(sorted(x.doc_id for x in now.collect()))
    assert left == [[0, 1, 2, 3, 4, 6, 8, 8], [0, 2, 3, 4, 6, 8, 8], [0, 2, 4, 6, 8], [0, 2, 6, 8]]
    assert all(x.n_chars == len(x.text) for x in now.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = packing.WordIds(packing.default_tokenizer())
    want = {i: len(next(ids([t]))) // 4 + 1 for i, t in rows if i in (0, 2, 6, 8) and t}
    assert {x.doc_id: x.doc_tokens for x in out} == want
    assert sum(x.length for x in out) == sum(want.values())


def test_an_empty_table_runs_through(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_odd_rows_and_more_columns(spark, tmp_path):
    r = random.Random(22)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(12_000))
    texts = [(0, long), (1, long[: len(long) // 2]), (2, "x" * 300_000), (3, ""), (None, "one word"), (None, None), (4, "ab " * 100_000), (5, "\n" * 1000 + "z")]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "k") for i, t in texts], "doc_id long, text string, lang string, `__k1` int, k1 int, `a.b` string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(word() for _ in range(20))), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert now.columns == docs.columns
    kept = [x.doc_id for x in now.collect()]
    assert sorted(kept, key=str) == [0, 2, 4, 5, None]
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 5
