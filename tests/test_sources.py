"""Text and FASTA sources, generators, suffix sorting, and scoring of a stream."""

from __future__ import annotations

import random

import numpy as np

from strandlight.operators import generate, suffixes
from strandlight.sources import fasta
from strandlight.streaming.scoring import score_stream


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGN\nTT\n>two\n\nGG\n")
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate((tmp_path / "a.fa").read_text().split("\n"))], "f string, n int, l string")
    got = [(r.record, r.header, r.sequence) for r in fasta.clean(fasta.records(lines, ["f"], "n", "l")).orderBy("record").collect()]
    assert got == [(1, "one x", "ACGTT"), (2, "two", "GG")]
    assert fasta.read_texts(spark, str(tmp_path), backwards=True).first().text.endswith("x eno>")


def test_generators_are_stable_and_mutate_as_many_places(spark):
    text = generate.random_text(spark, 200, seed=3)
    a, b = generate.joined(text).first().text, generate.joined(generate.random_text(spark, 200, seed=3).repartition(3)).first().text
    assert a == b and set(a) <= set("abcde")
    c = generate.joined(generate.mutate(text, 15, seed=4)).first().text
    assert sum(x != y for x, y in zip(a, c)) == 15
    d = generate.joined(generate.repetitive(spark, 50, 4, 6, seed=5)).first().text
    assert len(d) == 200 and all(sum(x != y for x, y in zip(d[:50], d[k : k + 50])) == 6 for k in (50, 100, 150))


def test_suffix_sorting():
    r = random.Random(2)
    for n in (0, 1, 2, 7, 60, 200):
        for a in ("a", "ab", "abcdé"):
            t = "".join(r.choice(a) for _ in range(n))
            sa, lcp = suffixes.sort_suffixes(np.array([ord(c) for c in t], np.uint32))
            assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
            for k in range(1, n):
                x, y = t[sa[k - 1] :], t[sa[k] :]
                m = 0
                while m < min(len(x), len(y)) and x[m] == y[m]:
                    m += 1
                assert lcp[k] == m


def test_stream_of_queries(spark, tmp_path):
    texts = spark.createDataFrame([("abcab",)], "text string")
    spark.createDataFrame([(1, "abca"), (2, "zz")], "qid long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "in"))
    run = score_stream(texts, stream, ["qid"]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.sql("select * from scored").collect()) == [(1, 4, 4, 10), (2, 2, 0, 0)]


def test_patterns_in_parts_and_one_by_one(spark, monkeypatch):
    from strandlight.operators import documents

    r = random.Random(3)
    texts = [(i, "".join(r.choice("ab\n") for _ in range(r.randrange(0, 60)))) for i in range(20)] + [(20, None)]
    patterns = ["a", "ab", "aba", "bb", "b\na", "zz", "", "a" * 5]
    docs, asked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(p,) for p in patterns + ["a"]], "pattern string")
    want = sorted((i, p, k) for i, t in texts for p in set(patterns) - {""} for k in range(len(t or "")) if t.startswith(p, k))
    for chars, module in ((1_000_000, documents.ahocorasick), (10, documents.ahocorasick), (10, None)):
        monkeypatch.setattr(documents, "PATTERN_CHARS", chars)
        monkeypatch.setattr(documents, "ahocorasick", module)
        assert sorted(map(tuple, documents.locate(docs, asked, ["doc_id"]).collect())) == want
    assert documents.counts(docs, asked.limit(0), ["doc_id"]).count() == 0
