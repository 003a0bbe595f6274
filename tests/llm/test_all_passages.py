"""Training of the quality classifier sees every passage."""

from __future__ import annotations

import numpy as np

from strandlight.llm import quality_classifier as qc


def test_every_passage_of_a_long_text_is_encoded(spark, monkeypatch):
    texts = [" ".join(f"w{k % 97}" for k in range(64 * 200)), "short one", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(qc, "fit", lambda bags, labels: seen.update(bags=bags, labels=labels))
    qc.train(docs, labels)
    assert seen["labels"].tolist() == [0, 1, 0, 1]
    for bag, text in zip(seen["bags"], texts, strict=True):
        assert np.array_equal(np.asarray(bag), qc.passages(text))
    assert [len(b) for b in seen["bags"]] == [200, 1, 1, 1]
