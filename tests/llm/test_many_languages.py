"""Language identification learns every label."""

from __future__ import annotations

from strandlight.llm import language_id


def test_rare_labels_are_learned(spark):
    common = [(k, f"{chr(0x4E00 + 20 * k)}{chr(0x4E01 + 20 * k)}{chr(0x4E02 + 20 * k)} " * 20, f"l{k:03}") for k in range(256) for _ in range(2)]
    rare = [(256 + k, f"rare{'abcdefgh'[k] * 9} " * 20, f"r{k}") for k in range(8)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == sorted({x[2] for x in common + rare})
    out = language_id.identify(docs.filter("doc_id >= 256"), model).collect()
    assert len(out) == 8 and all(x.lang_pred == f"r{x.doc_id - 256}" for x in out)
