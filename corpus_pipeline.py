"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of docs; the last returns packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm import decontamination, language_id, line_dedup, near_dedup, packing
from strandlight.llm.common import broadcast_if_small, checkpoint_folder, cut, fresh, row_key, table

#: Near copies, as for all stages on word shingles: five words, similarity 0.8.
SHINGLE_WORDS, PERCENT = 5, 80


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, also those with a dot in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """changed with docs' columns only; n_chars, where there is one, follows the text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*_columns(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null texts and texts without letters go."""
    model = language_id.train_on_folds(docs)
    return language_id.identify(docs, model).filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*_columns(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; a document of which no word is left goes."""
    out = line_dedup.dedup_lines(docs)
    gone = (F.col("deleted_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _with_text(docs, out.filter(~F.coalesce(gone, F.lit(False))))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.

    Of equal rows (same id and text) one stays. Documents without words have no copies.
    """
    found = near_dedup.near_duplicates(docs, width=SHINGLE_WORDS, percent=PERCENT)
    n1, n2 = fresh(docs, "k1", "k2")
    key = [F.col("k1").alias(n1), F.col("k2").alias(n2)]
    gone = cut(found.filter(~F.col("first")).select(*key).distinct())
    again = cut(found.filter("first").groupBy("k1", "k2").count().filter("count > 1").select(*key))
    k1, k2 = row_key("doc_id", "text")
    on = (k1 == F.col(n1)) & (k2 == F.col(n2))
    kept = docs.join(broadcast_if_small(gone), on, "left_anti")
    if not again.isEmpty():
        one = kept.join(broadcast_if_small(again), on).dropDuplicates([n1, n2])
        kept = kept.join(broadcast_if_small(again), on, "left_anti").unionByName(one.select(*_columns(docs)))
    return kept.select(*_columns(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with checksums of their ids."""
    return packing.pieces_digest(packing.pack(docs, packing.default_tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near copies", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Language models, similarity search and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written to the shared checkpoint folder as Parquet and read again;
    it is removed when the next one is there, so that the last one alone stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
