"""Helpers that several operators of this folder share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampType

#: Most rows, and most bytes, of a table that may be broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

#: ASCII white space, as the data contracts define it, in a Java character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Only a local session without one gets a temporary folder; on a cluster a missing
    setting is an error, since a local folder could not be read by the other machines.
    """
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if not there:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            there = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(there)
        there = sc.getCheckpointDir()
    return there


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the checkpoint folder, with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _bytes(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (NumericType, BooleanType, DateType, TimestampType)):
        return F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)) * 8 + 32
    if isinstance(kind, (ArrayType, MapType)):
        return 2 * F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 32
    if isinstance(kind, StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes, else as it is.

    Both are counted here, so df should be materialised. rows, if known, saves the count of
    a table of numbers alone.
    """
    widths = [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    fixed = all(not isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType)) for f in df.schema.fields)
    if fixed:
        rows = df.count() if rows is None else rows
        size = rows * 8 * (len(widths) + 2)
    else:
        rows, size = df.agg(F.count(F.lit(1)), F.sum(sum(widths, F.lit(16)).cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front that no column of df has it."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in there:
            name = f"_{name}"
        out.append(name)
    return out


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two longs that tell documents apart without trusting ids to be present or unique.

    Rows equal in id and text share a key, and so share every decision.
    """
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2")]


def one_thread() -> None:
    """Keep native thread pools of a Python worker to its own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
