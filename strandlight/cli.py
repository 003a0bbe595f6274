"""Command line: vectors of files against files, ranges over them, coded forms, and generated inputs.

    python -m strandlight.cli ms --texts DIR --queries DIR --out DIR [--frequency] [--lazy ...]
    python -m strandlight.cli ranges --vector DIR --ranges FILE --op sum --block 4
    python -m strandlight.cli compress --vector DIR --out DIR --codec rle
    python -m strandlight.cli generate --out DIR --seed 1432
    python -m strandlight.cli time --texts DIR --queries DIR --strategy auto --times 3

Each file of a folder is one text, as it stands. Vectors are Parquet with a row a position.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.operators import generate, matching, ranges, stored_bits, vectors
from strandlight.sources import stored


def _files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias(name), F.col("value").alias("text"))


def _flags(args: argparse.Namespace) -> matching.Flags:
    return matching.Flags(args.double_rank, args.lazy, args.rank_fail, args.use_maxrep, args.use_maxrep_rc, args.answer, args.avg)


def ms(spark: SparkSession, args: argparse.Namespace) -> dict:
    _flags(args)
    texts, queries = _files(spark, args.texts, "text_id"), _files(spark, args.queries, "query_id")
    build = matching.ms_frequency if args.frequency else matching.ms_build
    out = stored.store(build(texts, queries, ["query_id"]), args.out, ["query_id", "pos"])
    said = {"positions": out.count()}
    if args.avg:
        said["average"] = {r.query_id: r.avg_ms for r in vectors.average(out, ["query_id"]).collect()}  # a row a file
    return said


def ranges_(spark: SparkSession, args: argparse.Namespace) -> dict:
    """ranges: CSV with query_id, range_id, from_idx, to_idx."""
    asked = spark.read.csv(args.ranges, header=True, schema="query_id string, range_id long, from_idx long, to_idx long")
    out = ranges.answer(spark.read.parquet(args.vector), asked, ["query_id"], args.op, args.algorithm, args.block)
    out.write.mode("overwrite").parquet(args.out)
    return {"ranges": spark.read.parquet(args.out).count()}


def compress(spark: SparkSession, args: argparse.Namespace) -> dict:
    bits = vectors.encode(spark.read.parquet(args.vector), ["query_id"])
    coded = stored_bits.compress(bits, ["query_id"], args.out, args.codec)
    n, size = coded.agg(F.sum("n"), F.sum("n_bits")).first()
    return {"bits": n, "coded_bits": size}


def generate_(spark: SparkSession, args: argparse.Namespace) -> dict:
    pairs = generate.families(spark, seed=args.seed)
    return {"pairs": stored.store(pairs, args.out).count()}


def time_(spark: SparkSession, args: argparse.Namespace) -> dict:
    texts, queries = _files(spark, args.texts, "text_id"), _files(spark, args.queries, "query_id")
    took = []
    for _ in range(args.times):
        began = time.perf_counter()
        matching.ms_build(texts, queries, ["query_id"], strategy=args.strategy).write.format("noop").mode("overwrite").save()
        took.append(round(time.perf_counter() - began, 3))
    return {"strategy": args.strategy, "seconds": took}


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="strandlight")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ms")
    for name in ("texts", "queries", "out"):
        a.add_argument(f"--{name}", required=True)
    for name in ("frequency", "double-rank", "lazy", "rank-fail", "use-maxrep", "use-maxrep-rc", "answer", "avg"):
        a.add_argument(f"--{name}", action="store_true")
    a.set_defaults(run=ms)
    a = sub.add_parser("ranges")
    for name in ("vector", "ranges", "out"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--op", choices=("sum", "max"), default="sum")
    a.add_argument("--algorithm", choices=("scan", "runs"), default="scan")
    a.add_argument("--block", type=int, default=0)
    a.set_defaults(run=ranges_)
    a = sub.add_parser("compress")
    for name in ("vector", "out"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--codec", choices=stored_bits.CODECS, default="rle")
    a.set_defaults(run=compress)
    a = sub.add_parser("generate")
    a.add_argument("--out", required=True)
    a.add_argument("--seed", type=int, default=1432)
    a.set_defaults(run=generate_)
    a = sub.add_parser("time")
    for name in ("texts", "queries"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--strategy", choices=matching.STRATEGIES, default="auto")
    a.add_argument("--times", type=int, default=3)
    a.set_defaults(run=time_)
    args = parser.parse_args(argv)
    said = args.run(SparkSession.builder.getOrCreate(), args)
    print(json.dumps(said))
    return said


if __name__ == "__main__":
    main()
