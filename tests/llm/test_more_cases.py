"""Hosts that reject documents, edited benchmark copies, and columns with the operators' own names."""

from __future__ import annotations

import math
import random
from collections import Counter

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from strandlight.llm import decontamination, line_dedup, near_dedup, quality_rules, url_filters

NAMES = ("__k1", "__K2", "___k1", "k1", "k2", "runs", "stay", "__runs", "__stay", "__day", "__active", "host", "n", "start", "hashes", "words", "class", "keys", "id", "bucket", "root", "first", "path")


def crowded(df):
    """df with many more columns."""
    return df.withColumns({c: F.lit(1) for c in NAMES})


def prose(r, n, vocabulary=3000):
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def test_a_bad_host_takes_its_documents_along(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for host in range(12):
        for k in range(30):
            bad = k < (26 if host == 3 else 2)
            rows.append((len(rows), prose(r, 5) if bad and k % 2 else "to be or " * 40 if bad else prose(r, 80), f"h{host}"))
    rows += [(len(rows), None, "h3"), (len(rows) + 1, prose(r, 80), None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in quality_rules.query(spark, str(tmp_path)).collect()}
    assert all(not x.kept for x in got.values() if rows[x.doc_id][2] == "h3")
    assert all(got[i].kept != got[i].base_failed for i, _, host in rows if host != "h3") and any(not x.kept and not x.base_failed for x in got.values())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = sorted(got[0].asDict())
    want = con.sql(quality_rules.ORACLE)
    assert sorted(tuple(x[c] for c in columns) for x in got.values()) == sorted(con.sql("select " + ", ".join(columns) + " from want").fetchall())


def test_edited_copies_of_items_are_found(spark):
    r = random.Random(2)
    items = [prose(r, r.randrange(20, 90)).split() for _ in range(60)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    df = Counter(s for w in items for s in shingles(w))
    weight = lambda s: math.log(1 + len(items) / df.get(s, 1))
    docs, planted = [], []
    for d in range(250):
        parts = [prose(r, 30)]
        for i in r.sample(range(60), 4):
            w = list(items[i])
            for p in r.sample(range(len(w)), r.choice([0, 1, 1, 2])):
                w[p] = f"new{r.randrange(999)}"
            a, b = shingles(w), shingles(items[i])
            similarity = sum(map(weight, a & b)) / sum(map(weight, a | b))
            if similarity >= 0.8:
                planted.append((d, i))
            parts += [" ".join(w), prose(r, 20)]
        docs.append((d, " ".join(parts)))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    assert len(planted) > 500 and len(set(planted) & found) >= 0.995 * len(planted)


def test_windows_across_segments(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT", 16)
    r = random.Random(3)
    items = [prose(r, n) for n in (6, 30, 100)]
    docs = [(k, prose(r, k) + " " + items[k % 3] + " " + prose(r, 40)) for k in range(0, 60, 3)] + [(k, prose(r, k) + " " + items[k % 3] + " " + prose(r, 5)) for k in range(1, 60, 7)]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(x.doc_id, x.item_id, x.start_word) for x in got.collect() if x.similarity == 1} == {(k, k % 3, k) for k, _ in docs}


def test_columns_with_the_operators_own_names(spark, tmp_path):
    r = random.Random(4)
    long = "\n".join(prose(r, 30) for _ in range(4))
    item = prose(r, 30)
    rows = [(0, long), (1, long), (2, prose(r, 20) + " " + item), (3, prose(r, 90)), (4, None)]
    docs = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = line_dedup.dedup_lines(docs).collect()
    assert {x.doc_id for x in out if x.text == ""} == {1} and out[0]["__k1"] == 1
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {0, 1, 3, 4}
    near = corpus_pipeline.near_stage(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and {x.doc_id for x in near.collect()} == {0, 2, 3, 4}
    assert near_dedup.near_duplicates(docs).count() == 5
    pages = crowded(spark.createDataFrame([(1, "http://bad.com/a", "2024-02-01")], "page_id long, url string, fetched_on string"))
    entries = spark.createDataFrame([("d:bad.com", "add", "2024-01-01")], "entry string, action string, since string")
    assert url_filters.filter_captures(pages, entries).first().blocked


def test_a_long_url_and_deep_entries(spark):
    entries = spark.createDataFrame([("p:x.org/a/a/a", "add", "2024-01-01"), ("d:b.c", "add", "2024-01-01")], "entry string, action string, since string")
    pages = spark.createDataFrame([(1, "http://x.org" + "/a" * 20_000, "2024-02-01"), (2, "http://" + "a." * 5000 + "b.c/", "2024-02-01"), (3, "http://x.org/a/a", "2024-02-01"), (4, "http://b.c..../", "2024-02-01")], "page_id long, url string, fetched_on string")
    assert {x.page_id: x.active for x in url_filters.filter_captures(pages, entries).collect()} == {1: ["p:x.org/a/a/a"], 2: ["d:b.c"], 3: [], 4: ["d:b.c"]}
