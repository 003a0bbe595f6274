"""Line dedup against the definition by maximal repeated runs."""

from __future__ import annotations

import collections
import random

from strandlight.llm import line_dedup


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def kept(texts, least):
    """Texts without the lines of any run, however long, that has least words or more and an earlier copy. All lines have words."""
    split = {i: t.split("\n") for i, t in texts}
    seen, gone = set(), collections.defaultdict(set)
    for i, lines in split.items():
        for p in range(len(lines)):
            for q in range(p + 1, len(lines) + 1):
                run = tuple(lines[p:q])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[i] |= set(range(p, q))
                    seen.add(run)
    return {i: "\n".join(x for k, x in enumerate(lines) if k not in gone[i]) for i, lines in split.items()}


def test_later_copies_go_to_the_end_of_the_run(spark):
    runs = {"a": [40, 40, 8], "b": [100, 5], "c": [60], "d": [5, 45, 1, 1, 1], "e": [1, 1, 1, 60, 1, 1], "f": [40, 9]}
    texts = []
    for k, (tag, sizes) in enumerate(runs.items()):
        text = "\n".join(words(n, f"{tag}{j}x") for j, n in enumerate(sizes))
        texts += [(10 * k, text), (10 * k + 1, text), (10 * k + 2, f"{words(3, tag + 'p')}\n{text}\n{words(3, tag + 'q')}")]
    out = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == kept(texts, line_dedup.MIN_WORDS)
    assert [out[10 * k + 1] for k in range(5)] == [""] * 5 and out[51] == texts[-3][1]


def test_maximal_runs_of_random_lines(spark):
    r = random.Random(11)
    for least in (6, 20):
        pool = [words(r.choice((1, 1, 2, 3, 5, 9, 25)), f"l{k}x") for k in range(9)]
        texts = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 16)))) for i in range(40)]
        for i in range(40, 60):  # copies with other lines around them
            source = texts[r.randrange(40)][1].split("\n")
            p = r.randrange(len(source))
            texts.append((i, "\n".join([r.choice(pool), *source[p:], words(2, f"own{i}x"), *source[: p + 1]])))
        out = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), min_words=least).collect()}
        assert out == kept(texts, least)
