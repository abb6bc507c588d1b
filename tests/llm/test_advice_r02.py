"""Cases that the review of round 2 found missing."""

from collections import Counter

import numpy as np

import corpus_pipeline
from mercantile.llm import mixing, near_dedup, nearest, queries
from tests.llm import brute


def short_lines(rows, least=16):
    """Like brute.lines_removed, but equal lines of any length go unless they are blank."""
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if len(line) >= least or line.strip(" \t\n\v\f\r"):
                first.setdefault(line, (i, k))
    long = [x for x in first if len(x) >= least]
    gone = {a for a in long for b in long if first[b] < first[a] and brute.one_edit(a, b)}
    out = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for k, x in enumerate(lines) if i is None or x not in first or (first[x] == (i, k) and x not in gone)]
        out.append((i, len(lines), len(lines) - len(kept), brute.sha("\n".join(kept))))
    return out


def test_short_lines(spark, tmp_path):
    """Short boilerplate and short CJK sentences go where they repeat; blank lines and short lines one edit apart stay."""
    docs = brute.documents(spark).where("doc_id IS NULL OR doc_id <> 3").select("doc_id", "text")
    heads = ["Read more", "Share this", "这是一个重复的句子。", "x", "é", " \t", "", "exactly 15 char", "exactly 16 chars", "a short line " + "y" * 4]
    texts = ["\n".join([heads[k % 10], f"No {k % 7}", heads[(k * 3) % 10], f"text number {k * 7919} of all"]) for k in range(90)]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = short_lines([tuple(r) for r in docs.collect()])
    assert sum(r[2] for r in expected) > sum(r[2] for r in brute.lines_removed([tuple(r) for r in docs.collect()])) + 200
    got = queries.op9_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_nearest_ties(spark):
    """Binary vectors, where many distinct ones tie at the cut: those with the smaller vec_id are taken."""
    rng = np.random.default_rng(7)
    x = rng.permutation(np.unique(rng.integers(0, 2, (600, 14)), axis=0))[:450].astype(float)
    x[(x == 0).all(axis=1), 0] = 1
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(table, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    scores = x @ x.T
    for q in range(0, len(x), 20):
        ranked = sorted((-scores[q, k], k) for k in range(len(x)) if k != q)
        assert sum(s == ranked[9][0] for s, _ in ranked) > 9
        assert got[q] == [(k, -s) for s, k in ranked[:10]]


def test_copies_go_by_row(spark):
    """Another text under a number that has a copy stays; of exact copies without a number one stays; empty texts all stay."""
    rng = np.random.default_rng(9)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 500, 40))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, c), (None, a), (5, d), (5, d), (None, None), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row_ref int").repartition(3)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (2, b), (None, c), (5, d), (None, None), (None, None), (7, "")])


def test_mix_goes_by_row(spark):
    """Rows without doc_id, and rows that share one, are taken as often as their own source and place in it say."""
    rng = np.random.default_rng(4)
    rows = []
    for source, n in (("a", 400), ("b", 30), ("c", 30), (None, 20)):
        rows += [([None, 3, k][k % 3], source, " ".join(["w"] * int(rng.integers(1, 30)) + [f"{source}{k // 2}"])) for k in range(n)]
    rows += [(None, "a", "one and the same")] * 25
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    taken = mixing.word_counts(corpus_pipeline.mixed(spark, docs, "/root/testdata/sf0.001"), "source").groupBy("source").sum("size").collect()
    sizes = mixing.word_counts(docs, "doc_id", "source").selectExpr("*", "1.0D AS weight")
    targets = {r["source"]: r["target"] for r in mixing.mix(sizes).select("source", "target").distinct().collect()}
    assert len({r["copies"] for r in mixing.mix(sizes).collect()}) > 2
    for r in taken:
        assert abs(r["sum(size)"] - targets[r["source"]]) <= 31
    assert {r["source"] for r in taken} == set(targets)
