"""The stages against plain versions, each on what its predecessor kept."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mercantile.llm import mixing, quality, queries
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = (before, docs)
        if k < 4:
            assert docs.columns == before.columns
    plain = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {i for i, _ in plain(kept[0][1])}
    known = [i for i, _ in plain(kept[0][0]) if i in labels]
    assert sum((i in left) == (labels[i] == 1) for i in known) / len(known) > 0.9

    expected = sorted(i for i, c in brute.classes(plain(kept[1][0])) if i == c)
    assert sorted(i for i, _ in plain(kept[1][1])) == expected

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = sorted(r[0] for r in brute.contamination(plain(kept[2][0]), items) if not r[5])
    assert sorted(i for i, _ in plain(kept[2][1])) == clean

    model = quality.train_on(kept[3][0], quality.learnable(spark.read.parquet(f"{FOLDER}/labels.parquet")))
    sizes = mixing.row_sizes(kept[3][0], lambda data, at: model.score(quality.statistics(data, at)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(sizes, row="row").collect() if r["copies"]}
    assert Counter(i for i, _ in plain(kept[3][1])) == copies

    from tokenizers import Tokenizer

    tokens = brute.token_rows(plain(kept[4][0]), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert sorted(map(tuple, kept[4][1].collect())) == sorted(tokens)


def test_run_is_registered(spark):
    assert queries.all_queries()["pipeline"](spark, FOLDER).count() > 0


AWKWARD = "mix_row", "mix_times", "mix_nth", "row", "key", "of", "gone_ref", "again_ref", "size", "copies", "Target"


def awkward(spark):
    """Documents with every awkward case, many without doc_id, and columns named as the stages' own ones."""
    docs = brute.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.range(150).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('word ', CAST(id AS STRING), ' of a text without a number, all alike in size') AS text", "'en' AS lang", "'a' AS source", "0L AS n_chars")
    docs = docs.unionByName(more)
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(AWKWARD)])


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_awkward_documents_and_empty_tables(spark, stage):
    docs, function = awkward(spark), corpus_pipeline.STAGES[stage][1]
    got = function(spark, docs, FOLDER)
    rows = got.collect()
    assert function(spark, docs.limit(0), FOLDER).count() == 0
    if stage < 4:
        assert got.columns == docs.columns and rows
        held = Counter(map(tuple, docs.collect()))
        again = Counter(map(tuple, rows))
        assert set(again) <= set(held)
        assert stage == 3 or all(n <= held[r] for r, n in again.items())
    else:
        assert len(rows) == docs.count()


def test_the_mix_does_not_depend_on_the_layout(spark):
    docs = awkward(spark).cache()
    found = [Counter(map(tuple, corpus_pipeline.mixed(spark, laid, FOLDER).collect())) for laid in (docs, docs.repartition(7), docs.orderBy(F.desc("text")).coalesce(2))]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) > 100
    docs.unpersist()


def test_better_documents_are_taken_first(spark):
    """Of two sources one is cut to a part; the documents left out of it weigh less, on the whole."""
    long = [(k, f"{'good' if k % 2 else 'bad'} text {k} " + "with words " * 10, "b") for k in range(800)]
    small = [(10_000 + k, "a text", "a") for k in range(10)]
    docs = spark.createDataFrame(long + small, "doc_id long, text string, source string")
    taken = mixing.repeat_mixed(docs, lambda data, at: np.array([0.95 if b"good" in data[a:b].tobytes() else 0.1 for a, b in zip(at[:-1], at[1:], strict=True)]))
    counts = Counter(r["doc_id"] % 2 for r in taken.where("source = 'b'").collect())
    assert counts[0] < counts[1] <= 400 and counts[0] + counts[1] < 800
    sizes = mixing.row_sizes(docs, lambda data, at: np.ones(len(at) - 1))
    assert {(r["source"], r["weight"]) for r in sizes.select("source", "weight").distinct().collect()} == {("a", 1.0), ("b", 1.0)}
